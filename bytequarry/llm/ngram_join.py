"""N-gram Jaccard join with PartEnum signatures.

A document is its set of distinct word n-grams, held as 64-bit hashes. Two sets of sizes
r <= s with Jaccard similarity of at least p/100 have r >= s * p/100 and differ in at
most k = (r + s)(100 - p)/(100 + p) elements. The hash domain is cut into n1 parts; a
pair that differs in at most k elements has at least ``n1 - k // (k2 + 1)`` parts with at
most k2 differences. Each part is cut into n2 smaller ones, and every subset of
``n2 - k2`` of them is hashed to a signature, so such a part gives the pair a common
signature. k depends on the size, so sizes fall into bands; each set has signatures for
its own band and for the band border that partners of another band lie across.

n1 is chosen so that not one but ``1 + slack`` parts must agree. A part is weak for a set
if one of its signatures would stand for no element; an agreeing part whose only common
signature has no element is weak for both sets. Hence a set with at most ``slack`` weak
parts need not send signatures without elements, and may leave out as many of its most
frequent signatures as its slack still allows: no pair is lost, and passages that many
documents share make no candidates. Each band takes the shape (n2, k2), with
n2 > k2 > 0, of least cost.

Plan: equal sets are first merged by their fingerprints. Signatures travel packed, one
compressed block for each task and bucket; a signature that many sets of one task share
goes as rows instead, which Spark may split. Candidates come in rounds: each signature has a pivot, every
set is checked against the pivot it shares most signatures with, and the links found
are joined into components. Signatures whose members are in one component are done. When that
settles less than half of what was open, the sets that open signatures still connect
form clusters, and all sets of a cluster are compared in blocks. Every candidate is checked on the exact sets.

Defined cases: null or empty texts have no n-grams, are linked with nothing and are
their own component; texts with fewer words than n are one n-gram; rows with the same id
count as one document, null ids take no part and have a null component; repeated rows
give repeated result rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb, exp

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm import hashing
from bytequarry.llm.components import components
from bytequarry.llm.shared import cut, drop, drop_shuffles, suspects
from bytequarry.session import few_broadcasts, small_batches

#: Bytes of text hashed at once, and n-grams gathered before their signatures are packed.
CHUNK_BYTES, FLUSH = 1 << 19, 400_000
SLICE = 1 << 17
#: Smaller parts of a part, and how many of them may differ: the shapes that a band may choose from by cost.
#: A shape costs its signatures, each more the fewer elements it has, over the share of the slack that empty cells leave.
SHAPES, ACCIDENTS = ((2, 1), (3, 1), (3, 2), (4, 2)), 8
#: Bytes of text behind a bucket of signatures.
BUCKET_BYTES = 32 << 20
#: Texts hashed at once, and their bytes at most (a longer text goes alone).
PORTION, PORTION_BYTES = 250, 2 << 20
#: A fingerprint's rows are dealt over so many keys before they meet.
SALTS = 256
#: In one task's block, a signature of so many sets goes as rows.
HOT = 48
#: Rounds of pivots at most, and sets in a block when all of a cluster are compared.
MAX_TURNS, BLOCK = 6, 512
LONG_WORD = 128
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one after the other, and where each begins (with the end)."""
    bounds, parts = [0], []
    chunk: list[bytes] = []
    held = 0

    def close() -> None:
        if not chunk:
            return
        h, doc = _chunk_shingles(chunk, n)
        counts = np.bincount(doc, minlength=len(chunk))
        bounds.extend((bounds[-1] + np.cumsum(counts)).tolist())
        parts.append(h)
        chunk.clear()

    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass").lower()
        chunk.append(b)
        held += len(b)
        if held >= CHUNK_BYTES:
            close()
            held = 0
    close()
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.asarray(bounds)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, from slices of about ``SLICE`` bytes, so that the work arrays stay small for texts of any length.

    Polynomial hashes modulo 2**64 have known collisions among long strings, so words over
    ``LONG_WORD`` bytes take another hash.
    """
    words, size = np.empty(len(starts), np.uint64), ends - starts
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        if j > i + 1 or size[i] <= LONG_WORD:
            a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
            words[i:j] = hashing.mix(hashing.span(hashing.prefix(data[starts[i] : ends[j - 1]]), a, b) + size[i:j].astype(np.uint64))
        i = j
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return words


def _chunk_shingles(docs: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(d) + 1 for d in docs])
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = _word_hashes(data, starts, ends)
    doc = np.searchsorted(begins, starts, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    count = np.diff(np.concatenate((first, [len(doc)])))

    def chained(at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), np.uint64(size))
        for k in range(size):
            h = hashing.mix(h * hashing.MIX_A + words[at + k])
        return h

    full = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)
    hs, ds = [chained(full, n)], [doc[full]]
    for size in range(1, n):
        short = first[count == size]
        if len(short):
            hs.append(chained(short, size))
            ds.append(doc[short])
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.empty(0, bool)
    return h[new], d[new]


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts to hash at once."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        size = 4 * len(t or "")
        if i > lo and (i - lo >= PORTION or held + size > 4 * PORTION_BYTES):
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(texts):
        yield lo, len(texts)


class Plan:
    """Bands, and the PartEnum parameters of each band (even tags) and band border (odd tags)."""

    def __init__(self, percent: int = 80, largest: int = 1 << 40):
        self.percent = percent
        b = [1]
        while b[-1] < largest:
            b.append(max(b[-1] + 1, b[-1] * 10000 // (percent * percent)))
        self.borders = np.asarray(b, np.int64)

    def differences(self, total: int) -> int:
        return total * (100 - self.percent) // (100 + self.percent)

    def tags(self, size: int) -> list[tuple[int, int]]:
        """(tag, k) that a set of ``size`` takes part in."""
        j = int(np.searchsorted(self.borders, size, "right")) - 1
        low, high = int(self.borders[j]), int(self.borders[j + 1])
        out = [(2 * j, self.differences(2 * (high - 1)))]
        for border, tag in ((low, 2 * j - 1), (high, 2 * j + 1)):
            top = (border - 1) * 100 // self.percent  # the largest partner above the border
            least = -(-border * self.percent // 100)
            if border > 1 and least <= size <= top:
                out.append((tag, self.differences(border - 1 + top)))
        return [(t, k) for t, k in out if k > 0]

    @staticmethod
    def parameters(k: int) -> tuple[int, int, int, int]:
        """n1, n2, k2, slack."""
        def shape(n2: int, k2: int) -> tuple[float, tuple[int, int, int, int]]:
            slack = max(1, k // 5)
            n1, chosen = k // (k2 + 1) + 1 + slack, n2 - k2
            # sets of this band have 2.9 k to 4.5 k elements; the smallest leave most cells empty
            small, large = 2.9 * k / (n1 * n2), 4.5 * k / (n1 * n2)
            weak = n1 * sum(comb(n2, e) * exp(-small) ** e * (1 - exp(-small)) ** (n2 - e) for e in range(chosen, n2 + 1))
            return n1 * comb(n2, k2) * (1 + ACCIDENTS * 0.5 ** (large * chosen)) / max(0.1, 1 - weak / slack), (n1, n2, k2, slack)

        return min(shape(n2, k2) for n2, k2 in SHAPES)[1]


def signatures(h: np.ndarray, bounds: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, set number and mark (tag parity and slack left) of all sets' signatures.

    Hashes are sorted, and parts are ranges of the hash domain, so a part's elements stand
    together; its signature is a sum of mixed hashes, taken from one running sum.
    """
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(hashing.mix(h ^ np.uint64(M_SIGN)), out=total[1:])
    by_plan: dict[tuple[int, int], list[int]] = {}
    for i, size in enumerate(np.diff(bounds).tolist()):
        if size:
            for key in plan.tags(size):
                by_plan.setdefault(key, []).append(i)
    sigs, sets, marks = [], [], []
    high = (h >> np.uint64(32)).astype(np.float64) / 2.0**32  # the place in the domain
    for (tag, k), members in by_plan.items():
        n1, n2, k2, slack = plan.parameters(k)
        cells = n1 * n2
        for lo in range(0, len(members), 512):
            ids = np.asarray(members[lo : lo + 512])
            size = bounds[ids + 1] - bounds[ids]
            at = np.repeat(bounds[ids] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            cell = np.minimum((high[at] * cells).astype(np.int64), cells - 1) + np.repeat(np.arange(len(ids)) * cells, size)
            count = np.bincount(cell, minlength=len(ids) * cells)
            edge = np.concatenate(([0], np.cumsum(count)))
            shift = np.repeat(bounds[ids] - np.concatenate(([0], np.cumsum(size)[:-1])), cells)
            begin, end = edge[:-1] + shift, edge[1:] + shift
            sums = (total[end] - total[begin]).reshape(len(ids), n1, n2)
            filled = count.reshape(len(ids), n1, n2)
            # parts in which some signature would stand for no element at all
            left = slack - ((filled == 0).sum(2) >= n2 - k2).sum(1)
            for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
                part = np.arange(n1, dtype=np.uint64)[None, :]
                s = part * np.uint64(64) + np.uint64(c) + np.uint64(tag << 40)
                s = hashing.mix(np.broadcast_to(s, (len(ids), n1)) + np.uint64(hashing.M))
                for x in chosen:
                    s = hashing.mix(s * hashing.MIX_B + sums[:, :, x])
                # signatures without elements matter only to sets with more such parts than the slack
                keep = (filled[:, :, list(chosen)].sum(2) > 0) | (left < 0)[:, None]
                row, col = np.nonzero(keep)
                sigs.append(s[row, col])
                sets.append(ids[row])
                marks.append((np.clip(left, 0, 127)[row] * 2 + tag % 2).astype(np.uint8))
    if not sigs:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
    return np.concatenate(sigs), np.concatenate(sets), np.concatenate(marks)


#: Fixed value: keeps signature sums apart from other uses of the same hashes.
M_SIGN = 0x5851F42D4C957F2D


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns byte by byte (all first bytes, then all second ones), compressed."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueeze(blob: bytes, n: int, *types: str) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), [], 0
    for t in types:
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).reshape(n))
        at += n * w
    return out


BLOCK_SCHEMA = "bucket int, n int, hot boolean, base long, blob binary"
MEMBER_SCHEMA = "sig long, id long, mark int"


def _blocks(sigs: np.ndarray, ids: np.ndarray, marks: np.ndarray, buckets: int, salt: int) -> pd.DataFrame:
    """One task's signatures as a block for each bucket; those of ``HOT`` sets or more as blocks of rows."""
    bucket = (sigs >> np.uint64(32)) % np.uint64(buckets)
    key = (bucket << np.uint64(32)) | (sigs & np.uint64(0xFFFFFFFF))
    order = np.argsort(key, kind="stable")
    key, ids, marks = key[order], ids[order], marks[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((start, [len(key)])))
    hot = np.repeat(size >= HOT, size)
    rows = []
    least = int(ids.min())
    wide = int(ids.max()) - least >= 1 << 32
    pack = lambda i: (ids[i] - least).astype(np.int64 if wide else np.uint32)
    if hot.any():
        for lo in range(0, int(hot.sum()), 100_000):
            i = np.flatnonzero(hot)[lo : lo + 100_000]
            rows.append((buckets + (salt + lo) % buckets, len(i), True, -least - 1 if wide else least, _squeeze(key[i], pack(i), marks[i])))
        # the smallest member of a hot signature still meets the other tasks
        lowest = np.minimum.reduceat(ids, start)
        normal = np.flatnonzero(~hot | ((ids == np.repeat(lowest, size)) & hot))
    else:
        normal = np.arange(len(key))
    own = (key[normal] >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            i = normal[a:b]
            low = (key[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows.append((int(own[a]), b - a, False, -least - 1 if wide else least, _squeeze(np.diff(low, prepend=np.uint32(0)), pack(i), marks[i])))
    return pd.DataFrame(rows, columns=["bucket", "n", "hot", "base", "blob"])


def _open_block(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = r.base < 0
    key, ids, marks = _unsqueeze(r.blob, r.n, "<u8" if r.hot else "<u4", "<i8" if wide else "<u4", "u1")
    if not r.hot:
        key = np.cumsum(key, dtype=np.uint32).astype(np.uint64) | np.uint64(r.bucket << 32)
    return key.view(np.int64), ids.astype(np.int64) + (-r.base - 1 if wide else r.base), marks


def _members(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of all signatures in a bucket that more than one set has."""
    opened = [_open_block(r) for r in pdf.itertuples()]
    key, ids, marks = (np.concatenate(x) for x in zip(*opened, strict=True))
    if not pdf["hot"].iloc[0]:
        order = np.argsort(key, kind="stable")
        key, ids, marks = key[order], ids[order], marks[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((start, [len(key)])))
        many = np.repeat(np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start), size)
        key, ids, marks = key[many], ids[many], marks[many]
    return pd.DataFrame({"sig": key, "id": ids, "mark": marks.astype(np.int32)})


def _sized(df: DataFrame, n: int) -> DataFrame:
    """``id, n_shingles`` and a 128-bit fingerprint of each row's set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in portions(texts):
                h, bounds = shingle_sets(texts[lo:hi], n)
                size = np.diff(bounds)
                sums = []
                for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(hashing.mix(h + np.uint64(seed)), out=total[1:])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi].to_numpy(), "n_shingles": size, "f1": sums[0], "f2": sums[1]}).astype({"id": "Int64"})
        hashing.tidy()

    return df.mapInPandas(run, "id long, n_shingles long, f1 long, f2 long")


def _signed(df: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        plan, salt = Plan(percent), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame | None:
            h, ids = np.concatenate([x[0] for x in held]), np.concatenate([x[2] for x in held])
            bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[1]) for x in held]))))
            held.clear()
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(hashing.mix(h), out=total[1:])
            prints, sizes = total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)
            # of equal sets in a block only the smallest id goes on; the smallest of all is among those
            order = np.lexsort((ids, sizes, prints))
            p, z = prints[order], sizes[order]
            new = np.concatenate(([True], (p[1:] != p[:-1]) | (z[1:] != z[:-1])))
            keep = np.zeros(len(ids), bool)
            keep[order[new]] = True
            keep &= sizes > 0
            sigs, sets, marks = signatures(h[np.repeat(keep, sizes)], np.concatenate(([0], np.cumsum(sizes[keep]))), plan)
            return _blocks(sigs, ids[keep][sets], marks, buckets, salt) if len(sigs) else None

        for pdf in batches:
            pdf = pdf[pdf["id"].notna()]
            all_ids = pdf["id"].to_numpy(np.int64)
            texts = pdf["text"].tolist()
            for lo, hi in portions(texts):
                h, bounds = shingle_sets(texts[lo:hi], n)
                held.append((h, bounds, all_ids[lo:hi]))
                size += len(h)
                if size >= FLUSH:
                    if (out := flush()) is not None:
                        yield out
                    size = 0
        if held and (out := flush()) is not None:
            yield out
        hashing.tidy()

    return df.mapInPandas(run, BLOCK_SCHEMA)


def _sets_of(df: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``id, s`` (the set) for the ids given, and for a few others that a filter lets through."""
    _, rows = suspects(df.where("id IS NOT NULL"), "id", ids, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in portions(texts):
                h, bounds = shingle_sets(texts[lo:hi], n)
                s = h.view(np.int64)
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi].to_numpy(), "s": [s[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})
        hashing.tidy()

    return rows.mapInPandas(run, "id long, s array<long>")


def _ids_and_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    return cut(_sets_of(docs, ids, n), "candidates")


def _links_between(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links between the rows of one cluster, in one block or between two."""
    ids, known = pdf["id"].tolist(), {}
    top = list(range(len(ids)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, c in enumerate(pdf["c"].tolist()):
        top[i] = root(known.setdefault(c, i))
    sets, side = [np.asarray(x, np.int64) for x in pdf["s"]], pdf["own"].to_numpy()
    size = np.asarray([len(x) for x in sets])
    two = side.min() != side.max()
    right = np.flatnonzero(side == side.max())
    element, owner = np.concatenate([sets[i] for i in right]), np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    out = []
    for i in np.flatnonzero(side == side.min()).tolist() if two else right.tolist():
        lo, hi = np.searchsorted(element, sets[i]), np.searchsorted(element, sets[i], "right")
        count = hi - lo
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(lo, count)
        both = np.bincount(owner[at], minlength=len(right))
        for j in right[np.flatnonzero(100 * both >= percent * (size[i] + size[right] - both))].tolist():
            if (a := root(i)) != (b := root(j)):
                top[a] = b
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _settled(rest: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The links that are left, from comparing all sets of a cluster.

    A cluster holds the sets that open signatures connect, so all candidates are inside.
    Large clusters are cut into blocks of about ``BLOCK`` sets, and each two blocks meet in
    a group of their own; a group returns no more links than it has sets.
    """
    spark = docs.sparkSession
    cluster = components(rest.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
    size = cluster.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    of = rest.groupBy(F.col("id").alias("node")).agg(F.min("c").alias("c"))
    member = cut(cluster.join(of, "node").join(size, "component"), "clusters")
    sets = _ids_and_sets(docs, member.select(F.col("node").alias("id")), n)
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))
    groups = 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(groups)))
    dealt = dealt.select(F.col("node").alias("id"), "c", "component", "own", key.alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, part in pdf.groupby("component", sort=False) if len(part) > 1 for x in _links_between(part, percent)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.join(sets, "id").groupBy("g", "i", "j").applyInPandas(run, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _ids_and_sets(docs, ids, n)
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(right, "b").join(left, "a").withColumn("i", both).where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _rarest(members: DataFrame) -> DataFrame:
    """Of each set's signatures on one side all but its ``left`` most frequent ones; nothing of sets with so few.

    Similar sets share more than ``left`` signatures on a side. In one order for all sets,
    the rarest that they share has ``left`` others after it in either set, so it stays in both.
    An id with several sets leaves out as many as the set with the least slack may.
    """
    own = Window.partitionBy("id", "side")
    ranked = members.withColumns({"r": F.row_number().over(own.orderBy(F.desc("m"), "sig")), "l": F.min("left").over(own)})
    return ranked.where("r > l").drop("r", "l")


def _shared(members: DataFrame) -> DataFrame:
    """The rows of signatures that two ids or more have, with the smallest id and the number of rows."""
    many = members.groupBy("sig").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("m")).where("low < high").drop("high")
    return members.join(many, "sig")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; see the module's text."""
    # the driver holds no table that grows with the input: joins that run later are merges
    with few_broadcasts(df.sparkSession), small_batches(df.sparkSession):
        sized, rep, comp = _classes(df, doc_id, text, n, percent)
    of_id = rep.join(comp.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    return sized.join(of_id.hint("merge"), "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def _classes(df: DataFrame, doc_id: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's set, each id's representative, and the components of representatives."""
    spark = df.sparkSession
    drop_shuffles(spark)
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a bucket is one group: the text behind it is bounded whatever the input
    buckets = max(4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-size // BUCKET_BYTES))
    sized = cut(_sized(docs, n), "sets")
    print_ = ["n_shingles", "f1", "f2"]
    known = sized.where("n_shingles > 0 AND id IS NOT NULL")
    # a fingerprint that very many rows have meets itself as at most SALTS rows
    known = known.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS)))
    salted = cut(known.groupBy(*print_, "salt").agg(F.min("id").alias("low")), "salted")
    first = salted.groupBy(*print_).agg(F.min("low").alias("rep"))
    reps = cut(salted.join(first, print_).select(*print_, "salt", "rep"), "salted-reps")
    firsts = cut(known.join(reps, [*print_, "salt"]).select("id", "rep"), "firsts")
    drop(salted, reps)
    # one row per id: rows with equal ids are one document, so all their sets are linked
    rep = cut(firsts.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")), "reps")
    several = rep.where("rep <> other").select("id", F.col("rep").alias("a"))
    same_id = cut(firsts.join(several, "id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "same-id")

    # merged sets are left to their smallest id: an id that is first of one of its sets has itself as the largest
    sure, maybe = suspects(docs, "id", rep.where("id <> other"), "id")
    fresh = sure.unionByName(maybe.join(rep.where("id = other").select("id"), "id", "left_semi"))
    blocks = _signed(fresh, n, percent, buckets).groupBy("bucket").applyInPandas(_members, MEMBER_SCHEMA)
    met = cut(blocks, "members")
    # ``left`` is the slack less the set's empty parts
    shared = cut(_shared(met.selectExpr("sig", "id", "mark % 2 AS side", "mark div 2 AS left")), "shared")
    drop(met)
    members = cut(_shared(_rarest(shared).drop("low", "m")), "rarest")
    drop(shared)
    links, comp, before = same_id, components(same_id), float("inf")
    for turn in range(MAX_TURNS):
        placed = members.join(comp.withColumnRenamed("node", "id"), "id", "left").select("sig", "side", "id", F.coalesce("component", "id").alias("c"))
        sizes = placed.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("pivot")).where("c0 < c1")
        rest = cut(placed.join(sizes.select("sig", "pivot"), "sig"), "open")
        rows = rest.count()
        if not rows:
            break
        # pivots go on only while they settle most of what was open
        last = 2 * rows > before or turn == MAX_TURNS - 1
        if last:
            found = _settled(rest, docs, n, percent)
        else:
            before = rows
            at = rest.where("id <> pivot").join(comp.selectExpr("node AS pivot", "component AS pc"), "pivot", "left").where("c <> coalesce(pc, pivot)")
            pairs = at.groupBy("id", "pivot").agg(F.count("*").alias("k")).groupBy("id").agg(F.max_by("pivot", F.struct("k", -F.col("pivot"))).alias("pivot"))
            pairs = cut(pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "pairs")
            found = _linked(pairs, docs, n, percent)
        links = cut(links.unionByName(found), "links")
        comp = components(links)
        drop(rest)
        if last:
            break
    drop(members)
    return sized, rep, comp
