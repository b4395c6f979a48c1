"""Removal of byte strings that also start in an earlier document, by hash-compared suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document of
a smaller id. Every string of that length has a smallest ``GRAM``-byte gram by hash.
Consecutive starts with the same smallest gram form a stretch, and equal strings always
fall into stretches of the same gram, so stretches are dealt out by gram and each bucket
can be decided alone.

In a bucket, equal stretches are first merged: only those of the smallest id stay open.
String starts of the rest whose polynomial hash is not alone are suffix-sorted (a lone hash
has no equal string; the sort of all starts gives the same, which a test holds). The sort is
a mergesort that starts from runs of equal first eight bytes, which numpy's stable sort
makes; two suffixes are compared by a binary search on prefix hashes for their common
extension, then by the byte after it. Neighbours whose extension reaches ``LENGTH`` are
checked byte by byte, so a hash collision removes nothing.

Work goes in ``ROUNDS`` rounds over disjoint grams; each reads the texts again and writes
its removed ranges to the shared folder, so that shuffle files hold a round's share at a
time. Equal stretches inside one task are merged before they are sent, so a group of
copies sends one stretch for each task, not one for each copy.

Defined cases: null texts are empty, texts shorter than ``LENGTH`` keep every byte; rows
with the same id do not remove each other's bytes, and rows without id neither remove nor
lose any; texts of any length are read whole; repeated rows give repeated result rows; an
empty table gives an empty result; only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm import hashing
from bytequarry.llm.shared import cut, drop_shuffles

LENGTH, GRAM, ROUNDS = 50, 16, 3
#: Starts in one stretch at most; bytes of text hashed at once; bytes of stretches packed at once.
LONGEST, CHUNK_BYTES, FLUSH_BYTES = 200, 1 << 20, 24 << 20
#: Bytes of text behind a bucket, which is one group.
BUCKET_BYTES = 32 << 20

BLOCK_SCHEMA = "bucket int, n int, settled boolean, wide boolean, base long, blob binary"
RANGE_SCHEMA = "id long, mark long, ranges binary"


def _ramp(count: np.ndarray) -> np.ndarray:
    """0 .. count[i]-1 for each i, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def stretches(data: np.ndarray, begins: np.ndarray, length: int = LENGTH, gram: int = GRAM, turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, document, gram key and content hash of one round's stretches.

    ``begins`` holds where documents begin in ``data``, and its end.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    pre = hashing.prefix(data)
    h = (pre[gram:] - pre[:-gram]) * hashing.powers(hashing.M_INV, len(pre) - gram)
    h ^= h >> np.uint64(32)
    h *= hashing.MIX_A
    low = (h >> np.uint64(32)).astype(np.uint32)  # 32 bits order the grams; equal strings still agree
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    # a stretch ends where the smallest gram changes, and where the next document begins
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[begins[:-1][begins[:-1] < len(low)]] = True
    beyond = np.maximum(begins[1:] - length + 1, begins[:-1])
    new[beyond[beyond < len(low)]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(low)])))
    key = hashing.mix(low[first].astype(np.uint64) * hashing.MIX_B)
    mine = np.flatnonzero(key % np.uint64(rounds) == np.uint64(turn))
    first, count, key = first[mine], count[mine], key[mine]
    doc = np.searchsorted(begins, first, "right") - 1
    keep = first + length <= begins[doc + 1]
    first, count, key, doc = first[keep], count[keep], key[keep], doc[keep]
    pieces = -(-count // LONGEST)
    if len(pieces) and pieces.max() > 1:
        step = _ramp(pieces)
        first = np.repeat(first, pieces) + step * LONGEST
        count = np.minimum(np.repeat(count, pieces) - step * LONGEST, LONGEST)
        key, doc = np.repeat(key, pieces), np.repeat(doc, pieces)
    content = hashing.mix(hashing.span(pre, first, first + count + length - 1) + count.astype(np.uint64))
    return first, count, doc, key, content


class Suffixes:
    """Strings of ``length`` bytes in ``data``, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, pre: np.ndarray, length: int = LENGTH):
        self.data, self.pre, self.length = data, pre, length
        self.inverse = hashing.powers(hashing.M_INV, len(pre))

    def heads(self, at: np.ndarray) -> np.ndarray:
        """The first eight bytes as numbers in byte order."""
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | self.data[at + k]
        return out

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes at a and b, up to ``length``."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        ia, ib, pa, pb = self.inverse[a], self.inverse[b], self.pre[a], self.pre[b]
        while len(a) and (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.pre[a + mid] - pa) * ia == (self.pre[b + mid] - pb) * ib
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def sort(self, at: np.ndarray) -> np.ndarray:
        """``at`` in order of the strings that start there.

        A stable mergesort: runs of equal first eight bytes come from numpy's, and within them
        bottom-up merges compare by common extensions. Each level touches only the runs that
        are longer than its blocks.
        """
        head = self.heads(at)
        order = np.argsort(head, kind="stable")
        head, at = head[order], at[order]

        def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
            a, b = at[x], at[y]
            e = self.extension(a, b)
            full = e == self.length
            e = np.where(full, 0, e)
            return np.where(full, or_equal, self.data[a + e] < self.data[b + e])

        begin = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        size = np.diff(np.concatenate((begin, [len(at)])))
        order, m = np.arange(len(at)), 1
        while (long := size > m).any():
            i = np.repeat(begin[long], size[long]) + _ramp(size[long])
            start, end = np.repeat(begin[long], size[long]), np.repeat(begin[long] + size[long], size[long])
            block = start + (i - start) // (2 * m) * (2 * m)
            left = i - block < m
            # each element's rank in the other block
            lo = np.where(left, np.minimum(block + m, end), block)
            hi = np.where(left, np.minimum(block + 2 * m, end), block + m)
            other = lo.copy()
            mine = order[i]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                # other < mine, or other <= mine where mine stands on the right
                before = less(order[mid], mine[open_], ~left[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            place = np.where(left, i, i - m) + lo - other
            order[place] = mine
            m *= 2
        return at[order]


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] are the same bytes."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 50_000):
        x, y, n = a[lo : lo + 50_000], b[lo : lo + 50_000], size[lo : lo + 50_000]
        step = _ramp(n)
        differ = data[np.repeat(x, n) + step] != data[np.repeat(y, n) + step]
        out[lo + np.repeat(np.arange(len(x)), n)[differ]] = False
    return out


def _merge_equal(data: np.ndarray, first: np.ndarray, count: np.ndarray, content: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each stretch is settled (an equal one has a smaller id), and its group's first row.

    Rows whose bytes differ from their group's first row stay groups of their own.
    """
    order = np.lexsort((ids, content))
    c = content[order]
    new = np.concatenate(([True], c[1:] != c[:-1]))
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    group = np.arange(len(first))
    rest = order[~new]
    to = lead[~new]
    same = (count[rest] == count[to]) & _equal_bytes(data, first[rest], first[to], np.minimum(count[rest], count[to]) + length - 1)
    group[rest[same]] = to[same]
    return ids[group] < ids, group


def removed(data: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray, length: int = LENGTH, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first removed start and number of removed starts, for all stretches of one bucket.

    Starts whose hash is alone in the bucket have no equal string and need no place in the
    order; with ``every`` they are sorted too, and the sort alone decides.
    """
    pre = hashing.prefix(data)
    content = hashing.mix(hashing.span(pre, first, first + count + length - 1) + count.astype(np.uint64))
    settled, group = _merge_equal(data, first, count, content, ids, length)
    rows, begins, counts = [np.flatnonzero(settled)], [np.zeros(int(settled.sum()), np.int64)], [count[settled]]
    lead = np.flatnonzero(group == np.arange(len(first)))
    # string starts of the distinct stretches
    owner = np.repeat(lead, count[lead])
    at = first[owner] + _ramp(count[lead])
    h = hashing.span(pre, at, at + length)
    # a table of counts rules most lone hashes out before the rest is sorted
    slot = (h >> np.uint64(62 - len(h).bit_length())).astype(np.int64)
    some = np.flatnonzero(np.bincount(slot)[slot] > 1)
    order = some[np.argsort(h[some])]
    same = h[order][1:] == h[order][:-1]
    shared = np.zeros(len(at), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    pick = np.arange(len(at)) if every else np.flatnonzero(shared)
    if len(pick):
        sorted_at = Suffixes(data, pre, length).sort(at[pick])
        # starts are distinct places, so places lead back to rows
        by_place = np.argsort(at)
        row = owner[by_place[np.searchsorted(at[by_place], sorted_at)]]
        alike = Suffixes(data, pre, length).extension(sorted_at[1:], sorted_at[:-1]) == length
        alike &= _equal_bytes(data, sorted_at[1:], sorted_at[:-1], np.full(len(alike), length))
        begin = np.flatnonzero(np.concatenate(([True], ~alike)))
        least = np.minimum.reduceat(ids[row], begin)
        least = np.repeat(least, np.diff(np.concatenate((begin, [len(row)]))))
        gone = np.sort(sorted_at[least < ids[row]])
        if len(gone):
            owner_of = owner[by_place[np.searchsorted(at[by_place], gone)]]
            brk = np.concatenate(([True], (gone[1:] != gone[:-1] + 1) | (owner_of[1:] != owner_of[:-1])))
            s = np.flatnonzero(brk)
            n = np.diff(np.concatenate((s, [len(gone)])))
            lead_row, offset = owner_of[s], gone[s] - first[owner_of[s]]
            # the leading row's ranges hold for all rows of its group with its id
            twins = np.flatnonzero((group != np.arange(len(first))) & ~settled)
            rows.append(lead_row), begins.append(offset), counts.append(n)
            if len(twins):
                o = np.argsort(lead_row, kind="stable")
                a, b = np.searchsorted(lead_row[o], group[twins]), np.searchsorted(lead_row[o], group[twins], "right")
                j = o[np.repeat(a, b - a) + _ramp(b - a)]
                rows.append(np.repeat(twins, b - a)), begins.append(offset[j]), counts.append(n[j])
    return np.concatenate(rows), np.concatenate(begins), np.concatenate(counts)


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges merged where they touch or overlap, in order."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((new[1:], [True]))
    return start[new], end[last]


def _ranges(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """One row per document with its ranges as packed pairs of 64-bit numbers."""
    out = []
    if len(ids):
        o = np.lexsort((start, marks, ids))
        ids, marks, start, end = ids[o], marks[o], start[o], end[o]
        new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))))
        for a, b in zip(new.tolist(), np.concatenate((new[1:], [len(ids)])).tolist(), strict=True):
            out.append((int(ids[a]), int(marks[a]), np.stack(union(start[a:b], end[a:b])).astype("<i8").tobytes()))
    return pd.DataFrame(out, columns=["id", "mark", "ranges"])


def _pack(bucket: int, settled: bool, base: int, wide: bool, ids, marks, start, count, keys, raw: bytes) -> tuple:
    cols = [keys.astype("<u4"), (ids - base).astype("<i8" if wide else "<u4"), marks.astype("<u4"), start.astype("<u8" if wide else "<u4"), count.astype("<u8" if settled else "u1")]
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in cols) + raw
    return bucket, len(ids), settled, wide, base, zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(r) -> tuple:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.blob), np.uint8), 0, []
    for t in ("<u4", "<i8" if r.wide else "<u4", "<u4", "<u8" if r.wide else "<u4", "<u8" if r.settled else "u1"):
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + r.n * w].reshape(w, r.n).T).view(t).reshape(r.n).astype(np.int64))
        at += r.n * w
    out[1] = out[1] + r.base
    return (*out, raw[at:])


def _dealt(df: DataFrame, turn: int, rounds: int, buckets: int, length: int) -> DataFrame:
    """The stretches of one round, packed by bucket, and ranges that their own task has settled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        hashing.hold()
        salt = TaskContext.get().partitionId()
        held: list[tuple] = []
        docs: list[bytes] = []
        who: list[tuple[int, int]] = []
        size = {"docs": 0, "held": 0}

        def close() -> None:
            data = np.frombuffer(b"".join(docs), np.uint8)
            begins = np.cumsum([0] + [len(d) for d in docs])
            first, count, doc, key, content = stretches(data, begins, length, turn=turn, rounds=rounds)
            if len(first):
                n = count + length - 1
                body = data[np.repeat(first, n) + _ramp(n)]
                names = np.asarray(who, np.int64)
                held.append((names[doc, 0], names[doc, 1], first - begins[doc], count, ((key // np.uint64(rounds)) % np.uint64(buckets)).astype(np.int64), key >> np.uint64(32), content, body))
                size["held"] += len(body)
            docs.clear(), who.clear()
            size["docs"] = 0

        def flush() -> pd.DataFrame:
            ids, marks, start, count, bucket, keys, content, body = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size["held"] = 0
            n = count + length - 1
            first = np.cumsum(n) - n
            settled, _ = _merge_equal(body, first, count, content, ids, length)
            base = int(ids.min())
            wide = int(ids.max()) - base >= 1 << 32 or int(start.max()) >= 1 << 32
            rows = []
            gone = np.flatnonzero(settled)
            if len(gone):
                # ranges of one document that overlap travel as one
                o = gone[np.lexsort((start[gone], marks[gone], ids[gone]))]
                s, e = start[o], start[o] + n[o]
                own = np.concatenate(([True], (ids[o][1:] != ids[o][:-1]) | (marks[o][1:] != marks[o][:-1])))
                new = own | np.concatenate(([True], s[1:] > e[:-1]))
                k = np.flatnonzero(new)
                e = np.maximum.reduceat(e, k)
                rows.append(_pack(buckets + salt % buckets, True, base, wide, ids[o][k], marks[o][k], s[k], e - s[k], keys[o][k], b""))
            o = np.flatnonzero(~settled)
            o = o[np.argsort(bucket[o], kind="stable")]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket[o])) + 1, [len(o)])) if len(o) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                i = o[a:b]
                raw = body[np.repeat(first[i], n[i]) + _ramp(n[i])].tobytes()
                rows.append(_pack(int(bucket[i[0]]), False, base, wide, ids[i], marks[i], start[i], count[i], keys[i], raw))
            return pd.DataFrame(rows, columns=["bucket", "n", "settled", "wide", "base", "blob"])

        for pdf in batches:
            for i, mark, t in zip(pdf["id"], pdf["mark"], pdf["text"], strict=True):
                b = (t or "").encode("utf-8", "surrogatepass")
                if len(b) < length or pd.isna(i):
                    continue
                docs.append(b), who.append((int(i), int(mark)))
                size["docs"] += len(b)
                if size["docs"] >= CHUNK_BYTES:
                    close()
                    if size["held"] >= FLUSH_BYTES:
                        yield flush()
        if docs:
            close()
        if held:
            yield flush()
        hashing.tidy()

    return df.mapInPandas(run, BLOCK_SCHEMA)


def _decided(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashing.hold()
        keys, ids, marks, start, count, raw = zip(*(_unpack(r) for r in pdf.itertuples()), strict=True)
        keys, ids, marks, start, count = (np.concatenate(x) for x in (keys, ids, marks, start, count))
        if pdf["settled"].iloc[0]:
            return _ranges(ids, marks, start, start + count)
        # a stretch that is alone with its gram has no equal string anywhere
        _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
        some = np.flatnonzero(size[group] > 1)
        n = count + length - 1
        first = (np.cumsum(n) - n)[some]
        ids, marks, start, count, n = ids[some], marks[some], start[some], count[some], n[some]
        data = np.concatenate(raw)[np.repeat(first, n) + _ramp(n)]
        row, offset, k = removed(data, np.cumsum(n) - n, count, ids, length) if len(some) else (some, some, some)
        return _ranges(ids[row], marks[row], start[row] + offset, start[row] + offset + k + length - 1)

    return run


def removed_ranges(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """``id, mark, ranges``: packed byte ranges to remove; ``mark`` tells texts with the same id apart."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("id"), _mark(text).alias("mark"), F.col(text).alias("text"))
    drop_shuffles(spark)
    # a bucket is one group: its bytes are bounded whatever the input
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-size // (rounds * BUCKET_BYTES)))
    out = None
    for turn in range(rounds):
        part = cut(_dealt(docs, turn, rounds, buckets, length).groupBy("bucket").applyInPandas(_decided(length), RANGE_SCHEMA), "ranges")
        out = part if out is None else out.unionByName(part)
    return out


def _mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, rounds: int = ROUNDS, keep: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep``, ``kept`` (the bytes that stay) for every row."""
    ranges = removed_ranges(df, doc_id, text, length, rounds).groupBy("id", "mark").agg(F.collect_list("ranges").alias("ranges"))
    docs = df.select(F.col(doc_id).cast("long").alias("id"), _mark(text).alias("mark"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t, packed in zip(pdf["id"], pdf["text"], pdf["ranges"], strict=True):
                b = (t or "").encode("utf-8", "surrogatepass")
                kept, gone, spans = b, 0, 0
                if packed is not None and len(packed):
                    pairs = [np.frombuffer(x, "<i8").reshape(2, -1) for x in packed]
                    start, end = union(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
                    gone, spans = int((end - start).sum()), len(start)
                    edges = [0, *np.stack((start, end), 1).ravel().tolist(), len(b)]
                    kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((None if pd.isna(i) else int(i), len(b), gone, spans, hashlib.sha256(kept).hexdigest(), *[kept] * keep))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            yield out

    return docs.join(ranges, ["id", "mark"], "left").select("id", "text", "ranges").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
