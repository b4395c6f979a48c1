"""How far the sources of a language differ in their use of terms, in exact integers.

Texts become integers early: inside a task, the terms of a slice of texts are cut out of
their bytes by array operations and dictionary-encoded, so that counts by source are
``bincount`` over small integers. Counts of (language, source, term) then meet once in
range partitions, that is in UTF-8 order of terms. There, the terms that enough documents
have form sorted arrays; counts find their ids in them by ``searchsorted`` and become dense
vectors, one for each source of a chunk of consecutive ids. As ids have the order of terms,
ties are broken by position. A chunk with its vectors is one row of a written table, from
which all that follows is computed chunk by chunk and summed.

Of a term with ``count`` occurrences in a group of N (over the V kept terms of its
language), ``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``; of a pair of numbers,
``f = floor((p - q)**2 / (p + q))``. Part ``pair`` lists, for each source, every other one
with f summed over all kept terms; part ``term`` the kept terms that a source has and uses
more than its language does, with the ten largest f.

Defined cases: null text, language or source count as ''. Rows are documents, whatever
their ids, so repeated rows count each time. Groups without any term take part in pairs;
where a language keeps no term, f is 0. Texts are taken whole, however long; an empty
table gives an empty result; other columns are left out. The sources of one language are
held as one list in a task: the result has a row for each pair of them anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.shared import cut

#: Bytes of text encoded at a time, rows held to cut chunks from, and cells (terms times sources) of a chunk.
SLICE, ROWS, CELLS = 4 << 20, 1 << 16, 1 << 17
#: Each byte in lower case; bytes that end a term are 0.
TERM_BYTES = np.zeros(256, np.uint8)
TERM_BYTES[128:] = np.arange(128, 256)
TERM_BYTES[97:123] = TERM_BYTES[65:91] = np.arange(97, 123)

COUNTS = "lang string, source string, term string, n long, docs long"


def cut_terms(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie one after the other in ``data``, with a byte between two, and the text of each.

    ``ends`` are the places of those bytes, one after each text.
    """
    low = TERM_BYTES[data]
    low[ends] = 0
    inside = low != 0
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    return terms, np.searchsorted(ends, starts, side="right")


def count_slice(texts: list[bytes], group: np.ndarray, groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with their group numbers: distinct terms, and for each (group, term) that occurs its two numbers, occurrences and texts."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    terms, text = cut_terms(data, ends)
    coded = terms.dictionary_encode()
    ids, size = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    seen, n = np.unique(text * size + ids, return_counts=True)
    cell = group[seen // size] * size + seen % size
    if groups * size <= 4 * len(seen) + 1024:
        occurrences = np.bincount(cell, n, groups * size).astype(np.int64)
        docs = np.bincount(cell, minlength=groups * size)
        found = np.flatnonzero(docs)
        return coded.dictionary, found // size, found % size, occurrences[found], docs[found]
    found, at = np.unique(cell, return_inverse=True)
    return coded.dictionary, found // size, found % size, np.bincount(at, n).astype(np.int64), np.bincount(at)


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group.

    Each group also has a row with the term '', and zeros.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            for start, stop in stretches(np.cumsum(sizes) // SLICE):
                langs, sources = (batch.column(c).slice(start, stop - start).dictionary_encode() for c in ("lang", "source"))
                code = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                known, group = np.unique(code, return_inverse=True)
                named = [langs.dictionary.take(pa.array(known // len(sources.dictionary))), sources.dictionary.take(pa.array(known % len(sources.dictionary)))]
                terms, g, t, n, docs = count_slice([x.as_py().encode() for x in texts.slice(start, stop - start)], group, len(known))
                none = pa.array([0] * len(known), pa.int64())
                yield pa.RecordBatch.from_arrays([*named, pa.array([""] * len(known)), none, none], ["lang", "source", "term", "n", "docs"])
                counted = [*[x.take(pa.array(g)) for x in named], terms.cast(pa.string()).take(pa.array(t)), pa.array(n), pa.array(docs, pa.int64())]
                yield pa.RecordBatch.from_arrays(counted, ["lang", "source", "term", "n", "docs"])

    blank = lambda c, name: F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name)
    each = df.select(blank(text, "text"), blank(lang, "lang"), blank(source, "source")).mapInArrow(count, COUNTS)
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def stretches(marks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of stretches of equal marks."""
    bounds = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
    return ((a, b) for a, b in zip(bounds, bounds[1:], strict=False) if a < b)


CHUNKS = "lang string, terms array<string>, sources array<string>, totals array<long>, counts binary"


def dense(lang: str, rows: pa.RecordBatch, min_docs: int) -> pa.RecordBatch | None:
    """One chunk of sorted rows of a language, all of each term: kept terms, sources, and counts source by source."""
    term, source = rows.column("term").dictionary_encode(), rows.column("source").dictionary_encode()
    size, width = len(term.dictionary), len(source.dictionary)
    known = np.flatnonzero(np.bincount(term.indices.to_numpy(), rows.column("docs").to_numpy(), size) >= min_docs)
    if not len(known):
        return None
    place = np.searchsorted(known, term.indices.to_numpy())  # rows are sorted, so the order of first places is that of terms
    kept = known[np.minimum(place, len(known) - 1)] == term.indices.to_numpy()
    cell = source.indices.to_numpy().astype(np.int64)[kept] * len(known) + place[kept]
    counts = np.bincount(cell, rows.column("n").to_numpy()[kept], width * len(known)).astype(np.int64).reshape(width, -1)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    held = [pa.array([lang]), one(term.dictionary.take(pa.array(known))), one(source.dictionary), one(pa.array(counts.sum(axis=1))), pa.array([counts.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(held, ["lang", "terms", "sources", "totals", "counts"])


def chunks(counts: DataFrame, min_docs: int) -> DataFrame:
    """Kept terms in order, with a dense vector of counts for each source that has one of them.

    One range shuffle brings all counts of a term together, in order of language and term.
    """
    ordered = counts.where("term <> ''").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            if rest.num_rows >= ROWS:  # all but the last term is complete
                *_, (last, _) = stretches(rest.column("term").dictionary_encode().indices.to_numpy())
                yield from parts(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None:
            yield from parts(rest)

    def parts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs = rows.column("lang").dictionary_encode()
        for start, stop in stretches(langs.indices.to_numpy()):
            own = rows.slice(start, stop - start)
            ids = own.column("term").dictionary_encode().indices.to_numpy()
            terms = max(1, CELLS // len(own.column("source").unique()))
            for a, b in stretches(ids // terms):
                if (chunk := dense(langs.dictionary[int(langs.indices[start].as_py())].as_py(), own.slice(a, b - a), min_docs)) is not None:
                    yield chunk

    return ordered.select("lang", "term", "source", "n", "docs").mapInArrow(pack, CHUNKS)


def share(count: np.ndarray, n: np.ndarray | int, kept: int) -> np.ndarray:
    """``1 + floor(10**9 * (count + 2) / (n + 2 * kept))``, by long division in three digits of 1000, which 64 bits hold for any ``n`` below 9 * 10**15."""
    divisor = np.asarray(n, np.int64) + 2 * kept
    rest, out = np.asarray(count, np.int64) + 2, np.int64(0)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, divisor)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


#: Partial sums of pairs (each once, in order of names) and each source's best terms of a chunk.
FOUND = "lang string, source string, part string, item string, value long"


def compare(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`FOUND` for chunks with the ``members`` (source, n) of their language, in order, and its number of kept terms."""
    for batch in batches:
        for row in batch.to_pylist():
            names, n = [m["source"] for m in row["members"]], np.array([m["n"] for m in row["members"]], np.int64)
            terms, at = row["terms"], {s: i for i, s in enumerate(names)}
            counts = np.zeros((len(names), len(terms)), np.int64)
            seen = [at[s] for s in row["sources"]]
            counts[seen] = np.frombuffer(row["counts"], np.int64).reshape(len(seen), len(terms))
            p = share(counts, n[:, None], row["kept"]) if terms else counts
            q = share(counts.sum(axis=0), n.sum(), row["kept"]) if terms else counts.sum(axis=0)
            found = []
            for i, name in enumerate(names[:-1]):
                sums = apart(p[i + 1 :], p[i]).sum(axis=1).tolist() if terms else [0] * (len(names) - i - 1)
                found.append(([name] * len(sums), "pair", names[i + 1 :], sums))
            for i in seen:
                more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                f = apart(p[i][more], q[more])
                best = np.argsort(-f, kind="stable")[:top]  # of equal ones the smaller id, that is the smaller term
                found.append(([names[i]] * len(best), "term", [terms[k] for k in more[best]], f[best].tolist()))
            for source, part, item, value in found:
                if source:
                    columns = [pa.array([row["lang"]] * len(source)), pa.array(source), pa.array([part] * len(source)), pa.array(item), pa.array(value, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: parts ``pair`` and ``term`` of every group, see above."""
    counts = cut(term_counts(df, text, lang, source), "term-counts")
    packed = cut(chunks(counts, min_docs), "term-chunks")
    each = packed.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.totals").alias("n"))
    totals = counts.where("term = ''").select("lang", "source", "n").unionByName(each).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = packed.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    members = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("members"))
    langs = cut(members.join(kept, "lang", "left").fillna(0, ["kept"]), "languages")
    bare = langs.where("kept = 0").select("lang", *[F.array().cast(t).alias(c) for c, t in (("terms", "array<string>"), ("sources", "array<string>"))], F.array().cast("array<long>").alias("totals"), F.lit(b"").alias("counts"))
    found = packed.unionByName(bare).drop("totals").join(langs, "lang").mapInArrow(lambda batches: compare(batches, top), FOUND)
    found = cut(found, "divergence-parts")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    other = sums.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = sums.unionByName(other).withColumn("rank", rank)
    return pairs.unionByName(found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top))
