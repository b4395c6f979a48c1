"""Dropping lines that many documents share, against levelled sorted runs of line hashes.

:class:`LineRuns` is the index of all lines seen so far. A run is a table of line hashes,
bucketed and sorted by them. Each new batch of documents is reduced to its distinct lines
with a count and the largest id that holds them; a merge anti-join with every run tells the
lines that are new, which get that id as their holder, and the rest only add to the count.
The batch becomes a run of the lowest level; where a level has one already, both are
compacted into a run of the next, so a hash is rewritten once a level, and of b batches
there are at most log2(b) + 1 runs to join. As runs and batches are bucketed alike, no join
moves a run.

Batches come in descending order of ids, so a line's first batch holds its largest id.
:func:`dedup` deals a whole table that way: lines are hashed once, written in order of ids,
and then enter the index batch by batch; rows are counted before any shuffle, so a line of
a third of all documents is a few rows of one key.

Keys are told apart by 128 bits of hash, unverified.

Defined cases: a null or empty text is one empty line. A row is a document, whatever its id:
rows with equal ids count as many documents, and all rows of the largest id keep a shared
line. A null id is smaller than every other; lines that only rows without id hold stay.
Within the largest document all copies of a line stay. Texts are taken whole, however long.
An empty table gives an empty result. Columns other than id and text are kept as they are,
whatever their names; only ``n_lines``, ``n_dropped`` and ``kept_text`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm.shared import cut, drop, suspects

#: ASCII white space, and the letters that are lower-cased.
SPACE, UPPER = " \t\n\v\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Batches at least, and documents of a batch from which there are more.
BATCHES, BATCH_ROWS = 5, 500_000_000
#: A key with more than one in so many lines is joined by broadcast; there are at most as many such keys.
HOT = 1000
KEY = ("h1", "h2")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.btrim(line, F.lit(SPACE))


def lowered(line: Column) -> Column:
    """A-Z in lower case; ``lower`` is faster, but changes other letters too where there are some."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, UPPER.lower()))


def digest(key: Column) -> list[Column]:
    """128 bits of a key as two hashes with different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(12), key).alias("h2")]


def keys(text: Column, min_length: int) -> Column:
    """The distinct keys of a text's lines, without those that are too short."""
    long = F.filter(F.transform(lines(text), bare), lambda x: F.char_length(x) >= min_length)
    return F.array_distinct(F.transform(long, lowered))


class LineRuns:
    """An index of line hashes as levelled sorted runs in the shared folder: level k holds a run of 2**k batches or none."""

    def __init__(self, spark: SparkSession):
        self.levels: list[DataFrame | None] = []
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))

    @property
    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def _write(self, rows: DataFrame) -> DataFrame:
        return cut(rows, "line-run", self.buckets, KEY)

    def add(self, batch: DataFrame) -> None:
        """Takes a batch of ``h1, h2, id``, one row for each line of a document.

        Its run has ``h1, h2, n, holder``: how many of the batch's documents have the line,
        and the largest id among them if no run knows the line.
        """
        own = batch.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("top"))
        fresh = own.select(*KEY)
        for run in self.runs:
            fresh = fresh.join(run.select(*KEY).hint("merge"), list(KEY), "left_anti")
        told = own.withColumn("new", F.lit(True))
        if self.runs:
            told = own.join(fresh.withColumn("new", F.lit(True)).hint("merge"), list(KEY), "left")
        self._place(self._write(told.select(*KEY, "n", F.when(F.col("new"), F.col("top")).alias("holder"))))

    def _place(self, run: DataFrame) -> None:
        """Puts a run into the lowest level that is free, compacted with all runs of the levels below."""
        for k, older in enumerate(self.levels):
            self.levels[k] = None
            if older is None:
                self.levels[k] = run
                return
            run = self._compacted(older, run)
        self.levels.append(run)

    def _compacted(self, older: DataFrame, newer: DataFrame) -> DataFrame:
        """Two runs as one, by a merge join of their buckets, for which no row moves."""
        both = older.alias("a").join(newer.alias("b").hint("merge"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        run = self._write(both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in KEY], n.alias("n"), F.coalesce("a.holder", "b.holder").alias("holder")))
        drop(older, newer)
        return run

    def whole(self) -> DataFrame:
        """All runs compacted into one: ``h1, h2, n, holder``."""
        run, *rest = self.runs
        for older in rest:
            run = self._compacted(older, run)
        self.levels = [*[None] * (len(self.levels) - 1), run]
        return run


def batches_by_id(ids: DataFrame, count: int) -> Column:
    """A column of batch numbers below ``count`` by ``id``, in descending order of ids, with about as many rows each.

    Only bounds, one row a batch, come to the driver. All rows of one id are in one batch,
    rows without an id in the last.
    """
    dealt = ids.where("id IS NOT NULL").repartitionByRange(count, F.col("id").desc())
    parts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"), F.count("*").alias("n")).orderBy("p").collect()
    place, total, seen = F.lit(0), sum(r["n"] for r in parts), 0
    for r in parts:
        before, seen = seen * count // total, seen + r["n"]
        if (after := min(seen * count // total, count - 1)) > before:
            place = F.when(F.col("id") < F.lit(r["low"]), after).otherwise(place)
    return F.when(F.col("id").isNull(), count - 1).otherwise(place)


def lookup(gone: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``(*by, table)`` for rows ``(*by, h1, h2)``: a hash table, as an array of as many short lists as there are keys.

    :func:`is_in` looks a key up in constant time, which a scan of one list would not for
    texts of very many lines.
    """
    keys = gone.distinct()
    slots = keys.groupBy(*by).agg(F.count("*").alias("slots"))
    join = F.expr(" AND ".join(f"a.`{c}` <=> b.`{c}`" for c in by))
    placed = keys.alias("a").join(slots.alias("b"), join).select(*[f"a.{c}" for c in by], F.expr("pmod(h1, slots)").alias("slot"), F.concat_ws(" ", *KEY).alias("name"))
    empty = slots.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("string").alias("name"))
    filled = placed.unionByName(empty).groupBy(*by, "slot").agg(F.collect_list("name").alias("names"))
    return filled.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slot", "names"))).alias("table"))


def is_in(table: Column, key: Column) -> Column:
    h1, h2 = digest(key)
    slot = F.get(table, F.pmod(h1, F.size(table).cast("long")).cast("int"))
    return F.array_contains(slot["names"], F.concat_ws(" ", h1, h2))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 40, min_docs: int = 5, batches: int | None = None) -> DataFrame:
    """``df`` with ``n_lines, n_dropped, kept_text``.

    Lines whose key has at least ``min_length`` code points and is in at least ``min_docs``
    documents go, except in the document of largest id that holds them.
    """
    added = ["n_lines", "n_dropped", "kept_text"]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    docs = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), whole.alias("row"))
    print_ = F.xxhash64("text").alias("print")
    count = batches or max(BATCHES, -(-df.count() // BATCH_ROWS))
    number = batches_by_id(docs.select("id"), count)
    found = docs.select("id", print_, number.cast("int").alias("batch"), F.explode(keys(F.col("text"), min_length)).alias("key"))
    held = cut(found.select("id", "print", "batch", *digest(F.col("key"))).sortWithinPartitions("batch"), "lines")
    index = LineRuns(df.sparkSession)
    for b in range(count):
        index.add(held.where(F.col("batch") == b).select(*KEY, "id"))
    frequent = cut(index.whole().where(F.col("n") >= min_docs), "frequent-lines")
    drop(*index.runs)
    often = F.col("n") > held.count() / HOT
    parts = [held.join(F.broadcast(frequent.where(often)), list(KEY)), held.join(frequent.where(~often).hint("merge"), list(KEY))]
    gone = parts[0].unionByName(parts[1]).where("NOT (id <=> holder)")
    lost = cut(lookup(gone.select("id", "print", *KEY), ("id", "print")), "lost-lines")
    sure, maybe = suspects(docs, "id", lost, "id")
    split = lines(F.col("text"))
    untouched = sure.select("row", F.size(split).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text"))
    asked, lost = maybe.withColumn("print", print_), lost.select(F.col("id").alias("lost_id"), F.col("print").alias("lost_print"), "table")
    met = asked.join(lost, F.expr("id <=> lost_id AND print = lost_print"), "left")
    stays = lambda x: (F.char_length(bare(x)) < min_length) | ~is_in(F.col("table"), lowered(bare(x)))
    kept = F.when(F.col("table").isNull(), split).otherwise(F.filter(split, stays))
    touched = met.select("row", F.size(split).cast("long").alias("n_lines"), kept.alias("kept"))
    touched = touched.select("row", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
    return untouched.unionByName(touched).select("row.*", *added)
