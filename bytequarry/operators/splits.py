"""Stratified splits and weighted draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _hash(c: str, seed: int):
    """A seeded number from 0 to 2**48 - 1, by a digest that other engines have too."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(c).cast("string")), 256), 1, 12), 16, 10).cast("long")


def quotas(counts: dict[tuple, int], folds: int) -> dict[tuple, list[int]]:
    """How many rows of each label combination go to each fold, by iterative stratification.

    Labels come from the rarest of what is left to the most common. Each combination that
    has the label is dealt evenly, and what remains goes, one by one, to the fold that
    still wants most of that label, then of rows at all (the least fold of equals). All
    labels of the rows dealt then want less. Rows without labels come last.
    """
    names = {x for c in counts for x in c}
    want = {x: [sum(n for c, n in counts.items() if x in c) / folds] * folds for x in names}
    rows = [sum(counts.values()) / folds] * folds
    left, out = dict(counts), {}

    def deal(combination: tuple, label) -> None:
        base, rest = divmod(left.pop(combination), folds)
        got = [base] * folds
        for _ in range(rest):
            f = max(range(folds), key=lambda f: ((want[label][f] if label is not None else 0) - got[f], rows[f] - got[f], -f))
            got[f] += 1
        for f in range(folds):
            rows[f] -= got[f]
            for x in combination:
                want[x][f] -= got[f]
        out[combination] = got

    while names:
        remaining = {x: sum(n for c, n in left.items() if x in c) for x in names}
        label = min(names, key=lambda x: (remaining[x], x))
        for c in sorted(c for c in left if label in c):
            deal(c, label)
        names.discard(label)
    for c in sorted(left):
        deal(c, None)
    return out


def stratified(labels: DataFrame, folds: int = 10, seed: int = 0) -> DataFrame:
    """``id, fold, split`` by iterative multilabel stratification of ``id, label_id, target``.

    Rows with the same labels are alike to the method, so it runs over the table of label
    combinations (bounded by the classes, not by the rows) and says how many rows of each
    go to each fold. Rows are ranked by a seeded hash within their combination: ranks come
    from windows over (combination, hash bucket) and a table of bucket counts, so no task
    sees a combination whole. Fold 0 is test, fold 1 validation.
    """
    rows = labels.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("target") == 1, F.col("label_id")))).alias("has"))
    rows = rows.withColumn("h", _hash("id", seed)).withColumn("b", F.col("h") % 64)
    counts = rows.groupBy("has", "b").agg(F.count("*").alias("n"))
    table = counts.groupBy("has").agg(F.sum("n").alias("n")).collect()
    dealt = quotas({tuple(r["has"]): r["n"] for r in table}, folds)
    ends = [(list(c), [sum(q[: f + 1]) for f in range(folds)]) for c, q in dealt.items()]
    if not ends:
        return labels.select("id", F.lit(0).alias("fold"), F.lit("").alias("split")).limit(0)
    kind = dict(rows.dtypes)["has"]
    ends = labels.sparkSession.createDataFrame(ends, f"has {kind}, ends array<long>")
    # 64 rows for each combination
    before = Window.partitionBy("has").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("has", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(ends, "has")
    rank = F.row_number().over(Window.partitionBy("has", "b").orderBy("h", "id"))
    placed = rows.withColumn("r", rank - 1).join(starts, ["has", "b"])
    fold = F.size(F.filter("ends", lambda e: e <= F.col("start") + F.col("r"))).cast("int")
    return placed.select("id", fold.alias("fold")).withColumn("split", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train"))


def weighted_draws(rows: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """``id, draws``: ``n`` draws with replacement (None: one for each row), by systematic points on the running sum of weights.

    A row's expected number of draws is its share of all weights times n. Running sums come
    from hash buckets and a window over the buckets' sums.
    """
    x = rows.withColumn("b", _hash("id", seed) % 256)
    sums = x.groupBy("b").agg(F.sum("weight").alias("s"), F.count("*").alias("c"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"start": F.coalesce(F.sum("s").over(before), F.lit(0.0)), "all": F.sum("s").over(Window.partitionBy()), "n": F.sum("c").over(Window.partitionBy()) if n is None else F.lit(n)}).drop("s", "c")
    upto = F.sum("weight").over(Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    y = x.select("id", "weight", "b").withColumn("u", upto).join(F.broadcast(sums), "b")
    # rounded, so that the order of summation does not matter
    point = lambda v: F.floor(F.round(v / F.col("all") * F.col("n"), 6) + 0.5)
    draws = point(F.col("start") + F.col("u")) - point(F.col("start") + F.col("u") - F.col("weight"))
    return y.select("id", draws.cast("int").alias("draws")).where("draws > 0")
