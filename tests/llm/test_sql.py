"""Queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from bytequarry.llm import queries


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, tables):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, tables), c.execute(queries.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_edges_equal_sql(name, spark, tmp_path):
    """Nulls, empty texts, ties and repeated rows give the same in both."""
    data = [(1, None, "a"), (2, "", "b"), (3, "x " * 40, None), (3, "x " * 40, None), (4, "a b c d e a b c d e f", "a"), (5, "été # \n\n \tnon\nnon\n", ""), (6, "w" * 5000, "b"), (7, "one", "a"), (8, "one", "a")]
    long = "a line that is long enough to count, and that five documents share"
    data += [(9 + i, f"{long}\n  {long.upper()}\t\nown {i}", "a" if i % 2 else "b") for i in range(11)] + [(30, long, "c")]
    langs = [None, "", "en", "de"]
    spark.createDataFrame([(i, t, s, langs[i % 4], "extra") for i, t, s in data], "doc_id long, text string, source string, lang string, size string").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, [((7 * i + k * k) % 23 - 11) / 16 for k in range(64)]) for i in range(14)]
    vectors += [(3, vectors[3][1]), (20, None), (21, [1.0] * 63), (22, [None] + [1.0] * 63), (23, [float("nan")] * 64), (24, [float("inf")] + [0.0] * 63), (25, [0.0] * 64), (26, [-0.0004] * 64)]
    spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, cluster string").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), c.execute(queries.ORACLES[name])
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), [x[0] for x in want.description])
