"""Centroid clustering, line deduplication and the source audit, against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytequarry.llm import centroids, line_dedup, source_divergence


def brute_clusters(rows, k, rounds, dim, scale=1024.0, seed="3"):
    """(id, cluster, distance, cluster's inertia, inertia, centroid) by Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v):
            kept.append((i, [math.floor(x * scale) for x in v], [x * scale for x in v]))
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v, _ in sorted(kept, key=lambda x: (name(x[0]), x[2]))[:k]]

    def assign():
        out = []
        for _, v, _ in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            if own := [v for (_, v, _), (a, _) in zip(kept, at, strict=True) if a == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    total = [sum(d for a, d in at if a == j) for j in range(len(c))]
    long = lambda v: v if v < 1 << 63 else None
    return Counter((i, a, long(d), long(total[a]), long(sum(total)), ",".join(map(str, c[a]))) for (i, _, _), (a, d) in zip(kept, at, strict=True))


@pytest.mark.parametrize(("dim", "k", "size"), [(4, 3, 1.0), (4, 3, 3e3), (4, 2, 1e6), (3, 8, 1e25), (2, 5, 5e-4)])
def test_clusters_by_brute_force(spark, dim, k, size):
    """Small numbers go through float64, larger ones through 64-bit and Python integers, mixed ones through all."""
    r = random.Random(int(size) + dim)
    rows = [(i, [r.uniform(-size, size) for _ in range(dim)]) for i in range(60)]
    rows += [(100 + i, [r.uniform(-1, 1) for _ in range(dim)]) for i in range(20)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    rows += [(200, None), (201, [1.0] * (dim + 1)), (202, []), (203, [None] + [1.0] * (dim - 1)), (204, [float("nan")] + [1.0] * (dim - 1)), (205, [float("-inf")] + [1.0] * (dim - 1)), (206, [1e308] * dim)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, n string").repartition(3)
    got = centroids.cluster(df, k=k, rounds=4, dim=dim)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, k, 4, dim)


def test_clusters_of_few_and_no_rows(spark):
    kind = "vec_id string, embedding array<float>"
    rows = [("a", [0.5, -0.25]), ("b", [0.5, -0.25])]
    got = centroids.cluster(spark.createDataFrame(rows, kind), k=8, dim=2)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, 8, 10, 2)
    assert centroids.cluster(spark.createDataFrame([], kind)).isEmpty()


def test_expansion_is_exact_at_its_bounds():
    """Around the largest numbers that each kind of arithmetic may take, distances equal those of Python integers."""
    r = np.random.default_rng(4)
    for top in (1 << 20, (1 << 23) - 1, 1 << 24, 1 << 28, 1 << 30, 1 << 40):
        x = np.floor(r.uniform(-top, top, (40, 64)))
        c = [[int(v) for v in np.floor(r.uniform(-top, top, 64))] for _ in range(3)]
        at, dist = centroids.nearest(x, c)
        for row, a, d in zip(x, at, dist, strict=True):
            want = [sum((int(u) - v) ** 2 for u, v in zip(row, w, strict=True)) for w in c]
            assert (int(a), int(d)) == (want.index(min(want)), min(want))


def brute_lines(rows, least=40, docs=5):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\v\f\r").translate(upper)
    order = lambda i: (i is not None, i or 0)  # noqa: E731  a null id is the smallest
    held, last = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            last[k] = max(last.get(k, i), i, key=order)
    out = Counter()
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < least or held[key(x)] < docs or last[key(x)] == i]
        out[i, len(all_), len(all_) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines_by_brute_force(docs_of, prose):
    shared = [prose(i, 12)[:60] + f" line {i}" for i in range(12)]
    r = random.Random(2)
    rows = []
    for i in range(120):
        own = [prose(1000 + i * 10 + k, 9) for k in range(r.randint(0, 4))]
        both = own + [r.choice((str.upper, str.lower, str.title))(r.choice(shared)) + r.choice(("", "  ", "\t", "\r")) for _ in range(r.randint(0, 5))]
        r.shuffle(both)
        rows.append((i, "\n".join(both)))
    rows += [(7, rows[7][1]), (7, shared[0] + "\n" + shared[1]), (7, "other\n" + shared[0]), (None, shared[2]), (None, "\n".join(shared))]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "É" * 40), (504, "é" * 40), *[(505 + i, "É" * 40 + "\nend") for i in range(5)], (520, "x" * 39)]
    rows += [(600 + i, "a line that only rows without a larger id share, forty code points") for i in range(4)]
    got = line_dedup.dedup(docs_of(rows).select("doc_id", "text"))
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect())) == brute_lines(rows)


def test_lines_held_by_rows_without_id(docs_of):
    line = "a line that is long enough to count as one that is shared"
    rows = [(None, line)] * 5 + [(None, line + "\n" + line)]
    got = line_dedup.dedup(docs_of(rows).select("doc_id", "text"))
    assert Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect())) == brute_lines(rows)


def test_lines_of_clashing_columns_and_an_empty_table(docs_of):
    line = "Some Line That Very Many Documents Hold, Long Enough To Go"
    docs = docs_of([(i, f"{line}\nown {i}") for i in range(6)])
    extra = ["row", "id", "print", "batch", "h1", "h2", "n", "holder", "table", "slot", "lost_id", "a b"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in extra})
    got = line_dedup.dedup(docs).collect()
    assert all(x[c] == f"{c}{x['doc_id']}" for x in got for c in extra)
    assert {x["doc_id"]: x["n_dropped"] for x in got} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}
    assert line_dedup.dedup(docs.where("false")).isEmpty()


def test_a_text_of_very_many_shared_lines(docs_of):
    """Looking lines up does not grow with the number of lines to drop: 30,000 of 30,001 go in each of five long texts."""
    many = "\n".join(f"a shared line with a number, which is long enough: {i}" for i in range(30_000))
    rows = [(i, many + f"\nown {i}") for i in range(6)]
    got = {x["doc_id"]: x for x in line_dedup.dedup(docs_of(rows).select("doc_id", "text")).collect()}
    assert [got[i]["n_dropped"] for i in range(6)] == [30_000] * 5 + [0]
    assert all(got[i]["kept_text"] == f"own {i}" for i in range(5))


def test_runs_are_levelled_and_disjoint_in_holders(spark):
    """After b batches there is a run for each binary digit of b; a key has one holder, the largest id, however many batches hold it."""
    index, r, seen = line_dedup.LineRuns(spark), random.Random(3), defaultdict(list)
    for b in range(7):
        rows = [(r.randrange(40), 1, 1000 - 100 * b - r.randrange(50)) for _ in range(60)]
        for h, _, i in rows:
            seen[h].append(i)
        index.add(spark.createDataFrame(rows, "h1 long, h2 long, id long"))
        assert [k for k, run in enumerate(index.levels) if run is not None] == [k for k in range(4) if (b + 1) >> k & 1]
    got = {x["h1"]: (x["n"], x["holder"]) for x in index.whole().collect()}
    assert got == {h: (len(v), max(v)) for h, v in seen.items()}
    assert len(index.runs) == 1


def brute_audit(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def terms(t):
        out, word = [], ""
        for c in (t or "").translate(lower) + " ":
            if c.isascii() and not c.isalpha():
                out += [word] if word else []
                word = ""
            else:
                word += c
        return out

    held, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        lang, source, own = lang or "", source or "", terms(text)
        counts[lang][source].update(own)
        held[lang].update(set(own))
    out = Counter()
    for lang, sources in counts.items():
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=lambda t: t.encode())
        whole = sum(sources.values(), Counter())

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in sources.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in sources.items():
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in sources if o != s]
            best = [(t, f(ps[s][t], q[t])) for t in kept if c[t] > 0 and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", best, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out.update((lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked))
    return out


def audit_rows(prose):
    r = random.Random(9)
    words = [w for i in range(6) for w in prose(i, 15).split()] + ["Zürich", "ZÜRICH", "zürich", "日本", "ab", "AB", "a1b", "x_y", "été"]
    rows = []
    for i in range(150):
        lang = ("en", "de", None)[i % 3]
        source = ("s1", "s2", "Ä", None, "s10")[r.randrange(5)]
        rows.append((" ".join(r.choice(words[(i % 5) * 5 :]) for _ in range(r.randint(0, 30))), lang, source))
    return [*rows, (None, "en", "void"), ("", "xx", "only"), ("1 2 3 ...", "xx", "other"), ("rare words here", "fr", "a"), ("none of them", "fr", "b"), rows[0], rows[0]]


@pytest.mark.parametrize("limits", [None, (64, 40, 30), (7, 3, 2)])
def test_audit_by_brute_force(spark, prose, monkeypatch, limits):
    """Slices, buffers and chunks of any size give the same."""
    if limits:
        for name, value in zip(("SLICE", "ROWS", "CELLS"), limits, strict=True):
            monkeypatch.setattr(source_divergence, name, value)
    rows = audit_rows(prose)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "text string, lang string, source string, term string, n string").repartition(3)
    got = source_divergence.audit(df, min_docs=4, top=3)
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(rows, 4, 3)


def test_audit_of_long_texts_and_no_rows(spark):
    kind = "text string, lang string, source string"
    rows = [("word other " * 200_000, "en", "a")] + [("word thing", "en", "b")] * 12
    got = source_divergence.audit(spark.createDataFrame(rows, kind))
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(rows, 10, 10)
    assert source_divergence.audit(spark.createDataFrame([], kind)).isEmpty()


def test_shares_are_exact_for_large_counts():
    r = random.Random(1)
    for _ in range(200):
        n, kept = r.randrange(1, 9 * 10**15), r.randrange(1, 10**6)
        count = r.randrange(0, n)
        assert int(source_divergence.share(np.array([count]), n, kept)[0]) == 1 + 10**9 * (count + 2) // (n + 2 * kept)
