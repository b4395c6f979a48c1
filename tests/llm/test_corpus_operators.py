"""Deduplication, joins, mixing, packing, neighbours, classifier and the pipeline, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bytequarry.llm import ann, components, mixing, ngram_join, packing, quality_classifier, suffix_dedup


def brute_removed(rows, n=50):
    seen, out = set(), []
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for i in sorted(k for k in by_id if k is not None):
        own = set()
        for t in by_id[i]:
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for j in range(len(b) - n + 1):
                own.add(b[j : j + n])
                if b[j : j + n] in seen:
                    gone[j : j + n] = True
            spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        seen |= own
    out += [(None, len((t or "").encode()), 0, 0, hashlib.sha256((t or "").encode()).hexdigest()) for t in by_id.get(None, [])]
    return Counter(out)


def test_suffix_dedup(docs_of, prose):
    passage = prose(99, 40)
    rows = [(i, prose(i, 30) + " " + passage[i : i + 60 + i] + " " + prose(100 + i, 20)) for i in range(25)]
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "a" * 400), (53, "b" + "a" * 90), (54, None), (55, ""), (56, "short"), (57, "é" * 60), (58, "x" + "é" * 60)]
    rows += [(7, passage + " other text of the same id"), (7, passage + " other text of the same id"), (None, passage), (2, rows[0][1][:49])]
    got = suffix_dedup.dedup(docs_of(rows)).drop("kept")
    assert Counter(map(tuple, got.collect())) == brute_removed(rows)
    assert suffix_dedup.dedup(docs_of(rows).where("false")).isEmpty()


def test_suffix_sort_and_collisions():
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(600)) + b"a" * 200, np.uint8)
    pre = suffix_dedup.hashing.prefix(data)
    at = np.arange(len(data) - 50)
    got = suffix_dedup.Suffixes(data, pre).sort(at)
    raw = data.tobytes()
    assert [raw[i : i + 50] for i in got.tolist()] == sorted(raw[i : i + 50] for i in at.tolist())
    # stretches with one hash but different bytes stay apart
    same = np.zeros(3, np.uint64)
    settled, group = suffix_dedup._merge_equal(np.frombuffer(b"abcabdabc", np.uint8), np.asarray([0, 3, 6]), np.asarray([1, 1, 1]), same, np.asarray([1, 2, 3]), 3)
    assert settled.tolist() == [False, False, True] and group.tolist() == [0, 1, 0]


def test_lone_hashes_need_no_sorting():
    """The suffix sort over every start decides as it does over the starts whose hash is shared."""
    r = random.Random(4)
    for _ in range(20):
        texts = [bytes(r.choice(b"abc") for _ in range(r.randint(60, 200))) for _ in range(6)]
        texts += [texts[0][10:90] + texts[1][:70], texts[2]]
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum([0] + [len(t) for t in texts])[:-1]
        count = np.asarray([len(t) - 49 for t in texts])
        ids = np.arange(len(texts))
        some, all_ = (sorted(zip(*map(np.ndarray.tolist, suffix_dedup.removed(data, first, count, ids, every=e)), strict=True)) for e in (False, True))
        assert some == all_ and any(row[0] == 7 for row in some)


def test_suffix_dedup_of_very_long_texts(docs_of):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    long = "".join(r.choices(letters, k=2_500_000))
    tail = "".join(r.choices(letters, k=1_200_000))
    got = {x["doc_id"]: x for x in suffix_dedup.dedup(docs_of([(1, long), (2, tail[:100_000] + "#" + long[900_000:2_100_000] + "#" + tail[100_000:]), (3, "x" * 2_000_000)])).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_spans"], got[3]["n_removed"]) == (0, 1_200_000, 1, 0)
    assert got[2]["kept_sha256"] == hashlib.sha256((tail[:100_000] + "##" + tail[100_000:]).encode()).hexdigest()


def test_suspects_keep_columns_of_any_name(spark):
    from bytequarry.llm.shared import suspects

    names = ["id", "_byte", "_bit", "_hit", "_block", "_bits", "row", "at", "block", "byte", "hit", "a b"]
    df = spark.createDataFrame([tuple([i] + [f"{n}{i}" for n in names[1:]]) for i in range(200)], ", ".join(f"`{n}` {'long' if n == 'id' else 'string'}" for n in names))
    sure, maybe = suspects(df, "id", spark.createDataFrame([(5,), (7,)], "k long"), "k")
    assert sure.columns == maybe.columns == names
    assert sorted(map(tuple, sure.unionByName(maybe).collect())) == sorted(map(tuple, df.collect()))
    assert {5, 7} <= {x["id"] for x in maybe.collect()} and maybe.count() < 20


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=80):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t))
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            for s in sets[a]:
                for t in sets[b]:
                    both = len(s & t)
                    if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                        p, q = root(a), root(b)
                        top[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_ngram_join(docs_of, prose):
    r = random.Random(4)
    rows = []
    for base in range(6):
        words = prose(base, (6, 9, 15, 40, 90, 200)[base]).split()
        for k in range(8):
            w = list(words)
            for _ in range(k // 2):
                w[r.randrange(len(w))] = f"new{k}"
            rows.append((100 * base + k, " ".join(w)))
    chain = prose(77, 100).split()
    rows += [(900 + k, " ".join(chain[3 * k : 60 + 3 * k])) for k in range(8)]
    passage = prose(55, 60)
    rows += [(1000 + k, passage + " " + prose(2000 + k, 40)) for k in range(70)]
    rows += [(1, "One two"), (2, "one TWO"), (3, "one"), (4, None), (5, ""), (6, "é É"), (7, "É é"), (3, "one"), (None, "one two"), (1500, "a a a a a a a"), (1501, "a a a a a")]
    got = ngram_join.near_duplicates(docs_of(rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for x in got:
        if x["doc_id"] is not None:
            assert x["component_id"] == want[x["doc_id"]], x
    sizes = {(i, len(shingles(t))) for i, t in rows}
    assert {(x["doc_id"], x["n_shingles"]) for x in got} == sizes
    assert ngram_join.near_duplicates(docs_of(rows).where("false")).isEmpty()


def test_ngram_join_of_very_long_texts(docs_of):
    r = random.Random(9)
    words = [str(r.randrange(10**6)) for _ in range(250_000)]
    near = [w if i % 100 else "other" for i, w in enumerate(words)]
    far = [w if i % 12 else "other" for i, w in enumerate(words)]
    got = {x["doc_id"]: x for x in ngram_join.near_duplicates(docs_of([(3, " ".join(words)), (2, " ".join(near)), (1, " ".join(far)), (4, "w" * 3_000_000 + " b c d e"), (5, "w" * 2_999_999 + "v b c d e")])).collect()}
    assert {i: x["component_id"] for i, x in got.items()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    assert got[3]["n_shingles"] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_words_that_collide_modulo_2_to_the_64():
    """Thue-Morse strings have one polynomial hash modulo 2**64 whatever the base; as words they stay apart."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    h, bounds = ngram_join.shingle_sets([a + " x y z w", b + " x y z w", a + " x y z w"])
    assert len(h) == 3 and h[0] != h[1] and h[0] == h[2]


def test_clusters_in_several_blocks(docs_of, prose, monkeypatch):
    """Links inside a cluster are the same whether it is compared at once or in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "MAX_TURNS", 1)
    r = random.Random(10)
    rows = []
    for g in range(4):
        base = prose(400 + g, 120).split()
        for k in range(25):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = f"n{r.randrange(1000)}"
            rows.append((100 * g + k, " ".join(words)))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_components(rows)


def test_ids_with_several_sets(docs_of, prose):
    """Every set of an id is linked, whichever ids share it."""
    x, y, a, b, c = (prose(300 + k, 60) for k in range(5))
    near = lambda t: " ".join(t.split()[:-3])
    rows = [(3, x), (5, x), (5, y), (7, near(y)), (20, a), (21, b), (22, c), (30, a), (30, b), (30, c), (31, near(b)), (40, prose(310, 60)), (41, prose(311, 9))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_of(rows)).collect()}
    assert got == brute_components(rows)
    assert got[7] == 3 and got[31] == got[21] == got[22] == 20


@pytest.mark.parametrize("percent", [80])
def test_signatures_miss_no_pair(percent):
    """Every two similar sets share a signature after each leaves out its slack, whatever their sizes."""
    r, plan = np.random.default_rng(8), ngram_join.Plan(percent)
    for size in [*range(2, 40), 63, 64, 100, 333]:
        for _ in range(6):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            low = -(-len(a) * percent // 100)
            b = a[np.sort(r.permutation(len(a))[: r.integers(low, len(a) + 1)])]
            more = np.unique(np.concatenate((b, r.integers(0, 2**63, max(0, int(len(b) * 100 / percent) - len(a))).astype(np.uint64))))
            for c in (b, more):
                both = len(np.intersect1d(a, c))
                if 100 * both < percent * (len(a) + len(c) - both) or len(a) == len(c) == both:
                    continue
                sig, sets, mark = ngram_join.signatures(np.concatenate((a, c)), np.asarray([0, len(a), len(a) + len(c)]), plan)
                common = 0
                for side in (0, 1):
                    x, y = ({s for s, i, m in zip(sig.tolist(), sets.tolist(), mark.tolist(), strict=True) if i == k and m % 2 == side} for k in (0, 1))
                    left = max([m // 2 for m in mark[mark % 2 == side].tolist()], default=0)
                    common += len(x & y) > left
                assert common


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, 1000 + k) for k in range(50)] + [(2000 + k, 2001 + k) for k in range(40)] + [(5, 5), (1000, 1001)]
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in links:
        p, q = root(a), root(b)
        top[max(p, q)] = min(p, q)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in {x for ab in links if ab[0] != ab[1] for x in ab}}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_mixing_meets_targets(docs_of, prose):
    r = random.Random(6)
    rows = [(i, prose(i, r.randint(1, 40)), f"src{min(i % 7, 3)}") for i in range(2000)] + [(9000, None, "src0"), (9001, "", None)]
    out = mixing.copies(docs_of(rows)).collect()
    assert len(out) == len(rows)
    by = defaultdict(lambda: [0, 0.0])
    for x in out:
        assert 0 <= x["_m_copies"] <= 2
        by[x["source"]][0] += x["_m_copies"] * x["_m_size"]
        by[x["source"]][1] = x["_m_target"]
    for taken, target in by.values():
        assert abs(taken - target) <= 0.03 * target + 5
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(x["_m_size"] for x in out)) < 1e-6
    docs = docs_of(rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x["_m_copies"] for x in out)
    assert mixing.mix(docs.where("false")).isEmpty()


def test_packing_round_trip(docs_of, prose):
    from tokenizers import Tokenizer

    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, prose(i, n)) for i, n in enumerate([1, 5, 300, 900, 2500, 40, 40, 700])] + [(90, None), (91, ""), (92, "a <|endoftext|> b\n\n  c\t日本"), (92, "a"), (None, "x y")]
    got = packing.pack(docs_of(rows), **packing.default_vocabulary()).collect()
    want = Counter()
    for i, t in rows:
        ids = np.asarray([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)] += 1
    assert Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in got) == want
    windows = defaultdict(list)
    for x in got:
        windows[x["sequence_id"]].append((x["offset"], x["length"]))
    for w in windows.values():
        end = 0
        for offset, length in sorted(w):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(docs_of(rows).where("false"), **packing.default_vocabulary()).isEmpty()


@pytest.mark.parametrize("unit", [" ", "\n", "a", " a", "7", "é", "!\t"])
def test_very_long_texts_have_the_vocabulary_files_ids(unit):
    """Words and gaps too long for the rank form's pattern search still have the JSON form's ids."""
    enc = packing.encoder(**packing.default_vocabulary())
    for n in (1, 1000, 1_000_000):
        t = "x" + unit * n + " end<|endoftext|>"
        assert np.array_equal(enc(t), enc.exact(t))
    if unit == " ":
        assert len(enc(unit * 10_000_000)) == 10_000_000


def test_best_fit_is_tightest():
    r, fit, rooms = random.Random(9), packing.BestFit(64), []
    for _ in range(500):
        size = r.randint(1, 64)
        fits = [x for x in rooms if x[1] >= size]
        window, used = fit.place(size)
        if fits and size < 64:
            best = min(x[1] for x in fits)
            mine = next(x for x in rooms if x[0] == window)
            assert mine[1] == best and used == 64 - best
            mine[1] -= size
        else:
            assert used == 0
            rooms.append([window, 64 - size])


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(400)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [None] * 16, 0), (504, [float("inf")] * 16, 0), (3, [float(v) for v in x[3]], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for y in ann.nearest(df, "id % 10 = 0", k=20, shard=150).collect():
        got[y["query_id"]].append((y["rank"], y["vec_id"], y["score"]))
    d = x.astype(float)
    assert set(got) == set(range(0, 400, 10))
    hits = 0
    for q, found in got.items():
        s = d @ d[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)
    assert [f[1] for f in got[100]] == [*range(101, 121)]
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, score int")
    assert ann.nearest(few, "id = 0", k=20).count() == 3
    assert ann.nearest(few.where("false"), "id = 0").isEmpty()


def test_nearest_over_shards_and_blocks(spark):
    """Structureless and clustered vectors, several shards and blocks: recall of 0.9, exact scores."""
    r = np.random.default_rng(5)
    flat = r.standard_normal((3000, 32))
    tight = r.standard_normal((30, 32))[r.integers(0, 30, 3000)] + 0.2 * r.standard_normal((3000, 32))
    for x in (flat, tight):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        got = defaultdict(set)
        for y in ann.nearest(df, "id % 20 = 0", k=20, shard=800, block=60).collect():
            assert abs(y["score"] - x[y["query_id"]] @ x[y["vec_id"]]) < 1e-12
            got[y["query_id"]].add(y["vec_id"])
        score = x[::20] @ x.T
        score[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
        true = np.argsort(-score, axis=1)[:, :20]
        assert sum(len(got[20 * i] & set(t.tolist())) for i, t in enumerate(true)) >= 0.9 * true.size


def test_structure_needs_few_leaves():
    """Visits follow the data: clustered vectors are found in a small share of a forest, scattered ones in more."""
    r = np.random.default_rng(6)
    flat = r.standard_normal((8000, 64))
    tight = r.standard_normal((200, 64))[r.integers(0, 200, 8000)] + 0.2 * r.standard_normal((8000, 64))
    share = []
    for x in (flat, tight):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        forest = ann.Forest.grow(unit)
        assert forest.calibrate(unit, unit, 20) >= ann.RECALL
        share.append(forest.scanned(unit[:100]))
    assert share[1] < 0.2 < share[0] < 0.8


def test_priority_order_is_that_of_a_queue():
    """The leaves of a block of queries come in the order in which one heap over all trees would give them."""
    import heapq

    r = np.random.default_rng(7)
    x = r.standard_normal((600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest.grow(x, trees=4, leaf=40)
    order = forest.order(x[:20])
    for i, q in enumerate(x[:20].astype(np.float32)):
        heap, popped = [(0.0, t, 0, 0) for t in range(4)], []
        while heap:
            cost, t, level, j = heapq.heappop(heap)
            if 1 << level == forest.leaves:
                popped.append((cost, t * forest.leaves + j))
                continue
            node = (1 << level) - 1 + j
            m = float(q @ forest.planes[t, node] - forest.offsets[t, node])
            heapq.heappush(heap, (cost + max(m, 0.0) ** 2, t, level + 1, 2 * j))
            heapq.heappush(heap, (cost + min(m, 0.0) ** 2, t, level + 1, 2 * j + 1))
        cost_of = {leaf: c for c, leaf in popped}
        mine = [cost_of[leaf] for leaf in order[i].tolist()]
        assert len(mine) == len(popped) and all(b >= a - 1e-6 for a, b in zip(mine, mine[1:]))


def test_nearest_with_repeated_rows(spark):
    """Repeated rows of one id leave room for the other ids with the same vector."""
    x = np.random.default_rng(2).standard_normal((50, 8))
    x[10:40] = x[10]
    rows = [(i, [float(v) for v in x[i]]) for i in range(50)]
    got = ann.nearest(spark.createDataFrame(rows * 3, "vec_id long, embedding array<double>"), "id = 35", k=20).collect()
    assert [y["vec_id"] for y in sorted(got, key=lambda y: y["rank"])] == [*range(10, 30)]


def test_classifier_learns_and_reads_whole_texts(prose):
    good = [prose(i, 60) for i in range(60)]
    bad = [t.replace(" ", "### ") for t in good[:30]]
    net = quality_classifier.fit(good + bad, [1] * 60 + [0] * 30, epochs=8)
    fresh = [prose(1000 + i, 60) for i in range(20)]
    assert np.mean([net.score(t) > net.score(t.replace(" ", "### ")) for t in fresh]) >= 0.9
    # chunks do not change a score, and the end of a text counts
    long = " ".join(fresh * 40)
    whole = net.score(long)
    small, quality_classifier.CHUNK = quality_classifier.CHUNK, 256
    try:
        assert abs(net.score(long) - whole) < 1e-6
    finally:
        quality_classifier.CHUNK = small
    assert net.score(long + bad[0]) != whole
    assert 0 <= net.score(None) <= 1 and net.score("") == net.score(None)
    assert quality_classifier.fit(["a"], [1]) == 1.0 and quality_classifier.fit([], []) == 0.5


def test_classifier_on_held_out_documents(spark):
    """On the driver's tables: area under the curve and accuracy outside the rows that it learns from."""
    from bytequarry.llm import queries

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op2_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IN (0, 1)").collect()
    pairs = [(got[r["doc_id"]]["score"], r["quality"], got[r["doc_id"]]["predicted"]) for r in labels if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, y, _ in pairs if y == 1], [s for s, y, _ in pairs if y == 0]
    assert len(good) > 5 and len(bad) > 5
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum(y == p for _, y, p in pairs) / len(pairs)
    print("held-out area", area, "accuracy", right, "rows", len(pairs))
    assert area > 0.9 and right > 0.85


def test_classifier_sample_is_bounded(spark, docs_of):
    docs = docs_of([(i, "x" * (1000 * (i % 5 + 1))) for i in range(100)] + [(7, "again")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality_classifier.labelled(docs, labels)
    assert len(rows) > 50 and set(rows["label"]) == {0, 1}
    few = quality_classifier.labelled(docs, labels, max_bytes=20_000)
    assert 0 < few["text"].str.len().sum() <= 20_000 and few["text"].tolist() == rows["text"].tolist()[: len(few)]
    assert len(quality_classifier.labelled(docs, labels, bound=7)) <= 8
    assert quality_classifier.score(docs.where("false"), 0.5).isEmpty()


def test_classifier_sample_needs_no_scan_within_a_broadcast(spark):
    """Reading the texts may take longer than a broadcast may."""
    import time

    def slow(batches):
        time.sleep(3)
        yield from batches

    docs = spark.range(40, numPartitions=1).mapInPandas(slow, "id long").selectExpr("id AS doc_id", "repeat('x', 9) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.broadcastTimeout": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert len(quality_classifier.labelled(docs, labels)) > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_classifier_gradients(prose):
    net = quality_classifier.Network(3)
    xs, y = [quality_classifier.as_bytes(prose(i, 12)) for i in range(4)], np.asarray([1, 0, 1, 0], np.float32)

    def loss():
        z = np.asarray([net.head(net.pooled(x)[0][None])[2][0] for x in xs], float)
        return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z))

    g = net.gradients(xs, y)
    for name in ("out", "hid", "conv"):
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g[name].reshape(-1)))[:3].tolist():
            old, h = flat[i], 1e-2
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * h) - g[name].reshape(-1)[i]) < 0.15 * abs(g[name].reshape(-1)[i]) + 1e-3


def test_pipeline_stages(spark, docs_of, prose, tmp_path):
    r = random.Random(1)
    stop = "the of and to a in that is it for".split()
    text = lambda i: " ".join(r.choice(stop) if k % 3 == 0 else w for k, w in enumerate(prose(i, 60).split()))
    rows = [(i, text(i), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(10)] + [(200, "### " * 60, "s1"), (201, None, None), (202, "", None), (203, text(203) + " token = abcdef99", "s1"), (5, rows[5][1], "s2"), (None, text(300), "s2")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    clean = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert {x["doc_id"] for x in clean.collect()} == {x[0] for x in rows} - {200, 201, 202}
    one = corpus_pipeline.drop_near_duplicates(spark, clean, str(tmp_path))
    ids = Counter(x["doc_id"] for x in one.collect())
    assert set(ids) == {*range(60), 203, None} and max(ids.values()) == 1
    safe = corpus_pipeline.redact_secrets(spark, one, str(tmp_path))
    marked = {x["doc_id"]: x for x in safe.collect()}
    assert marked[203]["text"].endswith("<secret>") and marked[203]["n_chars"] == len(marked[203]["text"])
    assert sum(x["text"].endswith("<secret>") for x in marked.values()) == 1
    assert one.columns == safe.columns == docs.columns
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in pieces} <= set(ids)
    assert max(x["offset"] + x["length"] for x in pieces) <= 1024


def test_pipeline_on_an_empty_table_and_clashing_columns(spark, docs_of, prose, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).isEmpty()
    stop = "the of and to a in that is it for".split()
    text = lambda i: " ".join(stop[k % 10] if k % 3 == 0 else w for k, w in enumerate(prose(i, 60).split()))
    extra = ["_gone", "_n", "_row", "_before", "gone", "n", "row", "hash", "place", "id", "copy", "n_words", "kept", "_m_size", "_s_text", "_q_w", "a b"]
    docs = docs_of([(i, text(i % 20), f"s{i % 2}") for i in range(40)] + [(50, text(50) + " password = hunter2000", None)])
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in extra})
    want = {x["doc_id"]: x for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        for x in out.collect():
            assert all(x[c] == want[x["doc_id"]][c] for c in extra), name
        docs = out
