"""Features over opcode sequences and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions.evm import CALLS, instruction_set
from bytequarry.functions.text import ratio
from bytequarry.operators.steps import written

ARITHMETIC = ("ADD", "MUL", "SUB", "DIV")
RANDOMNESS = ("BLOCKHASH", "TIMESTAMP", "COINBASE", "NUMBER")
LOGS = ("LOG0", "LOG1", "LOG2", "LOG3", "LOG4")
#: Opcodes whose count is a feature of its own.
COUNTED = (*CALLS, *ARITHMETIC, "ORIGIN", "CALLER", "CALLVALUE", *RANDOMNESS, "GAS", "GASLIMIT", "JUMPI", "JUMP", "BALANCE", "SELFBALANCE", "EXTCODESIZE", "EXTCODECOPY", "EXTCODEHASH", "CODESIZE", "INVALID", "SELFDESTRUCT", "CREATE", "CREATE2", "SSTORE", "SLOAD", "KECCAK256")


def opcode_text(ins: DataFrame) -> DataFrame:
    """Opcode names of each code in order, as an array and joined by spaces."""
    rows = ins.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("pc", "opcode"))).alias("r"))
    return rows.select("fp", F.transform("r", lambda x: x["opcode"]).alias("tokens")).withColumn("opcode_text", F.array_join("tokens", " "))


def token_cascade(contracts: DataFrame, sequences: DataFrame, nodes: DataFrame) -> DataFrame:
    """``fp, tokens, origin`` of each contract: its stored sequence if it has one, else its nodes' opcodes by pc, else none.

    ``sequences`` has ``fp, tokens``; ``nodes`` has ``fp, pc, opcode``.
    """
    stored = sequences.where(F.size("tokens") > 0).select("fp", F.col("tokens").alias("stored"))
    by_node = opcode_text(nodes).select("fp", F.col("tokens").alias("by_node"))
    j = contracts.join(stored, "fp", "left").join(by_node, "fp", "left")
    origin = F.when(F.col("stored").isNotNull(), "opcode_sequence").when(F.col("by_node").isNotNull(), "node_table").otherwise("")
    return j.select("fp", F.coalesce("stored", "by_node", F.array().cast("array<string>")).alias("tokens"), origin.alias("origin"))


def _count(*names: str) -> Column:
    return F.count_if(F.col("opcode").isin(*names))


def call_ratios(ins: DataFrame) -> DataFrame:
    """Calls and delegate calls of each code, as counts and shares."""
    n = ins.groupBy("fp").agg(F.count("*").alias("opcode_count"), _count(*CALLS).alias("call_like_count"), _count("DELEGATECALL").alias("delegatecall_count"))
    share = lambda c: F.round(ratio(F.col(c), F.col("opcode_count")), 6)
    return n.withColumns({"call_like_ratio": share("call_like_count"), "delegatecall_ratio": share("delegatecall_count")})


def pattern_features(ins: DataFrame) -> DataFrame:
    """Counts, shares and ordered patterns of opcodes, as ``pat_`` columns in order of name.

    One aggregate by code gives all counts and the text that the ordered patterns are
    looked for in.
    """
    single = {f"{c.lower()}_count": _count(c) for c in COUNTED}
    sums = {"external_call_total": CALLS, "arithmetic_total": ARITHMETIC, "randomness_source_total": RANDOMNESS, "log_total": LOGS}
    g = ins.groupBy("fp").agg(
        *[v.cast("double").alias(k) for k, v in single.items()], *[_count(*v).cast("double").alias(k) for k, v in sums.items()],
        F.count("*").cast("double").alias("total_opcodes"), F.count_distinct("opcode").cast("double").alias("unique_opcodes"),
        F.sort_array(F.collect_list(F.struct("pc", "opcode"))).alias("r"),
    )
    g = g.withColumn("opcode_text", F.array_join(F.transform("r", lambda x: x["opcode"]), " ")).drop("r")
    n = F.greatest("total_opcodes", F.lit(1.0))
    found = lambda k, p: F.regexp_count(F.substring("opcode_text", 1, k), F.lit(p)).cast("double")
    more = {
        "external_call_ratio": F.col("external_call_total") / n, "arithmetic_ratio": F.col("arithmetic_total") / n,
        "call_then_sstore": found(50_000, r"CALL\b.*?\bSSTORE"), "add_then_lt": found(50_000, r"ADD\b[^S]*?\bLT"),
        "call_then_pop": F.regexp_count("opcode_text", F.lit(r"\bCALL POP\b")).cast("double"), "origin_eq": found(20_000, r"ORIGIN\b.*?\bEQ"),
        "has_origin": (F.col("origin_count") > 0).cast("double"), "origin_without_caller": ((F.col("origin_count") > 0) & (F.col("caller_count") == 0)).cast("double"),
        "loop_density": F.col("jumpi_count") / n, "storage_ratio": (F.col("sstore_count") + F.col("sload_count")) / n,
    }
    g = g.withColumns(more).drop("opcode_text")
    return g.select("fp", *[F.col(c).alias(f"pat_{c}") for c in sorted(set(g.columns) - {"fp"})])


def graph_features(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """The 19 graph-level features of each contract (doubles; unknown numbers and flags are 0).

    ``index`` has one row a contract with its counts and flags, ``corpus`` its opcode ratios;
    contracts that the corpus lacks have zeros there.
    """
    j = index.join(corpus, "fp", "left")
    c = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    nodes, cfg, dfg, total = c("nodes"), c("cfg_edges"), c("dfg_edges"), c("total_edges")
    return j.select(
        "fp", nodes.alias("gf_node_count"), c("blocks").alias("gf_basic_block_count"), cfg.alias("gf_cfg_edge_count"), dfg.alias("gf_dfg_edge_count"), total.alias("gf_edge_count_total"),
        ratio(total, nodes).alias("gf_avg_edges_per_node"), ratio(cfg, total).alias("gf_cfg_edge_ratio"), ratio(dfg, total).alias("gf_dfg_edge_ratio"),
        c("delegatecall_ratio").alias("gf_delegatecall_ratio"), c("call_like_ratio").alias("gf_call_like_ratio"), c("opcode_token_count").alias("gf_opcode_token_count"),
        *[c(x).alias(f"gf_{x}") for x in ("has_cgt", "has_dappscan", "is_proxy_like", "is_stub_like", "graph_build_success", "cfg_success", "dfg_success", "opcode_text_available")],
    )


def _words(text: Column) -> Column:
    """Words of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b[a-z0-9_]{2,}\b"), F.lit(0))


def _pairs(words: Column) -> Column:
    """Neighbouring words as ``a, b``."""
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _counted(texts: DataFrame, terms: Column) -> DataFrame:
    """``term, total, df`` of the terms (arrays) of texts, combined before the shuffle."""
    row = lambda total, df: lambda x: F.struct(x.alias("term"), F.lit(total).alias("total"), F.lit(df).alias("df"))
    t = texts.select(terms.alias("t"))
    each = t.select(F.explode(F.concat(F.transform("t", row(1, 0)), F.transform(F.array_distinct("t"), row(0, 1)))).alias("x"))
    return each.groupBy("x.term").agg(F.sum("x.total").alias("total"), F.sum("x.df").alias("df"))


def vocabulary(train: DataFrame, top: int = 500, text: str = "text") -> DataFrame:
    """``term, idx, idf`` of the ``top`` most frequent terms (words and pairs of neighbours) of the training rows, by their smoothed inverse document frequency.

    Words are counted first. A pair is no more frequent than its rarer word, and ``top`` words
    have the ``top``-th word's count or more, so only pairs of such words can be in the
    vocabulary: no other pair leaves the scan. Which words they are is joined to the texts;
    Spark broadcasts them where they are few.
    """
    return _vocabulary(written(train.select(_words(F.col(text)).alias("w")), "texts"), top)


def _vocabulary(w: DataFrame, top: int) -> DataFrame:
    """:func:`vocabulary` of written texts, each an array of words ``w``: words are cut out of a text once, whatever reads them."""
    words = written(_counted(w, F.col("w")), "words")
    least = words.orderBy(F.desc("total"), "term").limit(top).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    frequent = written(words.where(F.col("total") >= (least["least"] if least["n"] == top else 0)).select(F.col("term").alias("word")), "frequent_words")
    known = F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent
    # a text's pairs by number, so that a repeated pair counts in its text once
    each = w.select(F.monotonically_increasing_id().alias("row"), "w").select("row", F.explode(_pairs(F.col("w"))).alias("p")).select("row", "p.a", "p.b")
    likely = each.join(known.withColumnRenamed("word", "a"), "a", "left_semi").join(known.withColumnRenamed("word", "b"), "b", "left_semi")
    own = likely.groupBy("row", "a", "b").agg(F.count("*").alias("n"))
    pairs = own.groupBy("a", "b").agg(F.sum("n").alias("total"), F.count("*").alias("df")).select(F.concat_ws(" ", "a", "b").alias("term"), "total", "df")
    best = words.unionByName(pairs).orderBy(F.desc("total"), "term").limit(top)
    n = w.count()
    # a window over ``top`` rows
    return best.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), (F.log((1.0 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


#: Words up to which a table of them is broadcast.
BROADCAST_ROWS = 100_000


def tfidf(df: DataFrame, is_train: Column, top: int = 500, text: str = "text") -> DataFrame:
    """``id, idx, term, weight``: sublinear tf, smoothed idf and vocabulary from the training rows, rows of length 1.

    Only terms of the vocabulary, which is broadcast (``top`` rows), leave the scan.
    """
    texts = written(df.select("id", is_train.alias("train"), _words(F.col(text)).alias("w")), "texts")
    known = F.broadcast(written(_vocabulary(texts.where("train"), top), "vocabulary"))
    terms = F.concat("w", F.transform(_pairs(F.col("w")), lambda p: F.concat_ws(" ", p["a"], p["b"])))
    seen = texts.select("id", F.explode(terms).alias("term")).join(known, "term")
    raw = seen.groupBy("id", "idx", "term", "idf").agg(F.count("*").alias("tf")).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "idx", "term", (F.col("w") / norm).alias("weight"))


def token_ids(df: DataFrame, longest: int = 1024, pad: int = 0, unknown: int = 257) -> DataFrame:
    """Opcode ids plus one of at most ``longest`` tokens, padded; the bound is the model's input size."""
    names = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(i + 1)) for i, (n, _, _) in instruction_set().items() if not n.startswith("UNKNOWN")]))
    ids = F.transform(F.slice(F.split(F.upper(F.trim("opcode_text")), r"\s+"), 1, longest), lambda t: F.coalesce(F.element_at("_names", t), F.lit(unknown)))
    df = df.withColumn("_names", names).withColumn("ids", F.when(F.trim("opcode_text") == "", F.array().cast("array<int>")).otherwise(ids))
    return df.withColumn("n_ids", F.size("ids")).withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad), longest - F.size("ids")))).drop("_names")


def windows(n: int, size: int, stride: int) -> list[tuple[int, int]]:
    """Starts and ends of sliding windows over ``n`` tokens; the last one reaches the end."""
    out, at = [], 0
    while True:
        out.append((at, min(at + size, n)))
        if at + size >= n:
            return out
        at += stride


def window_embeddings(texts: DataFrame, vectors: DataFrame, width: int, size: int = 512, stride: int = 256, first: int = 1, last: int = 2, blank: int = 0) -> DataFrame:
    """``id, windows, h``: the mean over a text's windows of the mean of their token vectors.

    ``texts`` has ``id, tokens`` (ids without the marks), ``vectors`` ``token, v`` with a row for
    every id. A text that fits ``size`` with its first and last mark is one window; from a
    longer one, windows of ``size - 2`` tokens start every ``stride`` tokens (``size - 2`` at most)
    as long as there are any, each between both marks. Blanks have no part in a mean, and in
    longer texts marks among the tokens are left out.

    Tokens are counted by window before they meet their vectors, so a text is as many rows
    as it has different tokens in a window; sums of vectors are keyed aggregates.
    """
    room = size - 2
    step = min(stride, room)
    bare = F.filter("tokens", lambda t: ~t.isin(first, last))
    long = F.size("tokens") > room
    x = texts.select("id", F.when(long, bare).otherwise(F.col("tokens")).alias("tokens"), long.alias("long"))
    n = F.when(F.col("long"), F.greatest(F.ceil(F.size("tokens") / step), F.lit(1))).otherwise(1).cast("int")
    x = x.withColumn("windows", n)
    each = x.select("id", "long", "windows", F.posexplode(F.concat("tokens", F.array(F.lit(None).cast("int")))).alias("at", "token"))
    low = F.when(F.col("at") < room, 0).otherwise(F.ceil((F.col("at") - room + 1) / step)).cast("int")
    high = F.least(F.floor(F.col("at") / step).cast("int"), F.col("windows") - 1)
    places = F.when(F.col("long"), F.sequence(low, high)).otherwise(F.array(F.lit(0)))
    inside = each.where("token IS NOT NULL").select("id", F.explode(places).alias("window"), "token").where(F.col("token") != blank)
    # every window has its marks, even if it has nothing else
    marks = x.select("id", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("window"), F.explode(F.array(F.lit(first), F.lit(last))).alias("token"))
    counted = inside.unionByName(marks).groupBy("id", "window", "token").agg(F.count("*").alias("n")).join(vectors, "token")
    sums = counted.groupBy("id", "window").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.get("v", i)).alias(f"s{i}") for i in range(width)])
    means = sums.groupBy("id").agg(F.count("*").alias("windows"), *[F.avg(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(width)])
    return means.select("id", "windows", F.array(*[f"m{i}" for i in range(width)]).alias("h"))
