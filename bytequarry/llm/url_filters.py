"""URL filters: host and path rules first, then a character language-model ratio.

URLs that a rule decides are the training text of two Markov models, one for accepted
and one for rejected URLs. Both predict a code point from up to ``ORDER`` code points
before it, with Witten-Bell smoothing: a context seen n times with t different
successors gives weight t / (n + t) to the next shorter one, and contexts that were not
seen give it all of theirs, so each place is predicted at the longest order that the
corpus supports; below single code points stands an even spread over those of the corpus
and one more. A URL's score is the difference of its log-likelihoods, divided by its
length. The cut-off is calibrated on the URLs that the rules decide: the score with the best
mean of the shares of accepted URLs kept and rejected URLs blocked. For this, URLs are in
``FOLDS`` folds by their hash, and a decided URL is scored by models without its fold, so
that neither it nor its copies speak for themselves.

All counts are tables: grams are counted over every URL with partial aggregates, lower
orders are sums of higher ones, and probabilities join level by level. Grams that stand
in very many URLs, as their beginnings do, are joined by broadcast: those with a share of
1 / ``FREQUENT`` of all places or more, so at most ``FREQUENT``. All others are joined by
shuffles. Nothing but one row of totals and the calibration's histogram, both of bounded
size, comes to the driver.

Defined cases: a null URL, or one without ``://``, has an empty host and path; a null URL
has no score and is allowed; an empty URL is scored as its end alone; where the rules
accept or reject nothing, all undecided URLs are allowed; ties at the cut-off are allowed;
repeated rows are judged each and count each; long URLs are read whole; an empty table
gives an empty result; only the two columns named are read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.shared import cut, drop

#: Code points of context; bins of the calibration's histogram and the scores it spans.
ORDER, BINS, SPAN = 4, 2000, 4.0
#: Folds of calibration, and the inverse share of all places from which a gram is joined by broadcast.
FOLDS, FREQUENT = 4, 10_000
#: The models: from all decided URLs, and without each fold.
MODELS = ("all", *map(str, range(FOLDS)))
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`_u_url`"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action; ``rules`` are (action, host and path)."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _log_ratios(grams: DataFrame) -> DataFrame:
    """``gram, c, ratio_<model>``: log of accepted over rejected probability of each gram's last code point.

    ``grams`` has every gram of the corpus once, with its places ``c`` and its counts
    ``a_<model>`` and ``r_<model>`` among the accepted and rejected URLs of each model.
    """
    sides = [f"{side}_{m}" for side in "ar" for m in MODELS]
    levels = [grams]
    for o in range(ORDER - 1, -1, -1):
        levels.insert(0, levels[0].groupBy(F.substring("gram", 2, o + 1).alias("gram")).agg(*[F.sum(x).alias(x) for x in sides]))
    lower = None
    for o, counts in enumerate(levels):
        of_context = [F.sum(x).alias(f"n_{x}") for x in sides] + [F.count_if(F.col(x) > 0).alias(f"t_{x}") for x in sides]
        if lower is None:
            total = counts.agg(F.count("*").alias("kinds"), *of_context).first()
            level = counts.withColumns({f"{k}_{x}": F.lit(total[f"{k}_{x}"]) for k in "nt" for x in sides} | {f"p_{x}": F.lit(1 / (total["kinds"] + 1)) for x in sides})
        else:
            counts = counts.withColumn("ctx", F.substring("gram", 1, o))
            level = counts.join(counts.groupBy("ctx").agg(*of_context), "ctx")
            level = level.withColumn("low", F.substring("gram", 2, o)).join(lower.select(F.col("gram").alias("low"), *[f"p_{x}" for x in sides]), "low")

        def smooth(x: str) -> Column:
            n, kinds, p = F.coalesce(F.col(f"n_{x}"), F.lit(0)), F.col(f"t_{x}"), F.col(f"p_{x}")
            return F.when(n > 0, (F.col(x) + kinds * p) / (n + kinds)).otherwise(p)

        lower = cut(level.select("gram", *["c"] * (o == ORDER), *[smooth(x).alias(f"p_{x}") for x in sides]), f"order-{o}")
    log = lambda m: F.round(F.log(F.col(f"p_a_{m}") / F.col(f"p_r_{m}")), 12).cast("decimal(38,12)")
    return lower.select("gram", "c", *[log(m).alias(f"ratio_{m}") for m in MODELS])


def _cutoff(scored: DataFrame) -> float | None:
    """The score below which URLs are blocked; None where one of the two classes is empty."""
    b = F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    table = scored.where("action IS NOT NULL AND score IS NOT NULL").groupBy(b.alias("b")).agg(F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("r")).orderBy("b").collect()
    na, nr = sum(x["a"] for x in table), sum(x["r"] for x in table)
    if not na or not nr:
        return None
    kept, blocked, best, at, last = na, 0, 1.0, 0.0, None
    for x in table:
        if (value := kept / na + blocked / nr) > best:
            # the middle of the gap below this bin
            best, at = value, (last + 1 + x["b"]) / 2
        kept, blocked, last = kept - x["a"], blocked + x["r"], x["b"]
    if blocked / nr > best:
        at = BINS
    return at / BINS * 2 * SPAN - SPAN


def judge(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id, url, host, path, rule, score, verdict`` for every row."""
    u = F.col("_u_url")
    rows = df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("_u_url"))
    host, path = host_and_path(u)
    rows = rows.withColumns({"host": host, "path": path})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = cut(rows.withColumns({"rule": rule, "action": action}), "urls")
    # one row per distinct URL: copies only weigh
    key = {"k1": F.xxhash64("_u_url"), "k2": F.xxhash64(F.lit(3), "_u_url")}
    urls = rows.where("_u_url IS NOT NULL").groupBy("_u_url", "action").agg(F.count("*").alias("n")).withColumns(key)
    urls = cut(urls.withColumn("fold", F.pmod("k2", F.lit(FOLDS)).cast("int")), "distinct-urls")
    padded = F.concat(F.lit(_START * ORDER), F.col("_u_url"), F.lit(_END))
    places = urls.select("k1", "k2", "action", "fold", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - ORDER), lambda i: F.substring(padded, i, ORDER + 1))).alias("gram"))

    def counted(side: str, action: str) -> list[Column]:
        mine = F.col("action") == action
        return [F.sum(F.when(mine if m == "all" else mine & (F.col("fold") != int(m)), F.col("n")).otherwise(0)).alias(f"{side}_{m}") for m in MODELS]

    grams = cut(places.groupBy("gram").agg(F.count("*").alias("c"), *counted("a", "allow"), *counted("r", "block")), "grams")
    ratio = cut(_log_ratios(grams), "ratios")
    least = (grams.agg(F.sum("c")).first()[0] or 0) / FREQUENT
    own = F.when(F.col("action").isNull(), F.col("ratio_all"))
    for f in range(FOLDS):
        own = own.when(F.col("fold") == f, F.col(f"ratio_{f}"))
    at = places.select("k1", "k2", "action", "fold", "gram")
    # at most FREQUENT grams have such a share of all places
    frequent = F.broadcast(ratio.where(F.col("c") >= least))
    often = at.join(frequent, "gram")
    rare = at.join(frequent.select("gram"), "gram", "left_anti").join(ratio.where(F.col("c") < least), "gram")
    # decimal sums do not depend on the order of summation
    part = lambda x: x.groupBy("k1", "k2").agg(F.sum(own).alias("s"), F.count("*").alias("m"))
    score = part(often).unionByName(part(rare)).groupBy("k1", "k2").agg((F.sum("s").cast("double") / F.sum("m")).alias("score"))
    score = cut(score, "scores")
    drop(grams, ratio, urls)
    scored = rows.withColumns(key).join(score, ["k1", "k2"], "left").withColumn("score", F.when(u.isNotNull(), F.col("score")))
    limit = _cutoff(scored)
    kept = F.lit(True) if limit is None else F.coalesce(F.col("score") >= limit, F.lit(True))
    verdict = F.coalesce("action", F.when(kept, "allow").otherwise("block"))
    return scored.select("page_id", u.alias("url"), "host", "path", "rule", "score", verdict.alias("verdict"))
