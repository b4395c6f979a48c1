"""Quality rules: a threshold table compiled into one projection.

Each rule compares one feature of a text with a bound. The features are built-in
expressions over the text's word and line arrays, so a scan is a single map stage
without shuffle or user functions.

Defined cases: a null text counts as empty, an empty text has 0 for every feature and
fails the length rule; texts of any length are read whole; repeated rows are judged one
by one; an empty table gives an empty result; :func:`apply_rules` keeps columns of any
names, :func:`score_rules` replaces those that have a feature's or verdict's name or start
with ``_q_``. Repeated windows are told by 64-bit hashes, unverified: two windows of one
text are confused with a chance of about its words squared over 2**65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "that", "is", "was", "it", "for", "with", "as", "on", "be",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "nicht", "ein", "eine", "ist",
    "le", "la", "les", "et", "des", "en", "un", "une", "du", "que", "dans", "pour", "est", "qui", "par",
    "el", "los", "las", "y", "un", "una", "por", "con", "no", "se", "su", "para", "lo", "como", "del",
)

WINDOW = 5
_SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CLASS = r"\x20\x09-\x0D"

#: name, SQL condition under which a text fails. ``base`` rules come first; the rest is the method's verdict.
RULES: tuple[tuple[str, bool, str], ...] = (
    ("too_few_words", True, "n_words < 10"),
    ("repeated_windows", True, "100 * n_repeat_words > 20 * n_words"),
    ("mean_word_short", False, "word_chars < 2 * n_words"),
    ("mean_word_long", False, "word_chars > 20 * n_words"),
    ("symbols", False, "10 * n_symbols > n_words"),
    ("stop_words", False, "n_words >= 40 AND 100 * n_stop_words < n_words"),
    ("dup_lines", False, "100 * n_dup_lines > 30 * n_lines"),
    ("bullet_lines", False, "100 * n_bullet_lines > 90 * n_lines"),
    ("ellipsis_lines", False, "100 * n_ellipsis_lines > 50 * n_lines"),
)


def _count(array: str, lam) -> Column:
    return F.size(F.filter(F.col(array), lam)).cast("long")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the features the rules refer to, as long columns.

    Word windows are compared by 64-bit hashes of five words; only texts that hold a
    repeated window pay for sorting them, so cost stays n log n in a text's words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({
        "_q_w": F.array_remove(F.split(t, _SPACES, -1), ""),
        "_q_l": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{_SPACE_CLASS}]")),
        "_q_symbols": F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"),
    })
    n = F.size("_q_w")
    window = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get("_q_w", i + k) for k in range(WINDOW)]),
    )
    stop = list(dict.fromkeys(STOP_WORDS))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "n_symbols": F.col("_q_symbols"),
        "n_lines": F.size("_q_l").cast("long"),
        "n_dup_lines": (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"),
        "n_stop_words": _count("_q_w", lambda x: x.isin(stop)),
        "n_bullet_lines": _count("_q_l", lambda x: x.rlike(rf"^[{_SPACE_CLASS}]*[-*•]")),
        "n_ellipsis_lines": _count("_q_l", lambda x: x.rlike(rf"(\.\.\.|…)[{_SPACE_CLASS}]*$")),
        "_q_h": F.when(n >= WINDOW, window),
    })
    repeated = F.size(F.array_distinct("_q_h")) < F.size("_q_h")
    df = df.withColumn("_q_s", F.when(repeated, F.sort_array(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda j: F.get("_q_s", j)
    same = lambda j, k: F.coalesce(at(j)["h"] == at(k)["h"], F.lit(False))
    hits = F.filter(F.sequence(F.lit(0), F.size("_q_s") - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    df = df.withColumn("_q_p", F.when(F.col("_q_s").isNotNull(), F.sort_array(F.transform(hits, lambda j: at(j)["i"]))))
    covered = F.aggregate(
        F.transform("_q_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_q_p", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_w", "_q_l", "_q_symbols", "_q_h", "_q_s", "_q_p")


def verdicts(rules=RULES) -> dict[str, Column]:
    """The rule table as columns: ``base_failed``, ``kept`` and the names of the rules that failed."""
    failed = [(name, base, F.expr(f"({cond})")) for name, base, cond in rules]
    base = F.lit(False)
    other = F.lit(False)
    for _, is_base, cond in failed:
        base, other = (base | cond, other) if is_base else (base, other | cond)
    return {
        "base_failed": base,
        "kept": ~(base | other),
        "failed_rules": F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, _, cond in failed])),
    }


def score_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``df`` with all features and the verdict columns."""
    return features(df, text).withColumns(verdicts(rules))


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that pass every rule, with ``df``'s own columns only."""
    scored = features(df.select(*[F.col(f"`{c}`").alias(f"_q_c{i}") for i, c in enumerate(df.columns)], F.col(f"`{text}`").alias("_q_text")), "_q_text")
    # The row number keeps Catalyst from moving the filter below the projections, where each
    # reference to a word array inside a lambda would split the text again.
    kept = scored.withColumns(verdicts(rules)).withColumn("_q_row", F.monotonically_increasing_id()).where("kept AND _q_row >= 0")
    return kept.select(*[F.col(f"_q_c{i}").alias(c) for i, c in enumerate(df.columns)])
