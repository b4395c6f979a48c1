"""Secret scans: fixed patterns and a battery of randomness tests, in built-in functions only.

Pattern spans come from pairs of arrays: a text split at a pattern, and the matches
themselves. The running sum of their lengths gives code point offsets without a user
function.

The method looks at every run of ``MIN_LENGTH`` or more letters, digits and ``+/_=-``,
however long. Where pattern spans cut a run, its parts outside them are looked at if they
have ``MIN_LENGTH`` code points. A run's encoding is inferred from the code points it uses
(hexadecimal, base32, base36, base64, base64 for URLs, all of them; padding at the end is
left out). Under the hypothesis that code points are drawn evenly and independently from
that alphabet, five statistics become normal deviates: chi-squared of the alphabet's counts
and of those of its classes (capitals, small letters, the rest), equal classes of neighbours,
too few runs above and below the alphabet's middle, and the lag-1 serial correlation. Each
grows with the order that words and paths have, and the run's deviate is their sum over the
root of five: about normal around 0 for random keys, and the higher the longer for others.

False discoveries are controlled for each length class and encoding, since short runs can
look random by chance. How many ordinary runs do is taken from the corpus itself: random
runs seldom have a deviate above 2, so what is seen there (less the random runs' share) is
ordinary, and how its number falls from 5 down to 2 says how many there are at most below
(:func:`_ordinary_below`). The largest cut-off is taken for which they are at most ``RATE`` of all
runs below it; a class without one has no spans. So a corpus of words alone has none, and
keys are found the better the longer and the more of them there are: a test holds rates and
power for keys that are 0.1, 1 and 10 % of runs of one length. The counts are a table of
classes by ``BINS`` bins, whatever the input.

Defined cases: a null text counts as empty, and an empty text has no spans; texts and
runs of any length are looked at whole; repeated rows are scanned each; an empty table
gives an empty result. :func:`redact` keeps columns of any names; :func:`scan` replaces
columns named as a kind or starting with ``_s_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.shared import cut

#: The patterns by kind, in the order of equal starts, with the condition that a match must meet.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_LENGTH, RATE = 20, 0.05
#: The deviate of a run that is surely not random; the bins of deviates, ``PER_UNIT`` for each unit from ``LOWEST`` on, the first and last of which hold the rest.
FAR, LOWEST, PER_UNIT, BINS = 99.0, -4, 4, 60
#: Random runs with a deviate from 2 to 3, and from 3 to 4, as shares of those below 2.
TAILS = (0.06, 0.013)
#: Matches whose offsets are gathered in one array.
RUN_LENGTH = 64
#: The alphabets in order of their values.
HEX_SMALL, HEX_LARGE = "0123456789abcdef", "0123456789ABCDEF"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPITALS, SMALL, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets with the shape of a run that uses them, the first that fits counts.
ENCODINGS = (
    (HEX_SMALL, "^[0-9a-f]+$"),
    (HEX_LARGE, "^[0-9A-F]+$"),
    (BASE32, "^[A-Z2-7]+$"),
    (DIGITS + SMALL, "^[0-9a-z]+$"),
    (DIGITS + CAPITALS, "^[0-9A-Z]+$"),
    (BASE64, "^[0-9A-Za-z+/]+$"),
    (CAPITALS + SMALL + DIGITS + "-_", "^[0-9A-Za-z_-]+$"),
    (CAPITALS + SMALL + DIGITS + "+/-_=", "^.+$"),
)
_SPAN = "array<struct<start: bigint, end: bigint, hit: string>>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` with their code point offsets.

    Matches are taken in runs of ``RUN_LENGTH``: the lengths of each run are summed up, the
    sums give each run's offset, and offsets inside a run follow from there. So an array
    that grows by one match at a time never has more than ``RUN_LENGTH`` elements.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), hit.alias("hit")))

    def cut_up(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN_LENGTH).cast("int")), lambda c: F.slice(x, c * RUN_LENGTH + 1, F.lit(RUN_LENGTH)))

    def starts(runs: Column) -> Column:
        one = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, m: a + m["gap"] + m["size"])
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, r: _bind(one(r), lambda n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
        return F.aggregate(runs, first, step, lambda a: a["out"])

    def spans(run: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(_SPAN).alias("out"))
        step = lambda a, m: F.struct(
            (a["at"] + m["gap"] + m["size"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["size"]).alias("end"), m["hit"].alias("hit")))).cast(_SPAN).alias("out"),
        )
        return F.aggregate(run, first, step, lambda a: a["out"])

    walk = _bind(_bind(parts, cut_up), lambda runs: F.flatten(F.zip_with(runs, starts(runs), spans)))
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(_SPAN))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _cube_root_deviate(chi: Column, degrees) -> Column:
    """A chi-squared value as a normal deviate (Wilson and Hilferty)."""
    spread = 2 / (9 * degrees)
    return (F.pow(F.greatest(chi, F.lit(0.0)) / degrees, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(F.lit(0.0) + spread)


def _pairs(x: Column) -> Column:
    """Neighbours in an array."""
    return F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _battery(x: Column) -> Column:
    """The deviate of a run: ``x`` has its n code points ``c`` and their values v in an alphabet of k, their classes ``kinds`` and the classes' shares of the alphabet.

    Where a statistic has no variance, all code points are alike in it, and it counts as :data:`FAR`.
    """
    n, k, v = x["n"], x["k"], x["v"]
    # squares of the counts, from the run's code points in order
    first = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))
    step = lambda a, c: F.struct(  # noqa: E731  one more of the same adds 2m + 1 to the sum of squares
        c.alias("c"), F.when(a["c"] == c, a["m"] + 1).otherwise(1.0).alias("m"), (a["s"] + F.when(a["c"] == c, 2 * a["m"] + 1).otherwise(1.0)).alias("s")
    )
    squares = F.aggregate(F.sort_array(x["c"]), first, step, lambda a: a["s"])
    even = _cube_root_deviate(squares * k / n - n, k - 1)
    middle, mean = (k - 1) / 2, F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n
    high = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y > middle).cast("double"))
    # classes: their counts by chi-squared of one or two degrees, and equal neighbours by their mean and variance
    kinds, shares = x["kinds"], x["shares"]
    off = lambda kind, share: F.when(share > 0, F.pow(F.aggregate(kinds, F.lit(0.0), lambda a, y: a + (y == kind).cast("double")) - n * share, F.lit(2)) / (n * F.greatest(share, F.lit(1e-9)))).otherwise(0.0)
    degrees = (shares["u"] > 0).cast("int") + (shares["l"] > 0).cast("int") + (shares["d"] > 0).cast("int") - 1
    classes = _cube_root_deviate(off("U", shares["u"]) + off("l", shares["l"]) + off("d", shares["d"]), degrees)
    power = lambda e: F.pow(shares["u"], F.lit(e)) + F.pow(shares["l"], F.lit(e)) + F.pow(shares["d"], F.lit(e))
    same = F.aggregate(_pairs(kinds), F.lit(0.0), lambda a, z: a + (z["a"] == z["b"]).cast("double"))
    var_same = (n - 1) * power(2) * (1 - power(2)) + 2 * (n - 2) * (power(3) - power(2) * power(2))
    alike = (same - (n - 1) * power(2)) / F.sqrt(var_same)

    def rest(y: Column) -> Column:
        both = 2 * y["high"] * (n - y["high"])
        runs = 1 + F.aggregate(y["pairs"], F.lit(0.0), lambda a, z: a + ((z["a"] > middle) != (z["b"] > middle)).cast("double"))
        var = both * (both - n) / (n * n * (n - 1))
        few = F.when(var > 0, (1 + both / n - runs) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(FAR)
        around = F.aggregate(v, F.lit(0.0), lambda a, z: a + (z - y["mean"]) * (z - y["mean"]))
        lag = F.aggregate(y["pairs"], F.lit(0.0), lambda a, z: a + (z["a"] - y["mean"]) * (z["b"] - y["mean"]))
        follow = F.when(around > 0, (lag / F.greatest(around, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(FAR)
        return (y["z"] + few + follow) / math.sqrt(5)

    return _bind(F.struct((even + classes + alike).alias("z"), mean.alias("mean"), _pairs(v).alias("pairs"), high.alias("high")), rest)


def _encoding(run: Column) -> Column:
    """The number of a run's encoding."""
    found = None
    for i, (_, shape) in enumerate(ENCODINGS):
        found = F.when(run.rlike(shape), i) if found is None else found.when(run.rlike(shape), i)
    return found


def _judge(run: Column) -> Column:
    """``(code, z)`` of a run: its encoding's number and deviate."""
    share = lambda letters, kind: sum(c in kind for c in letters) / len(letters)
    known = F.array(*[
        F.struct(
            F.lit(letters).alias("letters"),
            F.struct(F.lit(share(letters, CAPITALS)).alias("u"), F.lit(share(letters, SMALL)).alias("l"), F.lit(1 - share(letters, CAPITALS + SMALL)).alias("d")).alias("shares"),
        )
        for letters, _ in ENCODINGS
    ])
    kinds = F.translate(run, CAPITALS + SMALL + DIGITS + "+/-_=", "U" * 26 + "l" * 26 + "d" * 15)

    def valued(x: Column) -> Column:
        v = F.transform(x["c"], lambda c: (F.instr(x["e"]["letters"], c) - 1).cast("double"))
        return F.struct(x["c"].alias("c"), F.size(x["c"]).cast("double").alias("n"), F.length(x["e"]["letters"]).cast("double").alias("k"), v.alias("v"), x["kinds"].alias("kinds"), x["e"]["shares"].alias("shares"))

    def tested(code: Column) -> Column:
        x = F.struct(F.split(run, "").alias("c"), F.split(kinds, "").alias("kinds"), F.get(known, code).alias("e"))
        # keys mix cases or letters and digits; a run of one class is a word, a number or a rule
        mixed = (run.rlike("[0-9]").cast("int") + run.rlike("[A-Z]").cast("int") + run.rlike("[a-z]").cast("int")) >= 2
        return F.struct(code.alias("code"), F.when(mixed, _bind(_bind(x, valued), _battery)).otherwise(F.lit(FAR)).alias("z"))

    return _bind(_encoding(run), tested)


def _deviate(run: Column) -> Column:
    bare = F.regexp_replace(run, "=+$", "")
    none = F.struct(F.lit(0).alias("code"), F.lit(FAR).alias("z"))
    return F.when(F.length(bare) >= 2, _bind(bare, _judge)).otherwise(none)


def _outside(m: Column, spans: Column) -> Column:
    """The parts of run ``m`` of ``MIN_LENGTH`` or more code points that none of ``spans`` touches."""
    part = lambda a, end: F.when(
        end - a["at"] >= MIN_LENGTH,
        F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"), F.substring(m["hit"], (a["at"] - m["start"] + 1).cast("int"), (end - a["at"]).cast("int")).alias("hit"))).cast(_SPAN)),
    ).otherwise(a["out"])
    first = F.struct(m["start"].alias("at"), F.array().cast(_SPAN).alias("out"))
    step = lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), part(a, b["start"]).alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(F.sort_array(spans), first, step, lambda a: part(a, m["end"]))).otherwise(F.array(m).cast(_SPAN))


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_s_assign, _s_access, _s_hex`` (spans) and ``_s_runs`` (start, end, encoding and deviate of the parts of runs outside those spans)."""
    t = F.coalesce(F.col(text), F.lit(""))
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 1)
    df = df.withColumns({
        "_s_assign": F.filter(_matches(t, ASSIGN), lambda m: F.length(value(m["hit"])) >= 6),
        "_s_access": _matches(t, ACCESS),
        "_s_hex": _matches(t, HEX),
        "_s_all": _matches(t, RUN),
    })
    known = F.concat("_s_assign", "_s_access", "_s_hex")
    free = F.flatten(F.transform("_s_all", lambda m: _outside(m, F.filter(known, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))))
    df = df.withColumn("_s_free", F.when(F.size("_s_all") > 0, free).otherwise(F.array().cast(_SPAN)))
    judged = lambda m: _bind(_deviate(m["hit"]), lambda q: F.struct(m["start"].alias("start"), m["end"].alias("end"), q["code"].alias("code"), q["z"].alias("z")))
    runs = F.transform("_s_free", judged)
    bare = lambda c: F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return df.withColumns({"_s_runs": runs, **{c: bare(c) for c in ("_s_assign", "_s_access", "_s_hex")}}).drop("_s_all", "_s_free")


def _ordinary_below(near: float, middle: float, far: float, length: float) -> list[float]:
    """Ordinary runs expected with a deviate below 2, 1, ... and ``LOWEST`` + 1, from those seen from 2 to 3, 3 to 4 and 4 to 5.

    From unit to unit the logarithm of their number falls by a step that grows by half of
    what it grew by where it can be seen (a normal law keeps all of it). Where it does not
    fall, it is taken to stay as it is for the shortest runs, and to fall the faster the
    longer they are, as the order of long runs can hardly be missed. Each number seen may be
    off by its root, to the side that expects more, and by chance one more run is expected
    below 2, half of one below 1 and so on, and fewer of longer runs.
    """
    low, near = middle - math.sqrt(middle) + 1, near + math.sqrt(near)
    longer = length / MIN_LENGTH - 1
    step = min(-longer / 2, math.log((near + 1) / low))
    growth = min(0.0, step - math.log(low / (far + math.sqrt(far) + 1))) / 2
    units = []
    for _ in range(2 - LOWEST):
        step += growth
        near *= math.exp(step)
        units.append(near)
    return [sum(units[u:]) + 0.5 ** (longer + u) for u in range(len(units))]


def _limit(counts: list[int], length: float) -> float | None:
    """The largest deviate of one class (from ``length`` on) that counts as random, from its runs by bins of their deviates, or None."""
    within = lambda low, high: sum(counts[round((low - LOWEST) * PER_UNIT) : round((high - LOWEST) * PER_UNIT)])
    random_ = within(LOWEST, 2)
    near, middle = (max(0.0, within(2 + k, 3 + k) - t * random_) for k, t in enumerate(TAILS))
    below = [*_ordinary_below(near, middle, within(4, 5), length), 0.0]
    for bins in range(2 * PER_UNIT, (LOWEST + 2) * PER_UNIT, -1):
        t = bins / PER_UNIT
        u = min(int(2 - t), len(below) - 2)
        expected = below[u] + (below[u + 1] - below[u]) * (2 - t - u)
        if expected <= RATE * within(LOWEST, t):
            return t
    return None


#: Lengths of one class are within a quarter of an octave; encodings are counted apart.
def _class(r: Column) -> Column:
    return F.floor(F.log2((r["end"] - r["start"]).cast("double")) * 4).cast("int") * len(ENCODINGS) + r["code"]


def cutoffs(found: DataFrame) -> dict[int, float]:
    """The largest deviate that counts, for each class of length and encoding that has one; see the module's text."""
    runs = found.select(F.explode("_s_runs").alias("r")).where(F.col("r.z") < FAR)
    place = F.least(F.greatest(F.floor((F.col("r.z") - LOWEST) * PER_UNIT), F.lit(0)), F.lit(BINS - 1)).cast("int")
    table = runs.groupBy(_class(F.col("r")).alias("c"), place.alias("b")).agg(F.count("*").alias("n")).collect()
    by_class: dict[int, list[int]] = {}
    for r in table:
        by_class.setdefault(r["c"], [0] * BINS)[r["b"]] += r["n"]
    limits = {c: _limit(counts, 2.0 ** (c // len(ENCODINGS) / 4)) for c, counts in by_class.items()}
    return {c: z for c, z in limits.items() if z is not None}


def _judged(found: DataFrame, limits: dict[int, float]) -> DataFrame:
    """Candidates with ``assign``, ``access``, ``hex`` and ``random`` (arrays of start and end) in place of work columns."""
    if limits:
        table = F.create_map(*[F.lit(x) for c, z in sorted(limits.items()) for x in (c, z)])
        hit = lambda r: r["z"] < F.coalesce(F.element_at(table, _class(r)), F.lit(-FAR))
        kept = F.filter("_s_runs", hit)
    else:
        kept = F.filter("_s_runs", lambda r: F.lit(False))
    bare = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return found.withColumns({"assign": F.col("_s_assign"), "access": F.col("_s_access"), "hex": F.col("_s_hex"), "random": bare}).drop("_s_assign", "_s_access", "_s_hex", "_s_runs")


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``assign``, ``access``, ``hex`` and ``random``: arrays of (start, end).

    The candidates are written before they are counted, so the texts are scanned once.
    """
    found = cut(candidates(df, text).drop(text), "secret-runs")
    return _judged(found, cutoffs(found))


def listed(*kinds: str) -> Column:
    """``kind:start:end`` of the kinds' spans, by start and then kind, joined by commas."""
    def tag(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(m["start"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), m["end"].alias("e")))

    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(F.concat(*map(tag, kinds))), lambda m: F.concat_ws(":", F.get(names, m["k"]), m["s"].cast("string"), m["e"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``df``'s rows and columns with every span replaced by ``mark`` (overlapping spans by one)."""
    work = df.select(*[F.col(f"`{c}`").alias(f"_s_c{i}") for i, c in enumerate(df.columns)], F.col(f"`{text}`").alias("_s_text"))
    found = candidates(work, "_s_text")
    # the texts are scanned twice, once for the counts, rather than written
    limits = cutoffs(cut(found.select("_s_runs"), "secret-runs"))
    spans = _judged(found, limits).withColumn("_s_spans", F.sort_array(F.concat("assign", "access", "hex", "random")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, m: F.substring(F.col("_s_text"), (a["at"] + 1).cast("int"), (m["start"] - a["at"]).cast("int"))
    step = lambda a, m: F.when(m["start"] < a["at"], F.struct(F.greatest(a["at"], m["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(m["end"].alias("at"), F.concat(a["out"], piece(a, m), F.lit(mark)).alias("out"))
    )
    clean = F.aggregate("_s_spans", empty, step, lambda a: F.concat(a["out"], F.substring(F.col("_s_text"), (a["at"] + 1).cast("int"), F.length("_s_text"))))
    spans = spans.withColumn("_s_clean", F.when(F.size("_s_spans") > 0, clean).otherwise(F.col("_s_text")))
    return spans.select(*[F.col("_s_clean" if c == text else f"_s_c{i}").alias(c) for i, c in enumerate(df.columns)])
