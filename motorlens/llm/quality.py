"""Quality statistics of texts and robust multivariate outliers, in DataFrame operations only.

For every language and source the minimum-covariance-determinant estimate of four
transformed statistics is found by concentration steps from two starts: moments of the
rows that lie nearest by Mahalanobis distance replace the estimate until its determinant
stops falling.  A step is one aggregation: rows are summed by (group, distance bin), and
the bins up to the wanted share of rows make the next estimate.  The estimate of a small
group is mixed with that of its language, and a small language's with that of all rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.session import materialise

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEATED = 50

# share of a group's rows that an estimate rests on, rows from which on a group stands for itself
SUPPORT = 0.75
MIN_GROUP = 40
MAX_STEPS = 8
SETTLED = 1e-3
# parts of a group that meet its estimates apart from each other
SALTS = 32
# chance that a row of a normal distribution lies beyond the limit
TAIL = 1e-6
# distance bins: so many for each doubling of 1 + distance
BINS = 32

# transformed statistics: mean word length, symbols, repeated lines, repeated words; and the least deviation of each
VECTOR = ("x0", "x1", "x2", "x3")
LEAST_DEVIATION = (0.06, 0.30, 0.20, 0.20)
PAIRS = tuple((i, j) for i in range(4) for j in range(i + 1))
MOMENTS = ("n", *(f"s{i}" for i in range(4)), *(f"s{i}{j}" for i, j in PAIRS))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def text_statistics(docs: DataFrame) -> DataFrame:
    """Add counts to every document: words, their characters, symbols, lines, repeated lines, words in repeated 3-word windows.

    Nothing is exploded: windows are hashed into an array of the row, sorted with their
    positions, and windows equal to a neighbour are counted by the words they add.
    """
    counted = (
        docs.withColumn("_text", F.coalesce("text", F.lit("")))
        .withColumn("_words", F.filter(F.split("_text", "[ \\t-\\r]+"), lambda w: w != ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, SPACES, "") != ""))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.translate("_text", SPACES, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_lines", F.size("_lines").cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .drop("_text", "_lines")
    )
    windows = F.transform(
        F.slice("_words", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    hashed = counted.withColumn("_windows", windows).drop("_words")
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.when(repeated, F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.withColumn("_placed", placed).withColumn("_placed", F.array_sort("_placed")).drop("_windows")
    same = lambda w, k: F.coalesce(w["h"] == F.get("_placed", k)["h"], F.lit(False))
    twice = F.filter("_placed", lambda w, k: same(w, k - 1) | same(w, k + 1))
    positions = ordered.withColumn("_at", F.array_sort(F.transform(twice, lambda w: w["i"]))).drop("_placed")
    adds = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3))))
    covered = F.aggregate(adds, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return positions.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_at")


def statistic_vector() -> list[Column]:
    """The four transformed statistics of a row with words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda part, whole: F.asin(F.sqrt(F.col(part) / F.greatest(whole, F.lit(1))))
    return [
        F.log((F.col("word_chars") + 1) / words).alias("x0"),
        F.log1p(100 * F.col("n_symbols") / words).alias("x1"),
        share("n_dup_lines", F.col("n_lines")).alias("x2"),
        share("n_repeat_words", F.col("n_words")).alias("x3"),
    ]


def _moments() -> list[Column]:
    return [
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(4)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS],
    ]


def _estimate(moments: DataFrame, widen: float = 1.0) -> DataFrame:
    """Centre, triangular factor of the covariance and log determinant from the moments of a subset."""
    mean = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(4)})
    covariance = mean.withColumns({
        f"c{i}{j}": (F.greatest(F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) if i == j
                     else F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * widen
        + (LEAST_DEVIATION[i] ** 2 if i == j else 0.0)
        for i, j in PAIRS
    })
    return _factor(covariance)


def _factor(df: DataFrame) -> DataFrame:
    """Add the Cholesky factor ``l..`` of ``c..``, column by column, and the log determinant."""
    for j in range(4):
        rest = _sum([F.lit(0.0), *[F.col(f"l{j}{k}") ** 2 for k in range(j)]])
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - rest, F.lit(1e-12))))
        below = {
            f"l{i}{j}": (F.col(f"c{i}{j}") - _sum([F.lit(0.0), *[F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]]))
            / F.col(f"l{j}{j}")
            for i in range(j + 1, 4)
        }
        df = df.withColumns(below) if below else df
    return df.withColumn("logdet", 2 * _sum([F.log(F.col(f"l{i}{i}")) for i in range(4)]))


def _distance(df: DataFrame, into: str) -> DataFrame:
    """Add the squared Mahalanobis distance of the vector by the joined estimate."""
    for i in range(4):
        known = _sum([F.lit(0.0), *[F.col(f"l{i}{k}") * F.col(f"_z{k}") for k in range(i)]])
        df = df.withColumn(f"_z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    return df.withColumn(into, _sum([F.col(f"_z{i}") ** 2 for i in range(4)])).drop(*[f"_z{i}" for i in range(4)])


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees."""
    terms = [(x / 2) ** k / math.factorial(k) for k in range(degrees // 2)]
    return 1 - math.exp(-x / 2) * sum(terms)


def chi_square_quantile(tail: float, degrees: int) -> float:
    """The value that is exceeded with the chance ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi_square_cdf(middle, degrees) > tail else (low, middle)
    return high


def consistency() -> float:
    """What a covariance of the nearest ``SUPPORT`` of normal rows is multiplied by."""
    cut = chi_square_quantile(1 - SUPPORT, 4)
    return SUPPORT / chi_square_cdf(cut, 6)


ESTIMATE = (*(f"m{i}" for i in range(4)), *(f"l{i}{j}" for i, j in PAIRS), "logdet")


def minimum_covariance(rows: DataFrame, group: str) -> DataFrame:
    """The estimate of every group of rows ``(group, _salt, x0 .. x3)``, and its ``rows``."""
    quartiles = [F.percentile(F.round(f"x{i}", 2), [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(4)]
    first = rows.groupBy(group).agg(*_moments(), *quartiles)
    first = materialise(first)
    sizes = first.select(group, F.col("n").alias("rows"))
    classical = _estimate(first).select(group, F.lit(0).alias("start"), *ESTIMATE)
    centred = first.withColumns({f"m{i}": F.col(f"q{i}")[1] for i in range(4)}).withColumns({
        f"c{i}{j}": ((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + LEAST_DEVIATION[i] ** 2 if i == j else F.lit(0.0)
        for i, j in PAIRS
    })
    medians = _factor(centred).select(group, F.lit(1).alias("start"), *ESTIMATE)
    current = materialise(classical.unionByName(medians))
    before = None
    for _ in range(MAX_STEPS):
        current = materialise(_concentrated(rows, current, sizes, group))
        total = current.agg(F.sum("logdet")).first()[0]
        if total is None or before is not None and abs(before - total) <= SETTLED:
            break
        before = total
    best = Window.partitionBy(group).orderBy("logdet", "start")
    return current.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(group, *ESTIMATE).join(sizes, group)


def _mixed(own: DataFrame, wider: DataFrame, by: list[str]) -> DataFrame:
    """Estimates of groups of fewer than ``MIN_GROUP`` rows, centre and covariance mixed with the wider group's as ``rows`` to what is missing."""
    other = wider.select(*by, *[F.col(c).alias(f"w_{c}") for c in ESTIMATE])
    met = (own.join(other, by) if by else own.crossJoin(other)).withColumn("_w", F.col("rows") / F.lit(MIN_GROUP))
    mean = lambda i, p="": F.col(f"{p}m{i}")
    spread = lambda i, j, p="": _sum([F.col(f"{p}l{i}{k}") * F.col(f"{p}l{j}{k}") for k in range(j + 1)])
    mix = lambda a, b: F.col("_w") * a + (1 - F.col("_w")) * b
    # without the spread between the two centres: by it, a few documents far from all others would excuse themselves
    centre = {f"_m{i}": mix(mean(i), mean(i, "w_")) for i in range(4)}
    covariance = {f"c{i}{j}": mix(spread(i, j), spread(i, j, "w_")) for i, j in PAIRS}
    moved = met.withColumns(centre).withColumns(covariance).drop(*ESTIMATE).withColumnsRenamed({f"_m{i}": f"m{i}" for i in range(4)})
    return _rounded(_factor(moved)).select(*own.columns)


def group_estimates(passed: DataFrame) -> DataFrame:
    """An estimate for every ``_group`` of rows ``(_group, _lang, _salt, x0 .. x3)``; wider ones are made only where a group is small."""
    names = materialise(passed.groupBy("_group", "_lang").agg(F.count(F.lit(1)).alias("n")))
    own = materialise(minimum_covariance(passed, "_group").join(names.drop("n"), "_group"))
    small, large = own.where(F.col("rows") < MIN_GROUP), own.where(F.col("rows") >= MIN_GROUP)
    if small.isEmpty():
        return own.select("_group", *ESTIMATE)
    in_need = small.select("_lang").distinct()
    languages = materialise(minimum_covariance(passed.join(in_need, "_lang", "left_semi"), "_lang"))
    few = languages.where(F.col("rows") < MIN_GROUP)
    if not few.isEmpty():
        everything = materialise(minimum_covariance(passed.withColumn("_all", F.lit(0)), "_all"))
        languages = materialise(languages.where(F.col("rows") >= MIN_GROUP).unionByName(_mixed(few, everything, [])))
    return large.unionByName(_mixed(small, languages, ["_lang"])).select("_group", *ESTIMATE)


def _concentrated(rows: DataFrame, estimates: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """One step: estimates from the nearest rows by the present estimates."""
    # a hot group is met in parts, each with its own copy of the few estimates
    copies = estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    far = _distance(rows.join(copies, [group, "_salt"]), "_d")
    binned = far.withColumn("_bin", F.floor(F.log2(1 + F.col("_d")) * BINS))
    # stored, so that a hot group's partial sums are dealt out by bin and only its bins meet
    bins = materialise(binned.groupBy(group, "start", "_bin").agg(*_moments()))
    earlier = Window.partitionBy(group, "start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    wanted = bins.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0.0))).join(sizes, group)
    kept = wanted.where(F.col("_before") < SUPPORT * F.col("rows"))
    # moments to ten digits: the order of a sum cannot move a row over a bin's edge
    summed = kept.groupBy(group, "start").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    return _rounded(_estimate(summed, consistency())).select(group, "start", *ESTIMATE)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 10) for c in ESTIMATE})


def quality_verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Counts and verdict of every document.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` percent
    of them in repeated windows.  Other documents are kept unless their statistics lie
    further from the estimate of their language and source than normal rows do with the
    chance ``tail``.  Documents that failed take no part in an estimate; the estimate of a
    group of fewer than ``MIN_GROUP`` other documents is mixed with that of its
    language, that of so small a language with that of all.  A null text has no
    words; null languages and sources form groups of their own; copies and ties count
    each; an empty table gives no rows; columns other than ``doc_id, text, lang, source``
    are not used.
    """
    named = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source")])
    language = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    counted = text_statistics(docs.select("doc_id", "text", named.alias("_group"), language.alias("_lang"))).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    table = materialise(counted.withColumn("base_failed", failed).select("*", *statistic_vector()))
    salt = F.pmod(F.xxhash64("doc_id", *VECTOR), F.lit(SALTS)).cast("int")
    passed = table.where(~F.col("base_failed")).select("_group", "_lang", salt.alias("_salt"), *VECTOR)
    estimates = materialise(group_estimates(passed))
    judged = _distance(table.join(estimates, "_group", "left"), "distance")
    limit = chi_square_quantile(tail, 4)
    inlying = F.coalesce(F.col("distance") <= limit, F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inlying).alias("kept"), F.round("distance", 6).alias("distance"),
    )
