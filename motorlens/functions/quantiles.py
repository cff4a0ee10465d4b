"""Exact interpolated quantiles that never hold one group's values in one place.

Spark's ``percentile`` keeps every distinct value of a group in one reducer.  For
groups that grow with the data this module works in two steps instead: a
bounded-size sketch brackets each wanted rank; then values below the bracket are
only counted, and the few inside it are counted by value and ranked, split into
sub-ranges so that a bracket is shared by many tasks.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlens.session import materialise

ACCURACY = 2_000
# The sketch promises a rank error below n / ACCURACY; several times that is the margin kept around a rank.
MARGIN = 6.0 / ACCURACY
SUBRANGES = 256
# Below this count a rank or two matters more than the margin, and the whole group is the bracket.
SMALL_GROUP = 2_000


def _bounds(probs: list[float]) -> list[float]:
    return [q for p in probs for q in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]


def _ranked(inside: DataFrame, group: list[str], below: DataFrame, rank: Column, lo: Column, hi: Column) -> DataFrame:
    """Quantile per group from ``(group..., _v)`` rows inside the bracket and the counts below it.

    ``below`` carries the group, ``_below`` and whatever ``rank``, ``lo`` and ``hi`` need.
    The counted values are stored, because sub-range totals and ranks both read them.
    """
    counted = materialise(inside.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")))
    span = hi - lo
    part = F.when(
        span > 0, F.greatest(F.lit(0), F.least(F.lit(SUBRANGES - 1), F.floor((F.col("_v") - lo) / span * SUBRANGES)))
    ).otherwise(F.lit(0))
    placed = counted.join(below, group).withColumn("_part", part.cast("int")).withColumn("_rank", rank)
    parts = placed.groupBy(*group, "_part").agg(F.sum("_c").alias("_pc"), F.max("_below").alias("_below"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *group, "_part", (F.col("_below") + F.coalesce(F.sum("_pc").over(earlier), F.lit(0))).alias("_before")
    )
    running = Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        placed.withColumn("_upto", F.sum("_c").over(running))
        .join(starts, [*group, "_part"])
        .withColumn("_upto", F.col("_upto") + F.col("_before"))
        .withColumn("_from", F.col("_upto") - F.col("_c"))
    )

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_from") <= position) & (F.col("_upto") > position), F.col("_v")))

    lower, upper = F.floor("_rank"), F.ceil("_rank")
    picked = ranked.groupBy(*group).agg(
        at(lower).alias("_a"), at(upper).alias("_b"), F.max("_rank").alias("_rank"), F.max("n").alias("n")
    )
    found = F.col("_a") + (F.col("_rank") - F.floor("_rank")) * (F.col("_b") - F.col("_a"))
    return picked.select(*group, "n", found.alias("quantile"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Rows ``(keys..., prob, n, quantile)`` with linear interpolation between ranks; NULLs are ignored.

    Runs three scans of the input, each stored as a small table: sketches, counts
    below the brackets, values inside them.
    """
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(q) for q in _bounds(probs)]), ACCURACY).alias("_q"),
    )
    small = F.col("n") < SMALL_GROUP
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                (F.lit(p) * (F.col("n") - 1)).alias("rank"),
                F.when(small | F.lit(p - MARGIN <= 0), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                F.when(small | F.lit(p + MARGIN >= 1), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    targets = materialise(sketch.select(*keys, "n", wanted.alias("_wanted")))
    if keys:
        paired = values.join(targets, keys)
    else:
        # the whole input has one sketch row, read as a scalar subquery
        whole = targets.select(F.struct("n", "_wanted")).scalar()
        paired = values.withColumn("_whole", whole).select("_v", "_whole.n", "_whole._wanted")
    v = F.col("_v")
    counts = paired.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("_wanted").alias("_wanted"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.array(*[F.count_if(v < F.col("_wanted")[i]["lo"]) for i in range(len(probs))]).alias("_belows"),
        F.array(*[F.count_if(v <= F.col("_wanted")[i]["hi"]) for i in range(len(probs))]).alias("_uptos"),
    )
    listed = counts.select(*keys, "n", "_min", "_max", "_belows", "_uptos", F.inline("_wanted")).withColumns(
        {"_below": F.col("_belows")[F.col("i")], "_upto": F.col("_uptos")[F.col("i")]})
    # a sketch may miss a rank after very many merges; such a bracket is opened to the end it missed
    low, high = F.col("_below") > F.floor("rank"), F.col("_upto") <= F.ceil("rank")
    below = materialise(listed.select(
        *keys, "n", "i", "rank", F.when(low, F.col("_min")).otherwise(F.col("lo")).alias("lo"),
        F.when(high, F.col("_max")).otherwise(F.col("hi")).alias("hi"), F.when(low, 0).otherwise(F.col("_below")).alias("_below"),
    ))
    brackets = below.groupBy(*keys).agg(F.collect_list(F.struct("i", "lo", "hi")).alias("_brackets"))
    if keys:
        met = values.join(materialise(brackets), keys)
    else:
        met = values.withColumn("_brackets", brackets.select("_brackets").scalar())
    hits = F.filter("_brackets", lambda t: (v >= t["lo"]) & (v <= t["hi"]))
    inside = met.select(*keys, "_v", F.explode(hits).alias("_t")).select(*keys, F.col("_t.i").alias("i"), "_v")
    found = _ranked(inside, [*keys, "i"], below, F.col("rank"), F.col("lo"), F.col("hi"))
    labels = F.array(*[F.lit(p) for p in probs])
    return found.select(*keys, labels[F.col("i")].alias("prob"), "n", "quantile")


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, dict[float, float]]:
    """Exact quantiles of many columns of one frame, as plain numbers; a column without values is left out.

    Three scans whatever the number of columns: sketches, counts below the
    brackets, values inside them.  Rows are not multiplied by the columns.
    """
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    bounds = F.array(*[F.lit(q) for q in _bounds(probs)])
    sketch = typed.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"),
                F.percentile_approx(c, bounds, ACCURACY).alias("q"),
            ).alias(c)
            for c in columns
        ]
    ).first()
    targets = []
    for c in columns:
        n = sketch[c]["n"]
        for i, p in enumerate(probs):
            if n:
                whole = n < SMALL_GROUP
                lo = sketch[c]["low"] if whole or p - MARGIN <= 0 else sketch[c]["q"][2 * i]
                hi = sketch[c]["high"] if whole or p + MARGIN >= 1 else sketch[c]["q"][2 * i + 1]
                targets.append((c, p, n, lo, hi))
    if not targets:
        return {}
    outside = typed.agg(
        *[F.count_if(F.col(c) < F.lit(lo)).alias(f"b{k}") for k, (c, _, _, lo, _) in enumerate(targets)],
        *[F.count_if(F.col(c) <= F.lit(hi)).alias(f"u{k}") for k, (c, _, _, _, hi) in enumerate(targets)],
    ).first()
    belows = {}
    for k, (c, p, n, lo, hi) in enumerate(targets):
        rank, belows[f"b{k}"] = p * (n - 1), outside[f"b{k}"]
        # a bracket that missed its rank is opened to the end it missed
        if outside[f"b{k}"] > math.floor(rank):
            lo, belows[f"b{k}"] = sketch[c]["low"], 0
        if outside[f"u{k}"] <= math.ceil(rank):
            hi = sketch[c]["high"]
        targets[k] = (c, p, n, lo, hi)
    spark = df.sparkSession
    below = spark.createDataFrame(
        [(k, n, p * (n - 1), lo, hi, belows[f"b{k}"]) for k, (_, p, n, lo, hi) in enumerate(targets)],
        "k int, n bigint, rank double, lo double, hi double, _below bigint",
    )
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).between(lo, hi), F.struct(F.lit(k).alias("k"), F.col(c).alias("_v")))
                for k, (c, _, _, lo, hi) in enumerate(targets)
            ]
        )
    )
    inside = typed.select(F.inline(hits))
    rows = _ranked(inside, ["k"], below, F.col("rank"), F.col("lo"), F.col("hi")).collect()
    found: dict[str, dict[float, float]] = {}
    for row in rows:
        c, p, *_ = targets[row["k"]]
        found.setdefault(c, {})[p] = row["quantile"]
    return found
