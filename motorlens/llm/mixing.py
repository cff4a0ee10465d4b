"""Mixing sources to target weights by subset sums over document lengths.

Documents are counted by source and exact length.  Of every source the target takes
whole passes and then an even share of every length.  Where a share is no whole number of
documents a seeded draw rounds it, over neighbouring lengths together, so that a document
has the same chance at every length.  The words by which the draw misses the target are
made up by bounded-knapsack dynamic programming over documents of each length in a seeded
order.  Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorlens.functions.shipping import by_value
from motorlens.llm.numbering import first_of_each
from motorlens.session import materialise

by_value(__name__)

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_PASSES = 2
# documents of mean length that the even share leaves to the dynamic programming
SPARE_DOCUMENTS = 4
# sums that the dynamic programming tells apart; beyond them lengths count in larger units, rounded up
MOST_SUMS = 1 << 21


def source_targets(totals: DataFrame) -> DataFrame:
    """``(source_key, source_size, target)`` from ``(source, source_key, source_size)``.

    Sources by code point, null last, weigh ``WEIGHTS`` in turn.  Targets are the common
    level times the weight, or ``MOST_PASSES`` times the source's size where that is
    less; the level is found by taking sources in the order in which they reach their
    limit.  The table has one row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = totals.withColumn("weight", F.get(weights, (F.row_number().over(in_order) - 1) % len(WEIGHTS))).withColumns({
        "limit": MOST_PASSES * F.col("source_size").cast("double"),
    }).withColumn("reach", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("reach", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (TOTAL_SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    levelled = weighed.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("reach"), F.struct("reach", "source_key", "_level"))).over(everything)
    chosen = levelled.withColumn("_at", first["_level"])
    target = F.when(F.col("_at") >= F.col("reach"), F.col("limit")).otherwise(
        F.coalesce(F.least(F.col("_at") * F.col("weight"), F.col("limit")), F.col("limit")))
    return chosen.select("source_key", "source_size", target.alias("target"))


def _drawn(*what: object) -> int:
    """A number below 2**64 for a seed and a name."""
    return int.from_bytes(blake2b("/".join(map(str, what)).encode(), digest_size=8).digest())


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length come nearest below ``budget`` words, by bounded knapsack.

    Reachable sums are the bits of one integer; counts are split into powers of two and
    lengths are tried in their order until the budget is met.
    """
    unit = -(-budget // MOST_SUMS) if budget > MOST_SUMS else 1
    budget //= unit
    reach, mask, path = 1, (1 << (budget + 1)) - 1, []
    for length, count in counts.items():
        if not length:
            continue
        units = -(-length // unit)
        left, piece = min(count, budget // units), 1
        while left > 0 and not reach >> budget & 1:
            piece = min(piece, left)
            path.append((length, units * piece, piece, reach))
            reach |= reach << (units * piece) & mask
            left, piece = left - piece, piece * 2
    at, taken = reach.bit_length() - 1, {}
    for length, units, piece, before in reversed(path):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + piece
            at -= units
    return taken


def even_share(counts: dict[int, int], budget: int, total: int, seed: object) -> dict[int, int]:
    """How many documents of each length an even share of ``budget`` out of ``total`` words takes.

    Whole numbers first.  Of the lengths between two powers of two the remainders are laid
    end to end in a seeded order, and a length whose stretch holds one of the points that
    lie a whole document apart from a seeded first one takes one more: each is rounded up
    with the chance its remainder says, and all of them miss the sum by less than one document.
    """
    taken, bands = {}, {}
    for length, count in counts.items():
        taken[length], remainder = divmod(count * budget, total)
        bands.setdefault(length.bit_length(), []).append((_drawn(seed, length), length, remainder))
    for band, lengths in bands.items():
        at = _drawn(seed, "band", band) % total
        for _, length, remainder in sorted(lengths):
            at += remainder
            if at >= total:
                taken[length] += 1
                at -= total
    return taken


def plan_source(lengths: pd.DataFrame, seed: int = 0) -> pd.DataFrame:
    """The plan of one source: whole passes over all its documents and further documents of each length.

    The frame has a row per distinct length, of which a source of S words has fewer than
    the root of 2 S.
    """
    size, total, target = lengths["size"].tolist(), int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
    count = dict(zip(size, lengths["count"].tolist()))
    passes = min(MOST_PASSES, int(target // total)) if total else 0
    budget = round(target) - passes * total
    taken = dict.fromkeys(size, 0)
    if budget > 0 and passes < MOST_PASSES:
        name = (seed, lengths["source_key"].iloc[0])
        # lengths without words are no part of the share
        spare = SPARE_DOCUMENTS * -(-total // max(1, sum(n for s, n in count.items() if s)))
        taken |= even_share({s: n for s, n in count.items() if s}, max(0, budget - spare), total, name)
        order = sorted((s for s in size if s), key=lambda s: _drawn(*name, "fill", s))
        missed = budget - sum(s * n for s, n in taken.items())
        if missed < 0:
            for s, n in fill({s: taken[s] for s in order}, spare - missed).items():
                taken[s] -= n
                missed += s * n
        for s, n in fill({s: count[s] - taken[s] for s in order}, max(0, missed)).items():
            taken[s] += n
    return pd.DataFrame({
        "source_key": lengths["source_key"], "size": lengths["size"], "count": lengths["count"],
        "source_size": total, "target": target, "passes": passes, "further": [taken[s] for s in size],
    })


PLAN = "source_key string, size bigint, count bigint, source_size bigint, target double, passes bigint, further bigint"


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)`` of every document, taken or not.

    ``size`` is the number of words of the text (null: 0), ``copies`` how often the mix
    takes the document (0 to ``MOST_PASSES``) and ``taken`` the words this makes.  Null
    sources form one source; documents without words are taken by whole passes only and
    add nothing; repeated rows are documents of their own; an empty table gives no rows.
    The choice depends on ids, texts and ``seed`` only.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sized = materialise(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), key.alias("source_key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\t-\\r]+")).cast("bigint").alias("size"),
        F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)).alias("_hash"),
    ))
    lengths = materialise(sized.groupBy("source", "source_key", "size").agg(F.count(F.lit(1)).alias("count")))
    totals = lengths.groupBy("source", "source_key").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
    targets = source_targets(totals)
    planned = lengths.select("source_key", "size", "count").join(targets, "source_key")
    plan = materialise(planned.groupBy("source_key").applyInPandas(lambda lengths: plan_source(lengths, seed), PLAN))
    # the plan grows with the number of lengths, so it is not broadcast
    placed = sized.select("doc_id", "source_key", "size", "_hash").join(plan.hint("merge"), ["source_key", "size"])
    partly = (F.col("further") > 0) & (F.col("further") < F.col("count"))
    chosen = first_of_each(placed.where(partly), ["source_key", "size"], F.col("_hash"), "count", "further", "_first")
    rest = placed.where(~partly).withColumn("_first", F.col("further") > 0)
    copies = F.col("passes") + F.col("_first").cast("bigint")
    return chosen.unionByName(rest).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "_hash",
    )


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: the documents' own columns, one row for every copy that is taken.

    Rows are matched by a hash of id and text; rows that share both share their copies evenly.
    """
    copies = (
        mix_documents(docs, seed).groupBy("_hash").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
        .where("_all > 0")
    )
    hashed = docs.select(
        F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)).alias("_hash"), F.struct("*").alias("_row"))
    same = Window.partitionBy("_hash").orderBy("_hash")
    ranked = hashed.join(materialise(copies), "_hash").withColumn("_rank", F.row_number().over(same))
    times = F.floor(F.col("_all") / F.col("_rows")) + (F.col("_rank") <= F.col("_all") % F.col("_rows")).cast("bigint")
    repeated = ranked.withColumn("_times", times).where("_times > 0").withColumn("_i", F.explode(F.expr("sequence(1L, _times)")))
    return repeated.select("_row.*")
