"""How filters interact: who removes what, in every order of five filters.

The filters' failures of a document are a mask of five bits.  Spark counts the masks of a
part; the 32 counts become a count-weighted decision diagram with one level per filter,
whose nodes know how many documents lie below them.  All orders follow from one another
by swapping two neighbouring levels, which rebuilds only these two.  In each order the
path on which every filter passes gives the steps: what lies below the failing edge of a
node on it is removed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.functions.shipping import by_value
from motorlens.session import materialise

by_value(__name__)

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SYMBOLS = r"[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"

STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")

# documents, those of good quality and toxic ones
Weight = tuple[int, ...]
NOTHING: Weight = (0, 0, 0)


def _sum(a: Weight, b: Weight) -> Weight:
    return tuple(x + y for x, y in zip(a, b))


class Diagram:
    """A decision diagram over the failures of filters, with equal subdiagrams of a level held once.

    ``levels[i]`` holds the nodes of the i-th filter in the present order as pairs
    ``(failing child, passing child)`` of places in the level below; the last level
    holds the distinct weights of masks.
    """

    def __init__(self, weights: dict[int, Weight], filters: str = FILTERS) -> None:
        self.order = list(filters)
        below = [weights.get(mask, NOTHING) for mask in range(1 << len(filters))]
        leaves = sorted(set(below))
        places = [leaves.index(w) for w in below]
        self.levels: list[list[tuple[int, int]]] = [[] for _ in filters]
        self.weights: list[list[Weight]] = [[] for _ in filters] + [leaves]
        # bit k of a mask is the k-th filter, so the last filter halves the list
        for level in reversed(range(len(filters))):
            half = len(places) // 2
            pairs = list(zip(places[half:], places[:half]))
            self.levels[level] = sorted(set(pairs))
            at = {pair: i for i, pair in enumerate(self.levels[level])}
            places = [at[pair] for pair in pairs]
            self._weigh(level)

    def _weigh(self, level: int) -> None:
        below = self.weights[level + 1]
        self.weights[level] = [_sum(below[fails], below[passes]) for fails, passes in self.levels[level]]

    def swap(self, level: int) -> None:
        """Exchange a level with the one below; nodes above and further below stay as they are."""
        lower, at, upper = self.levels[level + 1], {}, []
        for fails, passes in self.levels[level]:
            (ff, fp), (pf, pp) = lower[fails], lower[passes]
            upper.append(tuple(at.setdefault(pair, len(at)) for pair in ((ff, pf), (fp, pp))))
        self.levels[level], self.levels[level + 1] = upper, list(at)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self._weigh(level + 1)

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """``(filter, kept, removed)`` along the path on which all filters pass."""
        node = 0
        for level, name in enumerate(self.order):
            fails, node = self.levels[level][node]
            yield name, self.weights[level + 1][node], self.weights[level + 1][fails]


def neighbour_swaps(n: int) -> Iterator[int]:
    """Levels to swap one after another so that all orders of n filters come up once each (plain changes)."""
    if n < 2:
        return
    down = True
    for inner in [*neighbour_swaps(n - 1), None]:
        yield from (reversed(range(n - 1)) if down else range(n - 1))
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


def _audit_part(part: str, weights: dict[int, Weight], filters: str = FILTERS) -> pd.DataFrame:
    """One row per order and step of a part."""
    fails = {f: sum(w[0] for mask, w in weights.items() if mask >> k & 1) for k, f in enumerate(filters)}
    alone = {f: weights.get(1 << k, NOTHING)[0] for k, f in enumerate(filters)}
    diagram, rows, shapley = Diagram(weights, filters), [], dict.fromkeys(filters, 0)
    for swap in [None, *neighbour_swaps(len(filters))]:
        if swap is not None:
            diagram.swap(swap)
        order = "".join(diagram.order)
        for step, (f, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[f] += removed[0]
            rows.append((part, order, step, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], f))
    return pd.DataFrame([(*row[:-1], shapley[row[-1]]) for row in rows], columns=[c.split()[0] for c in STEPS.split(", ")])


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: too few words, too few different words, too many capitals, a symbol."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("bigint")
    tests = [
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)).cast("bigint") * 100 < n * LEAST_DISTINCT_PERCENT,
        F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("bigint") * 100 > F.length(text).cast("bigint") * MOST_CAPITALS_PERCENT,
        F.regexp_like(text, F.lit(SYMBOLS)),
    ]
    return sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of every part by what they fail.

    Only a number, two flags and the digest of a text are shuffled.  Documents are counted
    by everything but their id before copies of a text meet, so a text that a third of all
    documents share is a few rows; ids that are null are dealt out by their text.
    """
    known = F.col("doc_id").isNotNull()
    marks = labels.where(known).groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic")).withColumn("_salt", F.lit(0))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text_mask(text).alias("_mask"),
        F.sha2(text.cast("binary"), 256).alias("_digest"),
        F.when(known, 0).otherwise(F.pmod(F.xxhash64("text"), F.lit(1024)).cast("int")).alias("_salt"))
    marked = rows.join(marks, ["doc_id", "_salt"], "left").select(
        "doc_id", "part", "_mask", "_digest", F.coalesce("_good", F.lit(False)).alias("_good"), F.coalesce("_toxic", F.lit(False)).alias("_toxic"))
    alike = ["part", "_mask", "_digest", "_good", "_toxic"]
    ids = marked.groupBy("doc_id", *alike).agg(F.count(F.lit(1)).alias("_n"))
    # the least id, and how many rows have it
    kinds = materialise(ids.groupBy(*alike).agg(
        F.sum("_n").alias("_n"), F.min("doc_id").alias("_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("_n")).otherwise(0)).alias("_without"),
        F.min_by("_n", "doc_id").alias("_at_least")))
    least = kinds.groupBy("_digest").agg(F.min("_least").alias("_first"))
    # neither a first document nor one without id is a copy of a smaller one
    first = F.when(F.col("_least") == F.col("_first"), F.col("_at_least")).otherwise(0) + F.col("_without")
    both = kinds.join(least, "_digest").select(
        "part", "_good", "_toxic",
        F.explode(F.array(
            F.struct(F.col("_mask").alias("mask"), first.alias("n")),
            F.struct((F.col("_mask") + F.lit(1 << 4)).alias("mask"), (F.col("_n") - first).alias("n")))).alias("_m"))
    n = F.col("_m.n")
    return both.groupBy("part", F.col("_m.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("_good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_toxic"), n).otherwise(0)).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    Filters: A under 100 words, B fewer than 80 distinct words in 100, C more than 10
    capitals A-Z in 100 characters, D a symbol, E the text of a smaller ``doc_id``.  A part
    is a language, without one the empty string.  Null texts count as empty ones (and as
    copies of each other).  A repeated row is a document of its own; rows of one id and
    one text are no copies of each other.  A document without id is not a copy and has no
    labels; of several label rows of an id any good or toxic one counts.  An empty table
    has no parts; further columns are not used.  A part's diagram has at most 32 leaves,
    whatever the number of documents.
    """

    def audited(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        weights = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])}
        return _audit_part(key[0], weights)

    return mask_counts(docs, labels).groupBy("part").applyInPandas(audited, STEPS)
