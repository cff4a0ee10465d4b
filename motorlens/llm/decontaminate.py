"""Benchmark passages in documents by a positional inverted index.

The index is a written table of postings ``(term, document, position)``.  Test phrases
are looked up by their rarest terms: lists of two terms are shifted by the terms' places
in the phrase and intersected, and what they share is checked against the lists of all
terms.  Proximity matches come from the same lists: the rarest terms of a test item
together, in any order, within as many words as the item has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.functions.shipping import by_value
from motorlens.llm.kernels import ALPHANUMERIC, owners, pieces, spans, word_hashes
from motorlens.session import materialise

by_value(__name__)

WINDOW = 10
# largest vocabulary of test terms that every task holds (8 bytes each); beyond it all postings are stored
MOST_TERMS = 4_000_000
# rarest terms whose lists are intersected first
ANCHORS = 2
# rarest terms of an item that make a proximity match
NEAR_TERMS = 4


def _ids() -> Iterator[int]:
    """A number for every row of a task that no other row of the table has."""
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    while True:
        yield row
        row += 1


def _index_kernel(kind: pa.DataType, vocabulary: np.ndarray | None, shortest: int, scattered: bool) -> Callable:
    """Arrow batches ``(id, text)`` to one row per text with the postings that can matter.

    Words of the vocabulary are stored.  Those in runs of at least ``shortest`` of them are
    marked, since a phrase of test terms cannot stand anywhere else; the others are left out
    unless ``scattered`` terms are asked for too.
    """

    def runs(known: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        text = owners(bounds)
        breaks = np.flatnonzero(~known)
        starts = np.zeros(len(known), bool)
        starts[bounds[:-1][bounds[:-1] < len(known)]] = True
        starts[breaks] = True
        starts[breaks[breaks + 1 < len(known)] + 1] = True
        group = np.cumsum(starts) - 1
        long = np.bincount(group, minlength=1) >= shortest
        return known & long[group] if len(text) else known

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids()
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                starts, ends, bounds = spans(data, offsets, ALPHANUMERIC)
                hashes = word_hashes(data, starts, ends, ALPHANUMERIC)
                n = len(offsets) - 1
                kept = known = np.ones(len(hashes), bool)
                if vocabulary is not None and len(hashes):
                    at = np.searchsorted(vocabulary, hashes)
                    at[at == len(vocabulary)] = 0
                    known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                    kept = runs(known, bounds)
                in_run, kept = kept, known if scattered else kept
                where = np.flatnonzero(kept)
                text = owners(bounds)[where]
                lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32))
                places = (where - bounds[:-1][text]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(ids) for _ in range(n)], pa.int64()),
                        batch.column(0).slice(first, n).cast(kind),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.ListArray.from_arrays(lists, pa.array(hashes[where].view(np.int64))),
                        pa.ListArray.from_arrays(lists, pa.array(places)),
                        pa.ListArray.from_arrays(lists, pa.array(in_run[where])),
                    ],
                    names=["row", "id", "n_words", "terms", "positions", "in_run"],
                )

    return kernel


def store_index(texts: DataFrame, vocabulary: np.ndarray | None = None, shortest: int = 1, scattered: bool = False) -> DataFrame:
    """Write the index of ``(id, text)``: a row per text with the parallel lists ``terms``, ``positions`` and ``in_run``."""
    kind = texts.schema["id"].dataType
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()),
        T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.LongType())),
        T.StructField("in_run", T.ArrayType(T.BooleanType())),
    ])
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()
    return materialise(texts.select("id", "text").mapInArrow(_index_kernel(arrow, vocabulary, shortest, scattered), schema))


def postings(index: DataFrame, runs_only: bool = False) -> DataFrame:
    """``(row, term, pos)``, one row per stored word, or per word of a run only."""
    lists = F.arrays_zip("terms", "positions", "in_run")
    if runs_only:
        lists = F.filter(lists, lambda p: p["in_run"])
    pairs = index.where(F.size("terms") > 0).select("row", F.explode(lists).alias("p"))
    return pairs.select("row", F.col("p.terms").alias("term"), F.col("p.positions").alias("pos"))


def _windows(items: DataFrame, size: int) -> DataFrame:
    """``(item, start, w, ipos, term)``: the words of every window; an item of fewer words is one window."""
    sized = items.where("n_words > 0").withColumn("w", F.least(F.col("n_words"), F.lit(size)))
    starts = sized.select("row", "w", "terms", F.explode(F.expr("sequence(0L, n_words - w)")).alias("start"))
    words = starts.select(
        F.col("row").alias("item"), "start", "w",
        F.posexplode(F.slice("terms", (F.col("start") + 1).cast("int"), F.col("w").cast("int"))).alias("k", "term"))
    return words.select("item", "start", "w", (F.col("start") + F.col("k")).alias("ipos"), "term")


def phrase_matches(posted: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(row, item, pos)``: the words of documents inside an occurrence of a window of an item."""
    counts = materialise(posted.groupBy("term").agg(F.count(F.lit(1)).alias("_count")))
    counted = _windows(items, size).join(counts, "term", "left")
    rarest = Window.partitionBy("item", "start").orderBy("_count", "ipos")
    whole = F.min(F.coalesce("_count", F.lit(0))).over(Window.partitionBy("item", "start"))
    anchors = (
        counted.withColumn("_least", whole).where("_least > 0").withColumn("_rank", F.row_number().over(rarest))
        .where(F.col("_rank") <= ANCHORS).select("item", "w", "ipos", "term").distinct()
    )
    met = posted.join(materialise(anchors), "term")
    diagonals = met.groupBy("row", "item", "w", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.count(F.lit(1)).alias("_n"))
    shared = materialise(diagonals.where(F.col("_n") >= F.least(F.col("w"), F.lit(ANCHORS))).drop("_n"))
    terms = items.select(F.col("row").alias("item"), F.posexplode("terms").alias("ipos", "term"))
    expected = shared.join(terms, "item").withColumn("pos", F.col("shift") + F.col("ipos"))
    found = expected.join(posted, ["row", "pos", "term"])
    line = Window.partitionBy("row", "item", "shift").orderBy("ipos")
    run = found.withColumn("_run", F.col("ipos") - F.row_number().over(line))
    length = F.count(F.lit(1)).over(Window.partitionBy("row", "item", "shift", "_run"))
    return run.withColumn("_length", length).where("_length >= w").select("row", "item", "pos").distinct()


def proximity_matches(posted: DataFrame, items: DataFrame, within: int | None = None, terms: int = NEAR_TERMS) -> DataFrame:
    """``(row, item, n_places)``: where the rarest terms of an item stand together, in any order, within so many words.

    Without a distance it is the item's own number of words.  An item with fewer distinct
    words is met by all of them; places are counted by their last word.
    """
    counts = materialise(posted.groupBy("term").agg(F.count(F.lit(1)).alias("_count")))
    span = F.col("n_words") if within is None else F.lit(within)
    distinct = items.select(F.col("row").alias("item"), span.alias("_span"), F.explode(F.array_distinct("terms")).alias("term"))
    ranked = distinct.join(counts, "term", "left").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("_count", F.lit(0)), "term")) - 1)
    # an item with a term that no document has is met nowhere
    whole = Window.partitionBy("item")
    chosen = ranked.where(F.col("_rank") < terms).withColumns(
        {"_terms": F.count(F.lit(1)).over(whole), "_least": F.min(F.coalesce("_count", F.lit(0))).over(whole)})
    wanted = materialise(chosen.where("_least > 0").select("item", "term", "_span", "_rank", "_terms"))
    met = posted.join(wanted, "term")
    so_far = Window.partitionBy("row", "item").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.when(F.col("_terms") <= k, F.col("pos")).otherwise(F.max(F.when(F.col("_rank") == k, F.col("pos"))).over(so_far))
            for k in range(terms)]
    seen = met.withColumns({f"_last{k}": c for k, c in enumerate(last)})
    everything = F.array(*[f"_last{k}" for k in range(terms)])
    near = ~F.exists(everything, lambda x: x.isNull()) & (F.col("pos") - F.array_min(everything) < F.col("_span"))
    return seen.where(near).groupBy("row", "item").agg(F.count(F.lit(1)).alias("n_places"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_terms: int = MOST_TERMS, proximity: bool = False
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every document.

    Words are runs of letters, digits and characters above 0x7F, A-Z in lower case.  A
    window is ``size`` consecutive words of an item, or the whole of a shorter one; a
    document word inside any occurrence is hit.  Null and empty texts have no words and
    no windows.  Repeated documents and items are judged one by one (equal ids of items
    are listed once, null ids not at all); an empty benchmark leaves everything clean;
    an empty table gives no rows; further columns are not used.

    With ``proximity`` the index keeps all test terms, and ``n_near_items`` counts the items
    (repeated ones each) whose rarest terms stand within as many words as the item has;
    they do not make a document contaminated.
    """
    items = store_index(benchmark.select(F.col("item_id").alias("id"), "text"))
    terms = items.select(F.explode("terms").alias("term")).distinct()
    vocabulary = None
    if terms.count() <= most_terms:
        vocabulary = np.sort(terms.toArrow().column("term").combine_chunks().to_numpy().view(np.uint64))
    shortest = items.where("n_words > 0").agg(F.min(F.least("n_words", F.lit(size)))).first()[0] or 1
    shortest = shortest if vocabulary is not None else 1
    index = store_index(docs.select(F.col("doc_id").alias("id"), "text"), vocabulary, shortest, proximity)
    posted = postings(index, runs_only=proximity)
    if vocabulary is None:
        posted = materialise(posted.join(terms, "term", "left_semi"))
    hits = materialise(phrase_matches(posted, items, size))
    words = hits.select("row", "pos").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    found = hits.select("row", "item").distinct().join(items.select(F.col("row").alias("item"), F.col("id").cast("string")), "item")
    listed = found.groupBy("row").agg(F.sort_array(F.collect_set("id")).alias("_items"))
    summary = words.join(listed, "row")
    near = []
    if proximity:
        everywhere = posted if vocabulary is None else postings(index)
        pairs = materialise(proximity_matches(everywhere, items))
        summary = summary.join(pairs.groupBy("row").agg(F.count(F.lit(1)).alias("_near")), "row", "full")
        near = [F.coalesce("_near", F.lit(0)).cast("bigint").alias("n_near_items")]
    summary = materialise(summary)
    nothing = F.array().cast("array<string>")
    return index.select("row", F.col("id").alias("doc_id"), "n_words").join(summary, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("_items", nothing)).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *near,
    )


def without_passages(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents in their own columns without those that hold a window of the benchmark."""
    identity = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), F.lit(31))
    found = contamination(docs.select(identity.alias("doc_id"), "text"), benchmark, size).where("contaminated")
    leave = materialise(found.select(F.col("doc_id").alias("_identity")).distinct())
    rows = docs.select(identity.alias("_identity"), F.struct("*").alias("_row"))
    return rows.join(leave, "_identity", "left_anti").select("_row.*")
