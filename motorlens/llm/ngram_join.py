"""Near-duplicate texts by an n-gram Jaccard join over a MinHash LSH forest.

Every text is a set of word shingles.  A forest of prefix tries over MinHash signatures
proposes candidates: texts that share a prefix in some tree.  Matched prefixes are
shortened, from the longest on, until pairs at the threshold are met with the target
recall.  Candidates that hang together are compared exactly, each text once for its
group; groups too large for one task are compared block by block.  Equal sets are one
class throughout, and no pair of texts is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorlens.functions.shipping import by_value
from motorlens.llm.kernels import UNSPACED, mixed, pieces, spans, word_hashes
from motorlens.operators.clusters import connected_components
from motorlens.session import materialise

by_value(__name__)

SHINGLE_WORDS = 5
# the similarity as a fraction
THRESHOLD = (4, 5)
TREES = 40
LONGEST_PREFIX = 12
TARGET_RECALL = 0.99999
# texts of one candidate group that are compared in one task, and texts of small groups that share a task
BLOCK_TEXTS = 1000
TASK_TEXTS = 2000
# shingles that are hashed or compared at a time
SLICE = 4096


def recall_at(depth: int, similarity: float, trees: int = TREES) -> float:
    """The chance that two texts share a prefix of this length in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(trees: int = TREES, longest: int = LONGEST_PREFIX, target: float = TARGET_RECALL) -> int:
    """Shorten the matched prefix until pairs at the threshold are met with the target recall."""
    depth = longest
    while depth > 1 and recall_at(depth, THRESHOLD[0] / THRESHOLD[1], trees) < target:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; fewer words than a shingle has are one shingle."""
    starts, ends, bounds = spans(data, offsets, UNSPACED)
    words = word_hashes(data, starts, ends, UNSPACED)
    factors = mixed(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64), 0xA0761D6478BD642F) | np.uint64(1)
    count = max(len(words) - SHINGLE_WORDS + 1, 0)
    hashed = np.zeros(count, np.uint64)
    for j in range(SHINGLE_WORDS):
        hashed += words[j : j + count] * factors[j]
    hashed = mixed(hashed)
    sets = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if last - first >= SHINGLE_WORDS:
            sets.append(np.unique(hashed[first : last - SHINGLE_WORDS + 1]))
        elif last > first:
            short = words[first:last]
            sets.append(mixed((short * factors[: len(short)]).sum(keepdims=True), len(short)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def prefix_keys(shingles: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For every tree one number for the first ``depth`` MinHash values of a set."""
    rows = trees * depth
    masks = mixed(np.arange(1, rows + 1, dtype=np.uint64), 0x2545F4914F6CDD1D)
    xors, factors = (masks >> np.uint64(32)).astype(np.uint32)[:, None], (masks.astype(np.uint32) | np.uint32(1))[:, None]
    least = np.full(rows, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), SLICE):
        part = short[None, at : at + SLICE] ^ xors
        part *= factors
        np.minimum(least, part.min(axis=1), out=least)
    values = least.reshape(trees, depth).astype(np.uint64)
    keys = np.zeros(trees, np.uint64)
    for level in range(depth):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, level], level + 1)
    return keys


def _sketch_kernel(trees: int, depth: int) -> Callable:
    """Batches ``(id columns .., text)`` to set fingerprint, size and the prefix keys of all trees."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.num_columns - 1
            for first, data, offsets in pieces(batch.column(width)):
                sets = shingle_sets(data, offsets)
                full = [len(s) > 0 for s in sets]
                marks = [(mixed(s, 0x8EBC6AF09C88C6E3).sum(), np.bitwise_xor.reduce(mixed(s, 0x589965CC75374CC3))) for s in sets]
                keys = [prefix_keys(s, trees, depth) if len(s) else np.zeros(0, np.uint64) for s in sets]
                lists = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                pick = lambda i: pa.array(np.array([m[i] for m in marks], np.uint64).view(np.int64), mask=~np.array(full))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(first, len(sets)) for i in range(width)],
                        pick(0), pick(1), pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(np.concatenate(keys).view(np.int64))),
                    ],
                    names=[*batch.schema.names[:-1], "mark1", "mark2", "n_shingles", "keys"],
                )

    return sketch


def text_identity(docs: DataFrame) -> Column:
    """A number for a document's id and text; rows that share it are the same document."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), F.lit(31))


def compare(texts: list[np.ndarray], sides: np.ndarray | None = None) -> np.ndarray:
    """Which sets are similar enough, as a square table; with ``sides``, only pairs from different sides."""
    sizes = np.array([len(t) for t in texts])
    every = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(texts), len(texts)), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + SLICE, SLICE))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        table = np.zeros((len(texts), SLICE), np.float32)
        table[owner[a:b], column[a:b] - i * SLICE] = 1
        common += table @ table.T
    up, down = THRESHOLD
    # |a & b| / |a | b| >= up / down, in whole numbers
    linked = common.astype(np.int64) * (up + down) >= up * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if sides is not None:
        linked &= sides[:, None] != sides[None, :]
    return linked


def _joined(linked: np.ndarray) -> np.ndarray:
    """For every row the smallest row that links lead to."""
    labels = np.arange(len(linked))
    while True:
        least = np.minimum(labels, np.where(linked, labels[None, :], len(labels)).min(axis=1))
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def _verify(frame: pd.DataFrame) -> pd.DataFrame:
    """All comparisons of one task: links of every text and the text its links lead to."""
    column = pa.array(frame["text"], pa.string())
    sets: list[np.ndarray] = []
    for _, data, offsets in pieces(column):
        sets += shingle_sets(data, offsets)
    nodes, rows = frame["node"].to_numpy(), []
    for (_, low, high), places in frame.groupby(["component", "low", "high"], sort=True).indices.items():
        places = places[np.argsort(nodes[places], kind="stable")]
        # a document that stands in the table more than once is compared once
        places = places[np.concatenate([[True], nodes[places][1:] != nodes[places][:-1]])]
        sides = frame["block"].to_numpy()[places] if low != high else None
        linked = compare([sets[i] for i in places], sides)
        labels = _joined(linked)
        rows.append(pd.DataFrame({"node": nodes[places], "links": linked.sum(axis=1), "label": nodes[places][labels]}))
    return pd.concat(rows) if rows else pd.DataFrame({"node": [], "links": [], "label": []})


def _candidate_groups(classes: DataFrame) -> DataFrame:
    """``(node, component)``: classes that hang together by shared prefixes."""
    entries = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = entries.groupBy("tree", "key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    edges = entries.join(materialise(shared.drop("_n")), ["tree", "key"]).select(F.col("node").alias("u"), F.col("first").alias("v"))
    return connected_components(edges.where("u <> v").distinct())


def similarity_classes(docs: DataFrame, trees: int = TREES, target: float = TARGET_RECALL) -> DataFrame:
    """``(identity, doc_id, class_id, n_links, n_copies, n_shingles, keep)`` of every document.

    Texts are sets of runs of five words (split at spaces and the characters 0x09-0x0D, A-Z
    in lower case).  Documents are in one class when a chain of pairs with a Jaccard
    similarity of 0.8 or more joins them; the class is named by its smallest id.
    ``n_links`` counts the other distinct sets within the threshold, ``n_copies`` the
    documents with exactly this set, and ``keep`` marks one document of each class (two
    rows that agree in id and text are both marked).  Texts of one to four words are one
    shingle.  Null and empty texts are alone in a class and have no links.  Null ids
    sort last.  An empty table gives no rows; further columns are not used.
    """
    depth = prefix_length(trees, target=target)
    kind = docs.schema["doc_id"].dataType.simpleString()
    identified = docs.select(text_identity(docs).alias("identity"), "doc_id", "text")
    schema = f"identity bigint, doc_id {kind}, mark1 bigint, mark2 bigint, n_shingles bigint, keys array<bigint>"
    sketches = materialise(identified.mapInArrow(_sketch_kernel(trees, depth), schema))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("identity"))
    classes = materialise(
        sketches.where(F.col("n_shingles") > 0).groupBy("mark1", "mark2")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n_copies"), F.first("keys").alias("keys"))
        .withColumn("node", F.col("first.identity"))
    )
    groups = materialise(_candidate_groups(classes))
    # stored, so that a join with a hot group can be split
    sizes = materialise(groups.groupBy("component").agg(F.count(F.lit(1)).alias("_n")))
    blocks = F.ceil(F.col("_n") / BLOCK_TEXTS).cast("int")
    members = (
        groups.join(sizes, "component").withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "component", "blocks", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    members = materialise(members)
    total = members.count()
    tasks = F.when(F.col("blocks") > 1, F.xxhash64("component", "low", "high")).otherwise(
        F.pmod(F.xxhash64("component"), F.lit(max(1, -(-total // TASK_TEXTS)))))
    # candidates are a share of all texts, so they are met by a shuffle at every size
    texts = identified.select(F.col("identity").alias("node"), "text").join(members.hint("merge"), "node").withColumn("task", tasks)
    compared = materialise(texts.groupBy("task").applyInPandas(_verify, "node bigint, links bigint, label bigint"))
    links = compared.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("label").alias("label"))
    large = members.where("blocks > 1").select("node").distinct()
    if not large.isEmpty():
        # groups compared block by block: what their blocks found is joined once more
        chains = compared.join(large, "node", "left_semi").select(F.col("node").alias("u"), F.col("label").alias("v"))
        across = materialise(connected_components(chains.where("u <> v")))
        links = links.join(across, "node", "left").select("node", "n_links", F.coalesce("component", "label").alias("label"))
    named = classes.select("mark1", "mark2", "first", "n_copies", "node").join(links, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    named = materialise(named)
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    result = named.join(heads, "label").select("mark1", "mark2", "head", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    joined = sketches.drop("keys").join(materialise(result), ["mark1", "mark2"], "left")
    return joined.select(
        "identity", "doc_id", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"), "n_shingles",
        F.coalesce(F.col("head.identity") == F.col("identity"), F.lit(True)).alias("keep"),
    )


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The documents in their own columns, one of each class; rows equal in id and text count as one."""
    kept = materialise(similarity_classes(docs).where("keep").select(F.col("identity").alias("_identity")).distinct())
    rows = docs.select(text_identity(docs).alias("_identity"), F.struct("*").alias("_row"))
    return rows.join(kept, "_identity", "left_semi").dropDuplicates(["_identity"]).select("_row.*")
