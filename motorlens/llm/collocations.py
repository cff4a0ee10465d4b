"""Phrases that stand together more often than their parts, from depth-truncated suffix trees.

Every place of a text starts a suffix of at most four words.  The tree of all suffixes is
cut vertically: a prefix of words is taken as it is if no more suffixes than a budget
begin with it, a more frequent one is extended by its next word, level by level.  Suffixes
are dealt out by their prefix, so that a task holds the subtrees of a group of prefixes;
it reads its suffixes in order and builds one subtree after another from them,
independently of all others.  The count of a phrase is the total of the leaves below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorlens.functions.shipping import by_value
from motorlens.llm.kernels import byte_table, mixed, owners, pieces, spans, word_hashes
from motorlens.session import materialise

by_value(__name__)

DEPTH = 4
LEAST = 30
BEST = 2000
SCALE = 2_000_000
# a contained phrase goes if a longer one has so many of its places in 100
CONTAINED_PERCENT = 80
# frequent words that every task holds as sorted codes (8 bytes each); with more, words keep their hashes and suffixes their rare words
MOST_WORDS = 4_000_000
# groups of prefixes for every shuffle partition, and suffixes a partition is meant to read at most
GROUPS_PER_TASK = 4
TASK_SUFFIXES = 8_000_000
# suffixes of a task that are sorted and counted together before they are handed on
TOGETHER = 1_000_000

ENDS = b".,;:!?\n\x0b\x0c\r"
WORDS = byte_table([b for b in range(256) if b not in ENDS and b not in b" \t"])
WORDS[0] = 1
_IS_END = np.isin(np.arange(256), np.frombuffer(ENDS, np.uint8))

UNKNOWN_LANGUAGE = "und"


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _byte_codes(seed: int) -> np.ndarray:
    """The number that a byte counts as in a hash, another one for every seed; a letter A-Z as its small one."""
    return np.random.RandomState(seed).permutation(256).astype(np.uint8)[LOWER]


def _spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Some words in lower case."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    flat = LOWER[data[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, ends - starts)]]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.string())


def _coded(batch: pa.RecordBatch, seed: int) -> Iterator[tuple]:
    """Runs of texts ``(lang, text)`` as ``(languages, language, codes, continues, data, starts, ends)``.

    A code stands for a word of a language; ``continues`` tells whether a word goes on the piece of the word before it.
    """
    languages = batch.column(0).dictionary_encode()
    names = languages.dictionary.cast(pa.string())
    of_row = languages.indices.to_numpy(zero_copy_only=False)
    salts = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest()) for x in names.to_pylist()], np.uint64)
    table = _byte_codes(seed)
    for first, data, offsets in pieces(batch.column(1)):
        starts, ends, bounds = spans(data, offsets, WORDS)
        if not len(starts):
            continue
        text = owners(bounds)
        language = of_row[first + text]
        codes = mixed(word_hashes(data, starts, ends, table) ^ salts[language], seed)
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_IS_END[data], out=breaks[1:])
        continues = np.zeros(len(starts), bool)
        continues[1:] = (text[1:] == text[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
        yield names, language, codes, continues, data, starts, ends


def _word_kernel(seed: int) -> Callable:
    """Arrow batches ``(lang, text)`` to ``(lang, word, code, n)``, one row per distinct word of a run."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, language, codes, _, data, starts, ends in _coded(batch, seed):
                _, at, which, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
                # words that share a code by chance are handed on too, so that the table of words shows it
                other = word_hashes(data, starts, ends, _byte_codes(seed + 1_000_003))
                odd = np.flatnonzero((other != other[at][which]) | (language != language[at][which]))
                at, n = np.append(at, odd), np.append(n, np.zeros(len(odd), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(language[at])), _spelt(data, starts[at], ends[at]), pa.array(codes[at].view(np.int64)),
                     pa.array(n.astype(np.int64))],
                    names=["lang", "word", "code", "n"])

    return kernel


def count_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """The stored table ``(lang, word, code, n)`` of all words, and the seed under which no two of them share a code."""
    seed = 1
    while True:
        counted = texts.mapInArrow(_word_kernel(seed), "lang string, word string, code long, n long")
        words = materialise(counted.groupBy("lang", "word", "code").agg(F.sum("n").alias("n")))
        if words.groupBy("code").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or code = 0").isEmpty():
            return words, seed
        seed += 1


class Keys:
    """Codes of words as parts of binary keys, in which a phrase begins with the key of its beginning.

    With the frequent words at hand a code is a word's place among them, in four bytes, and
    a rare word ends a suffix: no phrase over it can be frequent.  Without them it is the
    word's own code, in eight.
    """

    def __init__(self, frequent: np.ndarray | None) -> None:
        self.frequent = frequent
        self.width = 8 if frequent is None else 4

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes from 1; 0 for a rare word."""
        if self.frequent is None:
            return words
        if not len(self.frequent):
            return np.zeros(len(words), np.uint64)
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return np.where(self.frequent[at] == words, at + 1, 0).astype(np.uint64)

    def write(self, ids: np.ndarray) -> pa.Array:
        """Rows of codes, 0 after their end, as keys."""
        used = ids != 0
        flat = ids[used].astype(f">u{self.width}").view(np.uint8)
        offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1) * self.width)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])

    def read(self, keys: pa.Array) -> np.ndarray:
        """Keys as rows of codes, 0 after their end."""
        if isinstance(keys, pa.ChunkedArray):
            keys = keys.combine_chunks()
        keys = keys.cast(pa.large_binary())
        n = len(keys)
        _, offsets, data = keys.buffers()
        ends = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + n + 1]
        ids = np.zeros((n, DEPTH), np.uint64)
        filled = np.arange(DEPTH) < ((ends[1:] - ends[:-1]) // self.width)[:, None]
        if n and data is not None:
            ids[filled] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(f">u{self.width}")
        return ids


def _hash(ids: np.ndarray) -> np.ndarray:
    """A hash of every row of codes."""
    out = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        out = mixed(out * np.uint64(31) + column)
    return out


class Cut:
    """Where the tree is cut: a prefix is extended by a word while it is a hot one."""

    def __init__(self, hot: set[bytes], keys: Keys) -> None:
        self.levels = []
        for d in range(1, DEPTH):
            known = keys.read(pa.array([h for h in hot if len(h) == d * keys.width], pa.binary()))
            hashes = _hash(known)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two hot prefixes share a hash")
            self.levels.append((hashes[order], known[order]))

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """How many words the prefix of every suffix has."""
        length = np.ones(len(ids), np.int64)
        for d, (hashes, known) in enumerate(self.levels, 1):
            if not len(hashes):
                break
            at = np.flatnonzero(length == d)
            shown = np.where(np.arange(DEPTH) < d, ids[at], np.uint64(0))
            place = np.minimum(np.searchsorted(hashes, _hash(shown)), len(hashes) - 1)
            length[at[(known[place] == shown).all(axis=1)]] = d + 1
        return length


def _suffix_kernel(seed: int, held: object, hot: set[bytes], prefix_words: int | None) -> Callable:
    """Arrow batches ``(lang, text)`` to distinct suffixes and their number in a run of texts.

    With ``prefix_words`` only the first so many words of suffixes that begin with a hot
    prefix of one word less; otherwise whole suffixes with the hash of their prefix.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(held.value)
        cut = Cut(hot, keys)
        waiting: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(waiting)
            waiting.clear()
            if not len(ids):
                return
            order = np.lexsort(ids.T[::-1])
            ids = ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
            at = np.flatnonzero(new)
            ids, n = ids[at], np.diff(np.append(at, len(ids)))
            length = cut.lengths(ids)
            group = _hash(np.where(np.arange(DEPTH) < length[:, None], ids, np.uint64(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.view(np.int64)), keys.write(ids), pa.array(n.astype(np.int64))], names=["prefix", "key", "n"])

        for batch in batches:
            for _, _, words, continues, _, _, _ in _coded(batch, seed):
                codes = keys.codes(words)
                ids = np.zeros((len(codes), DEPTH), np.uint64)
                ids[:, 0] = codes
                goes_on = codes != 0
                for d in range(1, DEPTH):
                    goes_on = goes_on[:-1] & continues[d:] & (codes[d:] != 0)
                    ids[: len(goes_on), d] = np.where(goes_on, codes[d:], np.uint64(0))
                # words alone are counted already
                ids = ids[ids[:, 1] != 0]
                if prefix_words:
                    ids = ids[(cut.lengths(ids) == prefix_words) & (ids[:, prefix_words - 1] != 0)]
                    ids[:, prefix_words:] = 0
                waiting.append(ids)
                if sum(map(len, waiting)) >= TOGETHER:
                    yield from counted()
        if waiting:
            yield from counted()

    return kernel


SUFFIXES = "prefix long, key binary, n long"


def _subtree_kernel(held: object, hot: set[bytes], least: int) -> Callable:
    """Suffixes in the order of their keys to the counts of the phrases below their prefixes.

    A subtree's path that a batch begins or ends with may go on in the next one, so its
    counts are handed on as they are and summed afterwards.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(held.value)
        cut = Cut(hot, keys)
        for batch in batches:
            ids = keys.read(batch.column(0))
            leaves = batch.column(1).to_numpy()
            if not len(ids):
                continue
            prefix = cut.lengths(ids)
            changed = np.ones(len(ids), bool)
            for d in range(1, DEPTH + 1):
                new = ids[1:, d - 1] != ids[:-1, d - 1]
                changed[1:] = new if d == 1 else changed[1:] | new
                at = np.flatnonzero(changed)
                totals = np.add.reduceat(leaves, at)
                kept = totals >= least
                kept[[0, -1]] = True
                kept &= (ids[at, d - 1] != 0) & (prefix[at] <= d) & (d > 1)
                at = at[kept]
                phrase = np.where(np.arange(DEPTH) < d, ids[at], np.uint64(0))
                yield pa.RecordBatch.from_arrays(
                    [keys.write(phrase), pa.array(np.full(len(at), d, np.int32)), pa.array(totals[kept])], names=["key", "words", "a"])

    return kernel


NODES = "key binary, words int, a long"


def _codes_kernel(held: object) -> Callable:
    """Codes of frequent words to their keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(held.value)
        for batch in batches:
            codes = keys.codes(batch.column(0).to_numpy().view(np.uint64))
            ids = np.zeros((len(codes), DEPTH), np.uint64)
            ids[:, 0] = codes
            yield pa.RecordBatch.from_arrays([keys.write(ids), *batch.columns[1:]], names=["key", "lang", "word", "a"])

    return kernel


def phrase_counts(texts: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, groups: int | None = None) -> tuple[DataFrame, ...]:
    """Frequent phrases from the subtrees: ``(nodes, named, totals, hot, width)``.

    ``nodes``: ``(key, words, a)`` of every phrase of 1 to 4 words with at least so many
    places; ``named``: ``(key, lang, word, a)`` of the single words; ``totals``: words of
    every language; ``hot``: phrases above the budget, at most as many as groups on every
    level; ``width``: bytes of a word in a key.
    """
    spark = texts.sparkSession
    words, seed = count_words(texts)
    frequent = words.where(F.col("n") >= least)
    # without ordering anything: as many rows as are held at most, and one more
    codes = frequent.select("code").limit(most_words + 1).toArrow().column("code").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(np.sort(codes) if len(codes) <= most_words else None)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SUFFIXES))
    budget = max(least, total // (groups or GROUPS_PER_TASK * tasks))
    named = materialise(frequent.select("code", "lang", "word", "n").mapInArrow(_codes_kernel(held), "key binary, lang string, word string, a long"))
    above: list[tuple[bytes, int]] = [(bytes(r[0]), r[1]) for r in named.where(F.col("a") > budget).select("key", "a").collect()]
    hot = {key for key, _ in above}
    tables = [named.select("key", F.lit(1).alias("words"), "a")]
    newest = hot
    for d in range(2, DEPTH):
        if not newest:
            break
        extended = texts.mapInArrow(_suffix_kernel(seed, held, hot, d), SUFFIXES)
        level = materialise(extended.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") > budget))
        found = [(bytes(r[0]), r[1]) for r in level.collect()]
        newest = {key for key, _ in found}
        # what is extended again is counted here, other phrases in their subtrees
        tables.append(level.select("key", F.lit(d).alias("words"), "a"))
        above += found
        hot = hot | newest
    suffixes = texts.mapInArrow(_suffix_kernel(seed, held, hot, None), SUFFIXES)
    dealt = suffixes.repartition(tasks, "prefix").sortWithinPartitions("key")
    subtrees = dealt.select("key", "n").mapInArrow(_subtree_kernel(held, hot, least), NODES)
    tables.append(subtrees.groupBy("key", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
    nodes = tables[0]
    for table in tables[1:]:
        nodes = nodes.unionByName(table)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    hot_nodes = spark.createDataFrame(above, "_part binary, _known long")
    return materialise(nodes), named, totals, hot_nodes, 8 if held.value is None else 4


def _looked_up(rows: DataFrame, part: str, table: DataFrame, hot: DataFrame, into: str) -> DataFrame:
    """Counts of the phrases in a column: hot ones from the small table that every task holds, others by a shuffle."""
    known = rows.join(F.broadcast(hot.select(F.col("_part").alias(part), "_known")), part, "left")
    # a hot phrase has its count and is dealt out by its row
    keyed = known.withColumn("_at", F.when(F.col("_known").isNull(), F.col(part)).otherwise(F.concat(F.col("key"), F.lit(b"\0"))))
    met = keyed.join(table.select(F.col("key").alias("_at"), F.col("a").alias("_met")), "_at", "left")
    return met.withColumn(into, F.coalesce("_known", "_met")).drop("_known", "_at", "_met")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, most_words: int = MOST_WORDS, groups: int | None = None) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``best`` phrases of 2 to 4 words of every language.

    A-Z count as a-z, pieces end at ``. , ; : ! ?`` and line breaks, words at spaces and
    tabs.  ``a``, ``l`` and ``r`` are all places of a phrase and of the two parts of its
    weakest cut (the first such cut), ``score`` is floor(2000000 a / (l + r)).  Phrases
    inside a longer candidate with 80 % of their places or more are left out.  Order:
    score and ``a`` descending, phrase by bytes.  Null and empty texts hold no words; null
    languages count as ``und``; equal rows count each; an empty table gives no rows;
    further columns are not used.

    A prefix is hot above the number of words over ``groups`` (4 for every shuffle
    partition unless given), so at most as many prefixes of a length are hot.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANGUAGE)).alias("lang"), "text")
    nodes, named, totals, hot, width = phrase_counts(texts, least, most_words, groups)
    candidates = nodes.where("words > 1")
    cuts = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({
        "_first": F.expr(f"substring(key, 1, _k * {width})"), "_rest": F.expr(f"substring(key, _k * {width} + 1)")})
    counted = _looked_up(_looked_up(cuts, "_first", nodes, hot, "l"), "_rest", nodes, hot, "r")
    # the product may pass 64 bits, the score does not
    share = F.expr(f"(cast(a as decimal(20,0)) * cast({SCALE} as decimal(7,0))) div cast(l + r as decimal(20,0))")
    weakest = counted.withColumn("score", share).groupBy("key", "words", "a").agg(
        F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
    inside = (
        candidates.where("words > 2").withColumn("_length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("_length"))))
        .groupBy(F.expr(f"substring(key, _from * {width} + 1, _length * {width})").alias("key")).agg(F.max("a").alias("_longer")))
    left = weakest.join(inside, "key", "left").where(
        F.coalesce(F.col("_longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * CONTAINED_PERCENT, F.lit(True)))
    left = materialise(left.select("key", "words", "a", "_cut"))
    places = left.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("words") - 1)))
    places = places.withColumn("_word", F.expr(f"substring(key, _i * {width} + 1, {width})"))
    # the spelling of a hot word is with every task, others are met by a shuffle
    hot_words = F.broadcast(named.join(F.broadcast(hot.select(F.col("_part").alias("key"))), "key", "left_semi").select(
        F.col("key").alias("_word"), F.struct("lang", "word").alias("_hot")))
    known = places.join(hot_words, "_word", "left")
    known = known.withColumn("_at", F.when(F.col("_hot").isNull(), F.col("_word")).otherwise(F.concat(F.col("key"), F.lit(b"\0"))))
    spelt = known.join(named.select(F.col("key").alias("_at"), F.struct("lang", "word").alias("_met")), "_at", "left")
    phrases = spelt.select("key", "a", "_cut", "_i", F.coalesce("_hot", "_met").alias("_name")).groupBy("key", "a", "_cut").agg(
        F.min("_name.lang").alias("lang"), F.array_sort(F.collect_list(F.struct("_i", F.col("_name.word").alias("word")))).alias("_words"))
    ranked = phrases.select(
        "lang", F.array_join(F.col("_words.word"), " ").alias("phrase"), "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"),
        F.col("_cut.score").cast("bigint").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= best)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
