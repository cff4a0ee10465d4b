"""Scores of texts by a probabilistic suffix tree, beside a unigram base.

The tree predicts the next byte of a text (words in lower case, one space behind each,
one end) from the contexts before it, up to ``LONGEST`` bytes.  A context is retained when
it is seen often enough and its next bytes diverge from those after its ending, one byte
shorter; its counts are smoothed towards the chances after its longest retained ending.
An ending of a retained context that is not retained itself stays as an empty step.

The tree grows with the texts and is a stored table.  A gram, a context with the byte that
follows, is written nearest byte first, so that a context begins with its endings: sorted
grams are the suffix tree.  They are dealt out by a short ending; a task reads all longer
contexts of its endings off the sorted grams, and only retained ones are stored.  The
shorter levels come from the few counts that are left of this ending, in the same way.
Grams travel in compressed runs.

Texts meet the tree where they lie as far as every task can hold it, the most frequent
contexts first.  Grams whose first context beyond that may exist, which a filter of hashed
bits tells, travel in compressed runs to the rest of the table: the first ending that is not
held names the run of a gram and of every context that can matter to it.  What comes back is
a sum per text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motorlens.functions.shipping import by_value
from motorlens.llm.kernels import UNSPACED, mixed, owners, pieces, spans, word_hashes
from motorlens.session import materialise

by_value(__name__)

# longest context (a context and its symbol fill 64 bits)
LONGEST = 7
# endings by which the grams of longer contexts are dealt out, level by level
ENDINGS = (5, 2, 0)
# least positions a retained context precedes, at every size of the corpus
LEAST_COUNT = 8
# least log-likelihood gain of a context over its ending, in nats
LEAST_GAIN = 4.0
# and for every symbol that follows it
GAIN_PER_SYMBOL = 1.0
# most frequent words whose counts every task holds (16 bytes each); other words are met by a join
FREQUENT_WORDS = 300_000
# grams of the most frequent contexts, likewise, and bits of the filter of the others at most
FREQUENT_GRAMS = 4_000_000
MOST_BITS = 1 << 29
BITS_OF_CONTEXT = 24
PROBES = 4
# rows of the rest of the tree that meet their grams together, and grams that a task hands on together
ROWS_OF_RUN = 500_000
GRAMS_TOGETHER = 2_000_000
# grams of the held contexts that get their chances together
SLICE = 1 << 17
# symbols that a task sorts and counts together before it hands their grams on
TOGETHER = 12_000_000
# runs that the keys of a level are dealt over at least
RUNS = 512
SPACE, END = 0x20, 0x0A
WORD, ENDING, GRAM = -1, -2, 100
# what a run holds, in this order
TREE_ROWS, WORD_ROWS, OPEN_GRAMS, RARE_WORDS, DOCUMENTS = range(5)


def symbol_stream(data: np.ndarray, offsets: np.ndarray, words: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, and the place of each text's end."""
    starts, ends, bounds = words
    lengths = ends - starts
    before = np.concatenate([[0], np.cumsum(lengths + 1)])
    n = len(offsets) - 1
    out = np.full(int(before[-1]) + n, SPACE, np.uint8)
    inside = np.flatnonzero(UNSPACED[data] != 0)
    if len(starts):
        out[inside + np.repeat(before[:-1] + owners(bounds) - starts, lengths)] = UNSPACED[data[inside]]
    stops = before[bounds[1:]] + np.arange(n)
    out[stops] = END
    return out, stops


def grams(symbols: np.ndarray, stops: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """Every symbol in the lowest byte with the ``depth`` before it above, the nearest one highest.

    The first symbol of a text stands behind an end; what would lie before that is 0.
    """
    wide = symbols.astype(np.uint64)
    keys = wide.copy()
    for j in range(1, depth + 1):
        keys[j:] |= wide[:-j] << np.uint64(64 - 8 * j)
    firsts = np.concatenate([[0], stops[:-1] + 1])
    for d in range(depth):
        at = firsts + d
        at = at[at <= stops]
        # d symbols of the text itself, then the end that stands for its start
        keys[at] &= ~np.uint64((1 << (64 - 8 * d)) - 1) | np.uint64(0xFF)
        keys[at] |= np.uint64(END << (56 - 8 * d))
    return keys


def context_of(keys: np.ndarray, k: int) -> np.ndarray:
    """The context of length ``k``."""
    return keys >> np.uint64(64 - 8 * k) if k else np.zeros(len(keys), np.uint64)


def shortened(keys: np.ndarray, k: int) -> np.ndarray:
    """Grams with only the last ``k`` symbols of their contexts."""
    return keys & np.uint64((((1 << 8 * k) - 1) << (64 - 8 * k)) | 0xFF)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same key added up."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


PACKED = "kind int, run int, size long, keys binary, counts binary"


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, size: int, kind: type = np.uint64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=width * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def _squeezed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the number of leading bytes each shares with the one before and its other bytes, place by place, compressed."""
    n = len(keys)
    same, apart = np.zeros(n, np.uint8), keys[1:] ^ keys[:-1]
    for j in range(1, 8):
        same[1:] += apart < np.uint64(1 << (64 - 8 * j))
    rows = keys.byteswap().view(np.uint8).reshape(n, 8)
    # as long as it can get, so that the number of keys tells its size
    out, at = np.zeros(9 * n, np.uint8), n
    out[:n] = same
    for j in range(8):
        own = rows[same <= j, j]
        out[at : at + len(own)] = own
        at += len(own)
    return pa.compress(out.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed_keys(data: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(pa.decompress(data, decompressed_size=9 * size, codec="zstd", asbytes=True), np.uint8)
    same, rows, at = out[:size], np.empty((size, 8), np.uint8), size
    for j in range(8):
        own = np.cumsum(same <= j)
        rows[:, j] = out[at + own - 1]
        at += int(own[-1])
    return rows.view(np.uint64).ravel().byteswap()


def packed(kind: int, keys: np.ndarray, counts: np.ndarray, low: int, runs: int) -> pa.RecordBatch:
    """Sorted keys and their counts in compressed runs; grams of one ending of ``low`` symbols, and equal words, go to the same run."""
    run = (mixed(keys if kind == WORD else context_of(keys, low), 77) % np.uint64(runs)).astype(np.uint16 if runs < 1 << 16 else np.int32)
    order = np.argsort(run, kind="stable")
    run = run[order]
    at = _runs(run)
    # run by run, so that no second copy of all of them is made
    cuts = [order[i:j] for i, j in zip(at, np.append(at[1:], len(run)))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), kind, np.int32)), pa.array(run[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(run))).astype(np.int64)),
         pa.array([_squeezed(keys[c]) for c in cuts], pa.binary()), pa.array([_squeezed(counts[c].astype(np.uint64)) for c in cuts], pa.binary())],
        names=["kind", "run", "size", "keys", "counts"])


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and how often each one came; the parts are let go."""
    keys = np.concatenate(parts)
    parts.clear()
    keys.sort()
    at = _runs(keys)
    return keys[at], np.diff(np.append(at, len(keys)))


def _count_kernel(depth: int, low: int, runs: int) -> Callable:
    """Words and grams of the texts of a partition in runs; counts are doubled (see ``read_levels``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {WORD: [], GRAM: []}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, counts = _counted(parts)
                    counts *= 2
                    yield packed(kind, keys, counts, low, runs)
                    del keys, counts

        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                words = spans(data, offsets, UNSPACED)
                held[GRAM].append(grams(*symbol_stream(data, offsets, words), depth))
                held[WORD].append(word_hashes(data, *words[:2], UNSPACED))
                if sum(map(len, held[GRAM])) >= TOGETHER:
                    yield from flush()
        yield from flush()

    return count


def _pack_kernel(low: int, runs: int) -> Callable:
    """Rows ``(key, n)`` in runs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(keys)
            yield packed(GRAM, keys[order], counts[order], low, runs)

    return pack


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def read_levels(keys: np.ndarray, doubled: np.ndarray, low: int, high: int, least_count: float, least_gain: float) -> Iterator[tuple]:
    """Contexts of ``low + 1`` to ``high`` symbols, and all grams of ``low``, from all sorted grams of some endings.

    ``(level, keys, n, total, kinds)``: a gram's count, its context's and how many symbols
    follow that.  A context that only leads to longer ones is a row with the count 0.
    Counts come doubled; an odd one says that the gram's context leads to longer ones that
    are retained, and so do those of the level ``low``.
    """
    n, leads = (doubled >> 1).astype(np.int64), doubled & 1 == 1
    levels, shorter = [], None
    for k in range(low, high + 1):
        if k == high:
            grams_k, counts = keys, n
        else:
            grams_k, of = np.unique(shortened(keys, k), return_inverse=True)
            counts = np.bincount(of, weights=n, minlength=len(grams_k)).astype(np.int64)
        at = _runs(context_of(grams_k, k))
        sizes = np.diff(np.append(at, len(grams_k)))
        total, kinds = np.add.reduceat(counts, at), sizes
        share = counts / np.repeat(total, sizes)
        kept = np.zeros(len(at), bool)
        if k > low:
            before = shorter[1][np.searchsorted(shorter[0], shortened(grams_k, k - 1))]
            gain = np.add.reduceat(counts * np.log(share / before), at)
            kept = (total >= least_count) & (gain >= least_gain + GAIN_PER_SYMBOL * kinds)
        levels.append((k, grams_k, counts, at, sizes, total, kept))
        shorter = grams_k, share
    # contexts of the longest level that lead to retained ones
    led = context_of(keys, high)[leads]
    for k, grams_k, counts, at, sizes, total, kept in reversed(levels):
        context = context_of(grams_k[at], k)
        leading = np.isin(context, led)
        own = np.repeat(kept, sizes)
        if k == low:
            yield k, grams_k, 2 * counts + np.repeat(leading, sizes), np.repeat(total, sizes), np.repeat(sizes, sizes)
            return
        steps = leading & ~kept
        step_keys = context[steps] << np.uint64(64 - 8 * k)
        none = np.zeros(len(step_keys), np.int64)
        yield (k, np.concatenate([grams_k[own], step_keys]), np.concatenate([counts[own], none]),
               np.concatenate([np.repeat(total, sizes)[own], total[steps]]), np.concatenate([np.repeat(sizes, sizes)[own], none]))
        led = np.unique(context[kept | leading] >> np.uint64(8))


LEVELS = "level int, key long, n long, total long, kinds int"


def _level_kernel(low: int, high: int, least_count: float, least_gain: float) -> Callable:
    """Runs in their order to rows of the tree; all grams of the endings come as rows of ``ENDING``, words are added up."""

    def table(level: int, keys: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)),
             pa.array(total.astype(np.int64)), pa.array(kinds.astype(np.int32))], names=["level", "key", "n", "total", "kinds"])

    def read(parts: list[tuple[np.ndarray, np.ndarray]], word: bool) -> Iterator[pa.RecordBatch]:
        keys, counts = _added(parts)
        if word:
            yield table(WORD, keys, counts >> np.uint64(1), np.zeros(len(keys)), np.zeros(len(keys)))
        else:
            for level, own, n, *columns in read_levels(keys, counts, low, high, least_count, least_gain):
                if level == low == 0:
                    n = n >> 1
                yield table(ENDING if level == low and low else level, own, n, *columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for kind, run, size, keys, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if (kind, run) != now:
                    if parts:
                        yield from read(parts, now[0] == WORD)
                    now, parts = (kind, run), []
                parts.append((_unsqueezed(keys, size), _unsqueezed(counts, size)))
                if len(parts) > 16:
                    parts = [_added(parts)]
        if parts:
            yield from read(parts, now[0] == WORD)

    return kernel


def grow_tree(texts: DataFrame, least_count: float = LEAST_COUNT, least_gain: float = LEAST_GAIN, depth: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """The stored tree ``(level, key, n, total, kinds)`` of texts, its root at level 0 with all symbols, and the words ``(key, n)``."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = max(RUNS, 4 * tasks)
    lows = [low for low in ENDINGS if low < depth]
    rows, high, tables, words = texts.select("text").mapInArrow(_count_kernel(depth, lows[0], runs), PACKED), depth, [], None
    for low, lower in zip(lows, [*lows[1:], None]):
        dealt = rows.repartition(tasks if low else 1, "kind", "run").sortWithinPartitions("kind", "run")
        level = materialise(dealt.mapInArrow(_level_kernel(low, high, least_count, least_gain), LEVELS))
        words = level.where(F.col("level") == WORD).select("key", "n") if words is None else words
        tables.append(level.where("level >= 0"))
        if lower is not None:
            # what is left of the endings, as grams of the next, shorter ones
            rows, high = level.where(F.col("level") == ENDING).select("key", "n").mapInArrow(_pack_kernel(lower, runs), PACKED), low
    tree = tables[0]
    for table in tables[1:]:
        tree = tree.unionByName(table)
    return tree, words


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the words: those of the highest counts, whole classes of counts at a time."""
    scale = F.floor(F.log2("n") * 32)
    classes = words.groupBy(scale.alias("class")).agg(F.count(F.lit(1)).alias("kinds")).orderBy(F.desc("class")).collect()
    held, least = 0, None
    for row in classes:
        held += row["kinds"]
        if held > most:
            break
        least = row["class"]
    return words.where(scale >= least) if least is not None else words.limit(0)


def _looked_up(keys: np.ndarray, logs: np.ndarray, wanted: np.ndarray, text: np.ndarray, n: int) -> tuple:
    """Per text: the sum of the logs of known keys and their number; and which keys are not known."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    sums = np.bincount(text[known], weights=logs[at[known]], minlength=n).astype(float)
    return sums, np.bincount(text[known], minlength=n), ~known


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their logs, from ``(key, log)``."""
    held = table.toArrow()
    keys = held.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], held.column("log").to_numpy().astype(float)[order]


BUNDLED = "level int, size long, keys binary, first binary, second binary"


def _bundle_kernel() -> Callable:
    """Rows ``(level, key, ...)`` with one or two numbers more in compressed bundles of a level, in the order of the keys."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            level, keys, *columns = (np.concatenate(c) for c in zip(*waiting))
            waiting.clear()
            keys = keys.view(np.uint64)
            order = np.lexsort((keys, level))
            level = level[order]
            at = _runs(level)
            cuts = [order[i:j] for i, j in zip(at, np.append(at[1:], len(level)))]
            bundles = [pa.array([_squeezed(c[cut]) for cut in cuts], pa.binary()) for c in (keys, *columns)]
            bundles += [pa.nulls(len(cuts), pa.binary())] * (3 - len(bundles))
            return pa.RecordBatch.from_arrays(
                [pa.array(level[at].astype(np.int32)), pa.array(np.array([len(c) for c in cuts], np.int64)), *bundles],
                names=["level", "size", "keys", "first", "second"])

        for batch in batches:
            if batch.num_rows:
                waiting.append([c.to_numpy() for c in batch.columns])
                if sum(len(w[0]) for w in waiting) >= GRAMS_TOGETHER:
                    yield flush()
        if waiting:
            yield flush()

    return bundle


def _least_held(grams_: DataFrame, most: int) -> float:
    """The least count of a context at which at most so many grams belong to contexts of that count or more."""
    scale = F.floor(F.log2("total") * 32)
    classes = grams_.groupBy(scale.alias("class")).agg(F.count(F.lit(1)).alias("rows"), F.min("total").alias("least")).orderBy(F.desc("class")).collect()
    held, least = 0, float("inf")
    for row in classes:
        held += row["rows"]
        if held > most:
            break
        least = row["least"]
    return least


def _bits(contexts: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of every context in a filter of so many words, a power of two, and its bits there."""
    hashes = mixed(contexts, 0x5851F42D4C957F2D + level)
    bits = np.zeros(len(hashes), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((hashes >> np.uint64(6 * i)) & np.uint64(63))
    return ((hashes >> np.uint64(6 * PROBES)) & np.uint64(size - 1)).astype(np.int64), bits


def _bit_kernel(size: int) -> Callable:
    """``(level, context)`` to the words of a filter, as numbers of words and their bits."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, contexts = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for k in np.unique(levels):
                word, bits = _bits(np.unique(contexts[levels == k]), int(k), size)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return kernel


def _node(contexts: np.ndarray, k: int) -> np.ndarray:
    """Contexts of length ``k`` as nodes: sorted, a node stands right before all longer ones that begin with it."""
    return contexts << np.uint64(64 - 8 * k) | np.uint64(k) if k else np.zeros(len(contexts), np.uint64)


def _at_level(tree: tuple, keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The chance of every gram after the node of so many symbols: that of the longest ending the gram was seen after, weighed down."""
    root, _, nodes, weights, levels = tree
    chance, factor = np.empty(len(keys)), np.ones(len(keys))
    going = np.zeros(0, np.int64)
    for k in range(LONGEST, 0, -1):
        # in the order of the keys, which the tables share
        going = np.union1d(going, np.flatnonzero(level == k)) if len(going) else np.flatnonzero(level == k)
        held, chances_k = levels[k - 1]
        if not len(going):
            continue
        gram = shortened(keys[going], k)
        seen = np.zeros(len(gram), bool)
        if len(held):
            place = np.minimum(np.searchsorted(held, gram), len(held) - 1)
            seen = held[place] == gram
            found = going[seen]
            chance[found] = factor[found] * chances_k[place[seen]]
        going = going[~seen]
        factor[going] *= weights[np.searchsorted(nodes, _node(context_of(keys[going], k), k))]
    rest = np.union1d(going, np.flatnonzero(level == 0))
    chance[rest] = factor[rest] * root[(keys[rest] & np.uint64(0xFF)).astype(int)]
    return chance


def _opened(bundles: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, shares and weights of a level."""
    own = bundles.filter(pc.equal(bundles.column("level"), level))
    parts = [(_unsqueezed(keys, size), _unsqueezed(share, size, np.float32), _unsqueezed(weight, size, np.float32))
             for size, keys, share, weight in zip(*[own.column(c).to_pylist() for c in ("size", "keys", "first", "second")])]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.float32)
    keys, share, weight = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(keys)
    return keys[order], share[order], weight[order]


def hold(bundles: pa.Table, filter_words: np.ndarray, floor: float) -> tuple:
    """The part of the tree that a task holds: the root's chances, the filter of other contexts, all contexts as sorted
    nodes with their weight of shorter ones, and for every level the seen grams with their chance.

    The bundles are opened level by level and grams get their chances slice by slice: beside the result, the driver
    has the rows of one level only.
    """
    root = np.full(256, floor)
    keys, share, _ = _opened(bundles, 0)
    root[(keys & np.uint64(0xFF)).astype(int)] = share
    nodes, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
    for k in range(1, LONGEST + 1):
        keys, _, weight = _opened(bundles, k)
        first = _runs(context_of(keys, k))
        nodes.append(_node(context_of(keys[first], k), k))
        weights.append(weight[first])
    nodes, weights = np.concatenate(nodes), np.concatenate(weights)
    order = np.argsort(nodes)
    nodes = nodes[order]
    weights = weights[order]
    del order
    levels = [(np.zeros(0, np.uint64), np.zeros(0, np.float32)) for _ in range(LONGEST)]
    tree = root, filter_words, nodes, weights, levels
    for k in range(1, LONGEST + 1):
        keys, share, weight = _opened(bundles, k)
        seen = share > 0
        keys, share, weight = keys[seen], share[seen], weight[seen]
        for i in range(0, len(keys), SLICE):
            part = slice(i, i + SLICE)
            shorter = _at_level(tree, keys[part], np.full(len(keys[part]), k - 1))
            share[part] = share[part] + weight[part] * shorter
        levels[k - 1] = keys, share
    return tree


def _held_level(nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The length of the longest held context of every gram.

    The held contexts are closed under endings, so that is what its context shares with
    the node right before it.
    """
    level = np.zeros(len(keys), np.int64)
    if len(nodes):
        wanted = keys & ~np.uint64(0xFF) | np.uint64(LONGEST)
        before = nodes[np.maximum(np.searchsorted(nodes, wanted, side="right") - 1, 0)]
        apart = before ^ wanted
        for k in range(1, LONGEST + 1):
            level += apart < np.uint64(1 << (64 - 8 * k))
        level = np.where(before <= wanted, np.minimum(level, (before & np.uint64(0xFF)).astype(np.int64)), 0)
    return level


def chances(tree: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance of every one of sorted grams by the held contexts, and the level from which others may go on (0: none)."""
    _, filter_words, nodes, _, _ = tree
    level = _held_level(nodes, keys)
    beyond = np.zeros(len(keys), np.uint8)
    if len(filter_words):
        for k in range(1, LONGEST + 1):
            # every context has its endings in the tree, so the first one that is not held tells
            lost = np.flatnonzero(level == k - 1)
            word, bits = _bits(context_of(keys[lost], k), k, len(filter_words))
            beyond[lost[filter_words[word] & bits == bits]] = k
    return _at_level(tree, keys, level), beyond


def _parcel_schema(id_kind: str) -> str:
    return (f"run int, kind int, row bigint, doc_id {id_kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
            "size bigint, keys binary, first binary, second binary, third binary")


def _parcels(kind: int, id_type: pa.DataType, run: np.ndarray, row: int, keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Keys and up to three parallel columns in compressed runs, in the order of the keys within a run.

    A key of open grams or rare words comes once, with how many texts of the last column are its own; a column between them is the key's.
    """
    order = np.lexsort((keys, run))
    run, keys, columns = run[order], keys[order], [c[order] for c in columns]
    if kind in (OPEN_GRAMS, RARE_WORDS):
        # equal keys have the same run and level
        first = _runs(keys)
        ends = np.append(first, len(keys))
        *own, text = columns
        run, keys, columns = run[first], keys[first], [np.diff(ends).astype(np.uint32), *[c[first] for c in own]]
    at = np.append(_runs(run), len(run))
    cuts = list(zip(at[:-1], at[1:]))
    n, at = len(cuts), at[:-1]
    nothing = [pa.nulls(n, t) for t in (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    bundles = [pa.array([_squeezed_keys(keys[i:j]) for i, j in cuts], pa.binary())]
    bundles += [pa.array([_squeezed(c[i:j]) for i, j in cuts], pa.binary()) for c in columns]
    if kind in (OPEN_GRAMS, RARE_WORDS):
        bundles.insert(2, pa.array([_squeezed(text[ends[i]:ends[j]]) for i, j in cuts], pa.binary()))
    bundles += [pa.nulls(n, pa.binary())] * (4 - len(bundles))
    names = ["run", "kind", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "size", "keys", "first", "second", "third"]
    return pa.RecordBatch.from_arrays(
        [pa.array(run[at].astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, row, np.int64)), *nothing,
         pa.array(np.array([j - i for i, j in cuts], np.int64)), *bundles], names=names)


def _run_of_first(keys: np.ndarray, first: np.ndarray, runs: int) -> np.ndarray:
    """The run of grams by their endings of ``first`` symbols, the first ones that are not held."""
    shift = (64 - 8 * first.astype(np.int64)).astype(np.uint64)
    return (mixed((keys >> shift) + (first.astype(np.uint64) << np.uint64(56)), 78) % np.uint64(runs)).astype(np.int32)


def _run_of_word(keys: np.ndarray, runs: int) -> np.ndarray:
    return (mixed(keys, 77) % np.uint64(runs)).astype(np.int32)


def _rest_kernel(held: Callable[[], tuple], id_type: pa.DataType, runs: int) -> Callable:
    """Rows ``(level, key, share, weight)`` of contexts that are not held, in the runs of the grams they matter to."""

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, waiting, size = held()[1][2], [], 0

        def flush() -> pa.RecordBatch:
            level, keys, share, weight = (np.concatenate([w[i] for w in waiting]) for i in range(4))
            keys = keys.view(np.uint64)
            first = _held_level(nodes, keys) + 1
            return _parcels(TREE_ROWS, id_type, _run_of_first(keys, first, runs), 0, keys, share, weight, level.astype(np.uint8))

        for batch in batches:
            waiting.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= GRAMS_TOGETHER:
                yield flush()
                waiting, size = [], 0
        if size:
            yield flush()

    return rest


def _word_kernel(id_type: pa.DataType, runs: int) -> Callable:
    """Words and their counts in runs."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            if len(keys):
                yield _parcels(WORD_ROWS, id_type, _run_of_word(keys, runs), 0, keys, counts)

    return words


def _score_kernel(held: Callable[[], tuple], end_log10: float, end_known: int, depth: int, id_type: pa.DataType, runs: int) -> Callable:
    """Texts ``(doc_id, held_out, text)`` to their rows as far as the held tables tell, and parcels of what others must tell."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, tree = held()
        row = since = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        open_grams: list[tuple] = []
        rare_words: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(len(w[0]) for w in open_grams):
                keys, beyond, text = (np.concatenate([w[i] for w in open_grams]) for i in range(3))
                yield _parcels(OPEN_GRAMS, id_type, _run_of_first(keys, beyond, runs), since, keys, beyond, text)
            if sum(len(w[0]) for w in rare_words):
                keys, text = (np.concatenate([w[i] for w in rare_words]) for i in range(2))
                yield _parcels(RARE_WORDS, id_type, _run_of_word(keys, runs), since, keys, text)
            open_grams.clear()
            rare_words.clear()

        for batch in batches:
            for first, data, offsets in pieces(batch.column(2)):
                words = spans(data, offsets, UNSPACED)
                n = len(offsets) - 1
                hashes, owner = word_hashes(data, *words[:2], UNSPACED), owners(words[2])
                base, known, rare = _looked_up(*frequent_words, hashes, owner, n)
                symbols, stops = symbol_stream(data, offsets, words)
                text = np.repeat(np.arange(n), np.diff(np.concatenate([[-1], stops])))
                keys, of = np.unique(grams(symbols, stops, depth), return_inverse=True)
                chance, beyond = chances(tree, keys)
                logs = np.where(beyond == 0, np.log10(chance), 0.0)
                sums = np.bincount(text, weights=logs[of], minlength=n)
                open_ = np.flatnonzero((beyond != 0)[of])
                of = of[open_]
                open_grams.append((keys[of], beyond[of], (text[open_] + (row - since)).astype(np.uint32)))
                rare_words.append((hashes[rare], (owner[rare] + (row - since)).astype(np.uint32)))
                numbers = np.arange(row, row + n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((numbers % runs).astype(np.int32)), pa.array(np.full(n, DOCUMENTS, np.int32)), pa.array(numbers),
                        batch.column(0).slice(first, n), batch.column(1).slice(first, n),
                        pa.array(np.diff(words[2]) + 1, pa.int64()),
                        pa.array(known + end_known, pa.int64()),
                        pa.array(base + end_log10),
                        pa.array(sums),
                        pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 4,
                    ],
                    names=["run", "kind", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "size", "keys", "first", "second", "third"],
                )
                row += n
                if sum(len(w[0]) for w in open_grams) + sum(len(w[0]) for w in rare_words) >= GRAMS_TOGETHER or row - since >= 1 << 31:
                    yield from flush()
                    since = row
        yield from flush()

    return score


def _carried(levels: dict, keys: np.ndarray, chance: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """The chances of grams carried on over the contexts of a run, level by level; a context is there only if its endings are."""
    chance = chance.astype(float)
    going = np.zeros(0, np.int64)
    for k in range(1, LONGEST + 1):
        going = np.concatenate([going, np.flatnonzero(beyond == k)])
        if k not in levels or not len(going):
            going = going[:0]
            continue
        contexts, weights, held, shares = levels[k]
        gram = shortened(keys[going], k)
        wanted = context_of(gram, k)
        place = np.minimum(np.searchsorted(contexts, wanted), len(contexts) - 1)
        there = contexts[place] == wanted
        going, gram, place = going[there], gram[there], place[there]
        at = np.minimum(np.searchsorted(held, gram), len(held) - 1)
        chance[going] = np.where(held[at] == gram, shares[at], 0.0) + weights[place] * chance[going]
    return chance


def _by_level(parts: list[tuple]) -> dict:
    """Rows ``(key, share, weight, level)`` of a run as ``(contexts, weights, grams, shares)`` of every level."""
    levels = {}
    if parts:
        keys, share, weight, level = (np.concatenate([p[i] for p in parts]) for i in range(4))
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            at = at[np.argsort(keys[at])]
            contexts, first = np.unique(context_of(keys[at], k), return_index=True)
            levels[k] = contexts, weight[at][first], keys[at], share[at]
    return levels


def _added_sums(sums: list[tuple]) -> tuple:
    """Sums ``(row, known, base, score)`` of the same row added up, in the order of the rows."""
    rows, of = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
    return rows, *[np.bincount(of, weights=np.concatenate([x[i] for x in sums]), minlength=len(rows)) for i in (1, 2, 3)]


def _part_of(rows: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(rows.view(np.uint64) >> np.uint64(8), 79) % np.uint64(parts)).astype(np.int32)


def _sum_schema(id_kind: str) -> str:
    return (f"part int, row bigint, doc_id {id_kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
            "size bigint, rows binary, knowns binary, bases binary, scores binary")


def _resolve_kernel(held: Callable[[], tuple], divisor: float, id_type: pa.DataType, parts: int) -> Callable:
    """Runs in their order to the rows of texts, as they came, and parcels of sums to be added to them."""
    own_names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"]
    names = ["part", *own_names, "size", "rows", "knowns", "bases", "scores"]

    def partial(sums: list[tuple]) -> pa.RecordBatch:
        rows, known, base, score = _added_sums(sums)
        part = _part_of(rows, parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = _runs(part)
        cuts = list(zip(at, np.append(at[1:], len(part))))
        nothing = [pa.nulls(len(at), t) for t in (pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        rows = rows[order]
        # rows that follow each other are told by their steps
        bundles = [pa.array([_squeezed(np.diff(rows[i:j], prepend=0)) for i, j in cuts], pa.binary())]
        bundles += [pa.array([_squeezed(c[i:j]) for i, j in cuts], pa.binary()) for c in (x[order] for x in (known.astype(np.int32), base, score.astype(np.float32)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[at]), *nothing, pa.array(np.array([j - i for i, j in cuts], np.int64)), *bundles], names=names)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, words, levels, counts = None, [], [], None, None
        sums: list[tuple] = []
        pending = 0
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            own = pa.array(np.flatnonzero(kinds == DOCUMENTS))
            if len(own):
                columns = [batch.column(c).take(own) for c in own_names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_part_of(columns[0].to_numpy(), parts)), *columns, pa.nulls(len(own), pa.int64()), *[pa.nulls(len(own), pa.binary())] * 4],
                    names=names)
            for i in np.flatnonzero(kinds != DOCUMENTS).tolist():
                kind = int(kinds[i])
                run, row, size, *bundles = (batch.column(c)[i].as_py() for c in ("run", "row", "size", "keys", "first", "second", "third"))
                if run != now:
                    now, rest, words, levels, counts = run, [], [], None, None
                column = lambda j, t: _unsqueezed(bundles[j], size, t)  # noqa: B023, E731
                keys = _unsqueezed_keys(bundles[0], size)
                if kind == TREE_ROWS:
                    rest.append((keys, column(1, np.float32), column(2, np.float32), column(3, np.uint8)))
                    continue
                if kind == WORD_ROWS:
                    words.append((keys, column(1, np.int64).view(np.uint64)))
                    continue
                times = column(1, np.uint32)
                text, of = np.unique(_unsqueezed(bundles[2], int(times.sum()), np.uint32), return_inverse=True)
                none = np.zeros(len(text))
                if kind == OPEN_GRAMS:
                    levels = _by_level(rest) if levels is None else levels
                    beyond = column(3, np.uint8).astype(np.int64)
                    # what the held contexts tell of them is looked up here again instead of travelling with every gram
                    logs = np.log10(_carried(levels, keys, _at_level(held()[1], keys, beyond - 1), beyond))
                    sums.append((text.astype(np.int64) + row, none, none, np.bincount(of, weights=np.repeat(logs, times))))
                else:
                    counts = (_added(words) if words else (keys[:0], keys[:0])) if counts is None else counts
                    at = np.minimum(np.searchsorted(counts[0], keys), max(len(counts[0]) - 1, 0))
                    known = counts[0][at] == keys if len(counts[0]) else np.zeros(size, bool)
                    n = np.zeros(size)
                    n[known] = counts[1][at[known]]
                    sums.append((text.astype(np.int64) + row, np.bincount(of, weights=np.repeat(known, times)),
                                 np.bincount(of, weights=np.repeat(np.log10((n + 0.5) / divisor), times)), none))
                pending += len(text)
                if pending >= GRAMS_TOGETHER:
                    sums = [_added_sums(sums)]
                    pending = len(sums[0][0])
                    if 2 * pending >= GRAMS_TOGETHER:
                        yield partial(sums)
                        sums, pending = [], 0
        if sums:
            yield partial(sums)

    return resolve


def _add_kernel() -> Callable:
    """The rows of the texts of a task with the sums that belong to them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sums = [], [(np.zeros(0, np.int64), *[np.zeros(0)] * 3)]
        for batch in batches:
            whole = batch.column("size").is_null()
            texts.append(batch.filter(whole).select(["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"]))
            for size, *bundles in zip(*[batch.filter(pc.invert(whole)).column(c).to_pylist() for c in ("size", "rows", "knowns", "bases", "scores")]):
                steps, *more = (_unsqueezed(b, size, t) for b, t in zip(bundles, (np.int64, np.int32, np.float64, np.float32)))
                sums.append((np.cumsum(steps), *more))
            if len(sums) > 64:
                sums = [_added_sums(sums)]
        rows, *more = _added_sums(sums)
        for batch in texts:
            own = batch.column("row").to_numpy()
            at = np.minimum(np.searchsorted(rows, own), max(len(rows) - 1, 0))
            met = rows[at] == own if len(rows) else np.zeros(len(own), bool)
            known, base, score = (np.where(met, m[at], 0.0) if len(rows) else np.zeros(len(own)) for m in more)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"),
                 pa.array(batch.column("known").to_numpy() + known.astype(np.int64)),
                 pa.array(batch.column("base").to_numpy() + base), pa.array(batch.column("score").to_numpy() + score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return add


def score_documents(
    docs: DataFrame, least_count: float = LEAST_COUNT, frequent_words: int = FREQUENT_WORDS,
    frequent_grams: int = FREQUENT_GRAMS, depth: int = LONGEST, least_gain: float = LEAST_GAIN,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document.

    Tree and base learn from documents with ``crc32(doc_id) mod 5 <> 1`` (a null id is
    trained on).  A null or empty text is the end alone.  Repeated documents count each
    time and are scored one by one; without training documents every word has the count
    0 and the tree only its smoothed root; an empty table gives no rows; further
    columns are not used.  Words are told apart by a 64-bit hash.  Contexts have at most
    ``depth`` bytes, 7 at most.
    """
    if not 1 <= depth <= LONGEST:
        raise ValueError("a context and its symbol must fit 64 bits")
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    wanted = docs.select("doc_id", held_out.alias("held_out"), "text")
    tree, words = grow_tree(wanted.where(~F.col("held_out")), least_count, least_gain, depth)
    kinds, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    trained = wanted.where(~F.col("held_out")).count()
    total, kinds = int(tokens) + trained, int(kinds) + (trained > 0)
    divisor = total + 0.5 * (kinds + 1)
    log10 = lambda n: F.log10((n + 0.5) / F.lit(divisor))
    seen = tree.where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weights = tree.select(
        "level", "key", "total", "kinds",
        F.when(F.col("level") == 0, (F.col("n") + 0.5) / F.lit(seen + 128.0)).otherwise(F.col("n") / (F.col("total") + F.col("kinds"))).cast("float").alias("share"),
        F.when(F.col("n") == 0, 1.0).otherwise(F.col("kinds") / (F.col("total") + F.col("kinds"))).cast("float").alias("weight"))
    least = _least_held(weights.where("level > 0"), frequent_grams)
    near, rest = ((F.col("level") == 0) | (F.col("total") >= least)), ((F.col("level") > 0) & (F.col("total") < least))
    unheld = weights.where(rest)
    # a context has a row for every symbol it was seen before
    rows, others = unheld.agg(F.count(F.lit(1)), F.coalesce(F.sum(1 / F.greatest("kinds", F.lit(1))), F.lit(0.0))).first()
    filter_words = np.zeros(0, np.uint64)
    if rows:
        size = min(MOST_BITS, 1 << max(10, (int(BITS_OF_CONTEXT * others)).bit_length())) // 64
        context = F.expr("shiftrightunsigned(key, 64 - 8 * level)")
        pairs = unheld.select("level", context.alias("c")).mapInArrow(_bit_kernel(size), "word long, bits long")
        set_words = pairs.groupBy("word").agg(F.bit_or("bits").alias("bits")).select(F.lit(0), "word", "bits").mapInArrow(_bundle_kernel(), BUNDLED).toArrow()
        filter_words = np.zeros(size, np.uint64)
        for n, word, bits in zip(*[set_words.column(c) for c in ("size", "keys", "first")]):
            filter_words[_unsqueezed(word.as_py(), n.as_py(), np.int64)] = _unsqueezed(bits.as_py(), n.as_py())
        del set_words
    held = spark.sparkContext.broadcast((
        _sorted(_most_frequent(words, frequent_words).select("key", log10(F.col("n")).alias("log"))),
        hold(weights.where(near).select("level", "key", "share", "weight").mapInArrow(_bundle_kernel(), BUNDLED).toArrow(), filter_words, 0.5 / (seen + 128.0)),
    ))
    end_log10 = float(np.log10((trained + 0.5) / divisor))
    kind = wanted.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = max(16 * tasks, -(-rows // ROWS_OF_RUN))
    schema = _parcel_schema(kind.simpleString())
    value = lambda: held.value
    parcels = wanted.mapInArrow(_score_kernel(value, end_log10, int(trained > 0), depth, id_type, runs), schema)
    parcels = parcels.unionByName(words.mapInArrow(_word_kernel(id_type, runs), schema))
    if rows:
        parcels = parcels.unionByName(unheld.select("level", "key", "share", "weight").mapInArrow(_rest_kernel(value, id_type, runs), schema))
    resolved = parcels.repartition(tasks, "run").sortWithinPartitions("run", "kind").mapInArrow(
        _resolve_kernel(value, divisor, id_type, 4 * tasks), _sum_schema(kind.simpleString()))
    added = resolved.repartition(tasks, "part").mapInArrow(
        _add_kernel(), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return materialise(added.withColumn("train_tokens", F.lit(total).cast("bigint")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
