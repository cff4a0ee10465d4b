"""Language of texts by a bidirectional gated recurrent network over bytes.

Two small recurrent networks read windows of a text forwards and backwards; at every
byte their states give a distribution over languages, and the mean over all bytes of a
document is its prediction.  The network is trained in numpy by backpropagation through
time on windows of a bounded, hash-chosen sample of labelled documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorlens.functions.shipping import by_value
from motorlens.llm.kernels import pieces

by_value(__name__)

# sampled training documents of a language (of full length), windows of each, bytes of a window in training and in prediction
SAMPLE_DOCUMENTS = 600
SAMPLE_WINDOWS = 4
TRAIN_BYTES = 48
READ_BYTES = 96
# states of either direction, training steps, windows of a step, rate
STATES = 8
STEPS = 320
BATCH = 128
RATE = 0.02
# a pipeline rejects documents below this score
LEAST_SCORE = 0.4
# windows that are read side by side
SIDE_BY_SIDE = 4096
UNDETERMINED = "und"

_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _soft(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|), the squashing function of states; gates use its half-open form."""
    size = np.abs(x)
    size += 1
    return np.divide(x, size, out=out)


class Network:
    """Parameters and passes of the two directions and of the output layer.

    Arrays have one column per window.  For each direction ``w`` holds what a byte adds to
    the update gate, reset gate and candidate (bias included), ``u`` what the state adds.
    """

    def __init__(self, languages: list[str], states: int = STATES, seed: int = 1):
        random = np.random.default_rng(seed)
        self.languages, self.states = languages, states
        draw = lambda *shape: random.normal(0, 0.4, shape).astype(np.float32)
        self.p = {f"{n}{d}": draw(*shape) for d in "fb" for n, shape in (("w", (3 * states, 256)), ("u", (3 * states, states)))}
        self.p |= {"v": draw(len(languages), 2 * states), "c": np.zeros((len(languages), 1), np.float32)}

    def _step(self, d: str, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = self.states
        x = self.p["w" + d].take(byte, axis=1)
        u = self.p["u" + d] @ h
        gates = x[: 2 * k]
        gates += u[: 2 * k]
        _soft(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:k], gates[k:]
        inner = u[2 * k :]
        raw = x[2 * k :] + r * inner
        n = _soft(raw)
        new = h - n
        new *= z
        new += n
        return new, z, r, inner, n, raw

    def probabilities(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Distributions ``(languages, windows)`` summed over the positions of each window (a column of bytes)."""
        steps, count = windows.shape
        k = self.states
        both = np.empty((steps, 2 * k, count), np.float32)
        full = bool((lengths == steps).all())
        for d, order, rows in (("f", range(steps), slice(0, k)), ("b", range(steps - 1, -1, -1), slice(k, 2 * k))):
            h = np.zeros((k, count), np.float32)
            for t in order:
                h = self._step(d, windows[t], h)[0]
                if not full:
                    h *= t < lengths
                both[t, rows] = h
        total = np.zeros((len(self.languages), count), np.float32)
        for t in range(steps):
            p = np.exp(self.p["v"] @ both[t] + self.p["c"])
            p /= p.sum(axis=0)
            total += p if full else p * (t < lengths)
        return total

    def gradients(self, windows: np.ndarray, truth: np.ndarray, lengths: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions and its gradients, by backpropagation through time; what lies behind a length is padding."""
        steps, count = windows.shape
        inside = np.ones((steps, count), bool) if lengths is None else np.arange(steps)[:, None] < lengths
        k = self.states
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.empty((steps, 2 * k, count), np.float32)
        orders = {"f": list(range(steps)), "b": list(range(steps - 1, -1, -1))}
        for d, rows in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            h = np.zeros((k, count), np.float32)
            for t in orders[d]:
                new, *rest = self._step(d, windows[t], h)
                kept[d].append((t, h, *rest))
                new *= inside[t]
                h = both[t, rows] = new
        grads = {name: np.zeros_like(value) for name, value in self.p.items()}
        loss, scale = 0.0, 1.0 / inside.sum()
        d_both = np.empty_like(both)
        for t in range(steps):
            p = np.exp(self.p["v"] @ both[t] + self.p["c"])
            p /= p.sum(axis=0)
            loss -= float((np.log(p[truth, np.arange(count)] + 1e-12) * inside[t]).sum()) * scale
            p[truth, np.arange(count)] -= 1
            p *= scale * inside[t]
            grads["v"] += p @ both[t].T
            grads["c"] += p.sum(axis=1, keepdims=True)
            d_both[t] = self.p["v"].T @ p
        for d, rows in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            u, after = self.p["u" + d], np.zeros((k, count), np.float32)
            for t, h, z, r, inner, n, raw in reversed(kept[d]):
                dh = (d_both[t, rows] + after) * inside[t]
                d_raw = dh * (1 - z) * (1 - np.abs(n)) ** 2
                # slopes of the gates from their values: half the squared distance from the nearer end, doubled
                slope = lambda g: 0.5 * (1 - np.abs(2 * g - 1)) ** 2
                d_z = dh * (h - n) * slope(z)
                d_r = d_raw * inner * slope(r)
                d_x = np.concatenate([d_z, d_r, d_raw])
                d_u = np.concatenate([d_z, d_r, d_raw * r])
                for row in range(3 * k):
                    grads["w" + d][row] += np.bincount(windows[t], weights=d_x[row], minlength=256)
                grads["u" + d] += d_u @ h.T
                after = dh * z + u.T @ d_u
        return loss, grads


def train(windows: np.ndarray, truth: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 1,
          lengths: np.ndarray | None = None) -> Network:
    """A network fitted by Adam to windows ``(windows, bytes)``, their languages' numbers and the bytes of each that count."""
    network = Network(languages, seed=seed)
    if len(languages) < 2:
        return network
    random = np.random.default_rng(seed)
    first = {n: np.zeros_like(v) for n, v in network.p.items()}
    second = {n: np.zeros_like(v) for n, v in network.p.items()}
    groups = [np.flatnonzero(truth == i) for i in range(len(languages))]
    for step in range(1, steps + 1):
        # languages in equal shares
        picked = np.concatenate([random.choice(g, max(1, BATCH // len(groups))) for g in groups])
        _, grads = network.gradients(windows[picked].T, truth[picked], None if lengths is None else lengths[picked])
        rate = RATE * (1 - 0.9 * step / steps)
        for n, g in grads.items():
            first[n] += 0.1 * (g - first[n])
            second[n] += 0.01 * (g * g - second[n])
            network.p[n] -= (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Training windows at seeded places of each text; a shorter text is one window."""
    for frame in frames:
        rows = []
        for text, lang, seed in zip(frame["text"], frame["lang"], frame["seed"]):
            raw = text.encode()
            random = np.random.default_rng(int(seed) % 2**63)
            windows = min(SAMPLE_WINDOWS, -(-len(raw) // TRAIN_BYTES))
            rows += [(lang, raw[at : at + TRAIN_BYTES]) for at in random.integers(0, max(len(raw) - TRAIN_BYTES, 0) + 1, windows)]
        yield pd.DataFrame(rows, columns=["lang", "piece"])


def learn(docs: DataFrame, size: int = SAMPLE_DOCUMENTS) -> Network:
    """The network for documents with ``crc32(doc_id) mod 5 <> 0`` and a language.

    Of every language about ``size`` documents of full length, chosen by a hash of the id,
    give ``SAMPLE_WINDOWS`` windows each; of shorter ones, which give fewer, there are
    more.  Empty texts give none.
    """
    training = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    windows_of = F.least(F.lit(SAMPLE_WINDOWS), F.ceil(F.octet_length("text") / TRAIN_BYTES))
    counts = training.groupBy("lang").agg(F.sum(windows_of).alias("n")).where("n > 0")
    shares = {r["lang"]: min(1.0, size * SAMPLE_WINDOWS / r["n"]) for r in counts.collect()}
    languages = sorted(shares)
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, math.ceil(1_000_003 * shares[lang]))]) if shares else None
    if limit is None:
        return Network([])
    sampled = training.where(F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1_000_003)) < limit[F.col("lang")])
    cut = sampled.select("text", "lang", F.xxhash64("doc_id", F.lit(22)).alias("seed")).mapInPandas(_cut, "lang string, piece binary")
    # at most about SAMPLE_DOCUMENTS * SAMPLE_WINDOWS windows of each language
    rows = cut.toPandas().sort_values(["lang", "piece"])
    languages = sorted(rows["lang"].unique())
    lengths = rows["piece"].str.len().to_numpy(int)
    windows = np.array([np.frombuffer(p.ljust(TRAIN_BYTES, b" "), np.uint8) for p in rows["piece"]]).reshape(-1, TRAIN_BYTES)
    truth = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)
    return train(_LOWER[windows], truth, languages, lengths=lengths)


def pooled(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean distribution ``(texts, languages)`` over all bytes of each text; all zero for an empty text."""
    lengths = np.diff(offsets)
    windows_of = -(-lengths // READ_BYTES)
    text = np.repeat(np.arange(len(lengths)), windows_of)
    k = np.arange(len(text)) - np.repeat(np.cumsum(windows_of) - windows_of, windows_of)
    starts = offsets[:-1][text] + k * READ_BYTES
    sizes = np.minimum(offsets[1:][text] - starts, READ_BYTES)
    # short windows together, so that the others need no masks
    order = np.argsort(sizes < READ_BYTES, kind="stable")
    total = np.zeros((len(lengths), len(network.languages)))
    for first in range(0, len(order), SIDE_BY_SIDE):
        part = order[first : first + SIDE_BY_SIDE]
        places = np.minimum(starts[part] + np.arange(READ_BYTES)[:, None], len(data) - 1)
        sums = network.probabilities(_LOWER[data[places]], sizes[part])
        for i in range(len(network.languages)):
            total[:, i] += np.bincount(text[part], weights=sums[i], minlength=len(lengths))
    return total / np.maximum(lengths, 1)[:, None]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _kernel(network: Network) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*network.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            for first, data, offsets in pieces(batch.column(batch.num_columns - 1)):
                n = len(offsets) - 1
                best, score = np.full(n, len(network.languages)), np.zeros(n)
                if len(network.languages) and len(data):
                    shares = pooled(network, data, offsets)
                    known = _has_letter(data, offsets)
                    best[known] = shares.argmax(axis=1)[known]
                    score[known] = np.clip(shares.max(axis=1)[known], 0, 1)
                columns = [batch.column(i).slice(first, n) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                    names=[*batch.schema.names[:-1], "lang_pred", "score"],
                )

    return predict


def predict_language(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document, from its text alone.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could
    be learned.  Only documents with ``crc32(doc_id) mod 5 <> 0`` and a language are learned
    from.  Texts are read whole in windows; repeated documents are predicted one by one;
    an empty table gives no rows; further columns are not used.
    """
    network = network or learn(docs.select("doc_id", "text", "lang"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    wanted = docs.select("doc_id", held_out.alias("held_out"), "text")
    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(_kernel(network), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents in their own columns without those of no language: no letter, or a score below ``least_score``.

    Null and empty texts have no letter.  Columns may have any names and types; repeated
    rows are judged one by one; an empty table gives no rows.
    """
    network = learn(docs.select("doc_id", "text", "lang"))
    rows = docs.select(F.struct("*").alias("row"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    predicted = rows.mapInArrow(_kernel(network), schema)
    return predicted.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")
