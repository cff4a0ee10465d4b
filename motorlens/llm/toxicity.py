"""Toxicity scores from a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits and signs that stand for
letters), an Aho-Corasick automaton finds the entries of the lexicon and the exception
phrases that cancel them, and the summed weights, normalised by length, give the score
by a fitted logistic curve.  Lexicon, exceptions and curve are learned from a bounded,
hash-chosen sample of labelled documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorlens.functions.shipping import by_value

by_value(__name__)

# labelled documents that lexicon and curve are learned from, in expectation
SAMPLE_DOCUMENTS = 12_000
# least toxic documents an entry must be found in, least log odds after two standard errors are taken off
LEAST_DOCUMENTS = 6
LEAST_WEIGHT = 2.3
ERRORS = 2.0
# lengths of word beginnings that may become entries
PREFIXES = (3, 4, 5, 6, 7, 8)
# documents an exception phrase must be found in
LEAST_EXCEPTIONS = 4
TOXIC_FROM = 0.7

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalnum()}
    for code in [*range(128), *range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF00, 0xFF60)]:
        char = chr(code)
        base = unicodedata.normalize("NFKD", char)[:1].lower()
        if char.isalpha() and base.isalpha():
            table[code] = LOOK_ALIKES.get(char.lower(), LOOK_ALIKES.get(base, base))
        elif code >= 128 and not char.isalnum():
            table[code] = " "
    table |= {ord(k): v for k, v in STAND_INS.items()}
    # joiners, direction marks and combining accents that are put inside words
    table |= dict.fromkeys([0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), 0x2060, 0xFEFF])
    return table


_TABLE = _fold_table()
_DECORATION = re.compile(r"[$@]{2,}")


def fold(text: str | None) -> str:
    """Folded words, each with one space before it and one behind the last."""
    if not text:
        return " "
    return f" {' '.join(_DECORATION.sub(' ', text).translate(_TABLE).split())} "


def _sampled(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Training documents of a bounded sample: ``(text, toxic, half)``.

    Of several labels of a document the largest counts.  The rows are chosen by a hash of
    the id, with a share that makes ``size`` of them in expectation.
    """
    training = labels.where(F.col("toxic").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1))
    single = training.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    total = max(single.count(), 1)
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, size / total))
    # at most about ``size`` pairs of numbers, whatever the input
    chosen = F.broadcast(single.where(part))
    half = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("_toxic").alias("toxic"), half.alias("half"))
    # copies of a text are one example
    return rows.dropDuplicates(["text", "toxic"])


def _candidates(text: str) -> set[str]:
    """Whole words and word beginnings of a folded text."""
    words = set(text.split())
    found = {f" {w} " for w in words}
    found.update(f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k)
    return found


def _counted(rows: Callable[[pd.DataFrame, Counter], None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts per batch as ``(entry, toxic, n)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: Counter = Counter()
            rows(frame, counts)
            yield pd.DataFrame([(e, t, n) for (e, t), n in counts.items()], columns=["entry", "toxic", "n"])

    return run


COUNTS = "entry string, toxic int, n bigint"


def _automaton(entries: dict[str, float]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for entry, weight in entries.items():
        machine.add_word(entry, (entry, weight))
    if entries:
        machine.make_automaton()
    return machine


def _matches(machine: ahocorasick.Automaton, text: str) -> list[tuple[int, str, float]]:
    return [(end, *value) for end, value in machine.iter(text)] if len(machine) else []


def _toxic_entries(frame: pd.DataFrame, counts: Counter) -> None:
    for text in frame["text"]:
        counts.update((entry, 1) for entry in _candidates(fold(text)))


def _entry_counts(entries: list[str]) -> Callable[[pd.DataFrame, Counter], None]:
    def count(frame: pd.DataFrame, counts: Counter) -> None:
        machine = _automaton(dict.fromkeys(entries, 1.0))
        for text, toxic in zip(frame["text"], frame["toxic"]):
            counts.update((entry, int(toxic)) for entry in {entry for _, entry, _ in _matches(machine, fold(text))})

    return count


def _phrases(entries: list[str]) -> Callable[[pd.DataFrame, Counter], None]:
    """Documents of two-word phrases around matches."""

    def count(frame: pd.DataFrame, counts: Counter) -> None:
        machine = _automaton(dict.fromkeys(entries, 1.0))
        for text, toxic in zip(frame["text"], frame["toxic"]):
            folded, seen = fold(text), set()
            for end, entry, _ in _matches(machine, folded):
                start = end - len(entry) + 1
                stop = folded.index(" ", start + 1)
                before = folded.rfind(" ", 0, start)
                after = folded.find(" ", stop + 1)
                if before >= 0:
                    seen.add(folded[before : stop + 1])
                if after >= 0:
                    seen.add(folded[start : after + 1])
            counts.update((phrase, int(toxic)) for phrase in seen)

    return count


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Entries with their weights, and exception phrases with the (negative) weight they take back.

    An entry is weighed by the log odds of the toxic documents that hold it, less their
    standard errors.  Of entries that begin with each other the weightiest stays.
    """
    summed = lambda df: df.groupBy("entry", "toxic").agg(F.sum("n").alias("n"))
    toxic = sample.where("toxic = 1")
    often = summed(toxic.mapInPandas(_counted(_toxic_entries), COUNTS)).where(F.col("n") >= LEAST_DOCUMENTS)
    # at most the entries of a bounded sample
    first = [r["entry"] for r in often.select("entry").collect()]
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts: dict[str, list[int]] = {}
    for r in summed(sample.mapInPandas(_counted(_entry_counts(first)), COUNTS)).collect():
        counts.setdefault(r["entry"], [0, 0])[1 if r["toxic"] == 1 else 0] += r["n"]
    clean, bad = sizes.get(0, 0) + 1.0, sizes.get(1, 0) + 1.0

    def sure(n0: int, n1: int) -> float:
        """Log odds of toxic documents, less what chance may add."""
        odds = math.log((n1 + 0.5) / bad) - math.log((n0 + 0.5) / clean)
        return odds - ERRORS * math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))

    weights = {e: sure(n0, n1) for e, (n0, n1) in counts.items() if n1 >= LEAST_DOCUMENTS}
    # of equal ones the beginning of a word before the word, the longer before the shorter
    strong = sorted((e for e, w in weights.items() if w >= LEAST_WEIGHT),
                    key=lambda e: (-round(weights[e], 2), e.endswith(" "), -len(e), e))
    kept: dict[str, float] = {}
    beginnings: set[str] = set()
    for entry in strong:
        # an entry that begins like a kept one, or with it, would count the same word twice
        shorter = {entry[:k] for k in range(2, len(entry))}
        if entry not in beginnings and not any(e in kept for e in shorter):
            kept[entry] = round(weights[entry], 4)
            beginnings |= shorter
    exceptions: dict[str, list[int]] = {}
    for r in summed(sample.mapInPandas(_counted(_phrases(list(kept))), COUNTS)).where(F.col("n") >= LEAST_EXCEPTIONS).collect():
        exceptions.setdefault(r["entry"], [0, 0])[1 if r["toxic"] == 1 else 0] += r["n"]
    harmless = sorted(p for p, (n0, n1) in exceptions.items() if n0 >= LEAST_EXCEPTIONS and n1 * clean < n0 * bad)
    machine = _automaton(kept)
    return kept, {p: -sum(w for _, _, w in _matches(machine, p)) for p in harmless}


def features(text: str | None, machine: ahocorasick.Automaton) -> tuple[float, float, int]:
    """Summed weights, the same by length, and the words of a text."""
    folded = fold(text)
    words = folded.count(" ") - 1
    times = Counter((entry, weight) for _, entry, weight in _matches(machine, folded))
    # repetitions of one entry count less and less
    total = max(0.0, sum(weight * math.log2(1 + n) for (_, weight), n in times.items()))
    return math.log1p(total), total / math.sqrt(words + 10.0), words


def fit_curve(rows: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Weights of a logistic curve with a constant, by Newton steps."""
    x = np.column_stack([np.ones(len(rows)), rows]) if len(rows) else np.zeros((0, 3))
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def _feature_frames(entries: dict[str, float]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _automaton(entries)
        for frame in frames:
            found = [features(text, machine)[:2] for text in frame["text"]]
            yield pd.DataFrame({"total": [a for a, _ in found], "rate": [b for _, b in found], "toxic": frame["toxic"]})

    return run


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCUMENTS) -> tuple[dict[str, float], list[float]]:
    """Entries and exceptions in one table of weights, and the curve, from two halves of the sample."""
    sample = _sampled(docs, labels, size)
    lexicon, exceptions = learn_lexicon(sample.where("half = 0"))
    entries = lexicon | exceptions
    rows = sample.where("half = 1").mapInPandas(_feature_frames(entries), "total double, rate double, toxic int").toPandas()
    rows = rows.sort_values(["total", "rate", "toxic"])
    return entries, fit_curve(rows[["total", "rate"]].to_numpy(float), rows["toxic"].to_numpy(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_folded_words)`` of every document.

    Learns from labelled documents with ``crc32(doc_id) mod 3 <> 1``; with none, every
    score is one half.  A null text counts as empty and has the score of a text without matches;
    null labels are passed over, repeated labels of a document count once and as toxic if
    one says so; repeated documents are scored one by one; an empty table gives no rows;
    further columns are not used.
    """
    entries, curve = learn(docs, labels, size)

    @F.pandas_udf("score double, words bigint")
    def scored(texts: pd.Series) -> pd.DataFrame:
        machine = _automaton(entries)
        rows = [features(text, machine) for text in texts]
        z = [curve[0] + curve[1] * a + curve[2] * b for a, b, _ in rows]
        return pd.DataFrame({"score": [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], "words": [n for _, _, n in rows]})

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), scored("text").alias("_s")).select(
        "doc_id", "held_out", F.col("_s.score").alias("score"),
        (F.col("_s.score") >= TOXIC_FROM).cast("int").alias("predicted"), F.col("_s.words").alias("n_folded_words"),
    )
