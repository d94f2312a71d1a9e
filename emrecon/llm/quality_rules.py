"""Quality rules: fixed base rules and a hashed n-gram logistic regression.

The regression sees word n-grams (words, pairs, pairs of word shapes, repeats) and
character n-grams (four bytes), hashed into fixed tables. A document's margin is the mean
weight over its word n-grams plus that over its character n-grams. It is fitted on a
bounded sample of labelled rows, by gradients that tasks take over their rows and Spark
brings together, calibrated to probabilities on a part kept apart, and scored in Arrow batches; a document stays if no base rule fails and its probability
reaches a fixed threshold.

Defined cases: null and empty texts have no words, so the base rules fail; a text of any
length is counted and scored whole; a probability of the threshold itself passes; an empty
table gives no rows; a null doc_id is scored like any other; without labelled rows of both classes the base rules decide
alone; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.llm.common import cut, documents, free_name, held
from emrecon.llm.training import descend, labelled_sample, parts_of, platt, remainder, sigmoid, with_scores

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8_000
#: Entries of each hashed table; a power of two.
SIZE = 1 << 15
#: Passes over the sample.
STEPS = 40
#: Probability from which a document stays.
THRESHOLD = 0.5
#: Base rules: least words, and percent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATS = 50, 50
#: Tokens whose hashes a worker keeps at most; then it starts anew.
CACHE = 200_000

_SHAPES = [(re.compile(p), s) for p, s in ((rb"[a-z]+|[\x80-\xff]+", b"x"), (rb"[A-Z]+", b"X"), (rb"[0-9]+", b"9"), (rb"(?:xX?|Xx)[xX]*", b"w"))]


class Tokens:
    """token -> hash of the word in the upper and of its shape in the lower 32 bits."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    @staticmethod
    def shape(token: bytes) -> bytes:
        if token.isupper() and len(token) > 1:
            return b"U" + bytes(c for c in token if c < 65)
        for pattern, by in _SHAPES:
            token = pattern.sub(by, token)
        return token

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        if new := set(tokens).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(tokens)
            self.known.update({t: zlib.crc32(t.lower()) << 32 | zlib.crc32(self.shape(t)) for t in new})
        return np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    mixed = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - SIZE.bit_length() + 1)).astype(np.int32)


def slots(raw: bytes, words: list[bytes], tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the word n-grams and of the character n-grams, as often as they occur."""
    both = tokens(words)
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    parts = [_slot(word, 1)]
    if len(both) > 1:
        pair = word[:-1] * np.uint64(0x100000001B3) ^ word[1:]
        parts += [_slot(np.where(word[:-1] == word[1:], np.uint64(0), pair), 2), _slot(shape[:-1] * np.uint64(0x100000001B3) ^ shape[1:], 3)]
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    grams = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24) if len(b) > 3 else b[:0]
    return np.concatenate(parts), _slot(grams, 4)


_SPACES, _SYMBOLS = np.array([32, *range(9, 14)]), np.frombuffer(b"#*$%&|<>", np.uint8)


def base(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(hist[128:192].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeats = len(words), 0
    if n >= 3:
        first: dict[bytes, int] = {}
        ids = np.array([first.setdefault(w, len(first)) for w in words], np.int64)
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        _, window, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
        again = np.r_[count[window] > 1, False, False]
        repeats = int((again | np.r_[False, again[:-1]] | np.r_[False, False, again[:-2]]).sum())
    return n, points - int(hist[_SPACES].sum()), int(hist[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeats


class Regression:
    def __init__(self):
        self.w, self.bias, self.slope, self.offset = np.zeros(2 * SIZE), 0.0, 1.0, 0.0

    def margin(self, word: np.ndarray, char: np.ndarray) -> float:
        return self.bias + (float(self.w[word].mean()) if len(word) else 0.0) + (float(self.w[SIZE + char].mean()) if len(char) else 0.0)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margin + self.offset)


def shares(word: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the joint table and their shares, each half's adding up to 1."""
    a, n = np.unique(word, return_counts=True)
    b, m = np.unique(char, return_counts=True)
    return np.concatenate([a, SIZE + b]).astype(np.int32), np.concatenate([n / max(1, n.sum()), m / max(1, m.sum())])


def _tokens() -> Tokens:
    return held("tokens", Tokens)


def entry_rows(rows: DataFrame) -> DataFrame:
    """y, part and the entries (at, x) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, part, text in zip(batch.column("y"), batch.column("part"), batch.column("text"), strict=True):
                raw = text.as_py().encode()
                at, x = shares(*slots(raw, raw.split(), _tokens()))
                yield pa.RecordBatch.from_arrays([pa.array([y.as_py()], pa.int32()), pa.array([part.as_py()]), pa.array([at.tobytes()]), pa.array([x.astype(np.float32).tobytes()])], ["y", "part", "at", "x"])

    return rows.select("y", "part", "text").mapInArrow(run, "y int, part double, at binary, x binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all rows of a batch, their shares, and the row of each."""
    at, x = batch.column("at").to_pylist(), batch.column("x").to_pylist()
    row = np.repeat(np.arange(len(at)), [len(a) // 4 for a in at])
    return np.frombuffer(b"".join(at), np.int32), np.frombuffer(b"".join(x), np.float32), row


def margins_of(params: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Margins of a batch of entries; the last parameter is the bias."""
    at, x, row = _unpacked(batch)
    return params[-1] + np.bincount(row, params[at] * x, batch.num_rows)


def gradient(params: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Gradient of the logistic loss, summed over a batch of entries."""
    at, x, row = _unpacked(batch)
    err = sigmoid(params[-1] + np.bincount(row, params[at] * x, batch.num_rows)) - batch.column("y").to_numpy()
    return np.append(np.bincount(at, err[row] * x, len(params) - 1), err.sum())


def fit(docs: DataFrame, labels: DataFrame, fold, bound: int = SAMPLE, steps: int = STEPS) -> Regression | None:
    """The model, or None where the sample lacks a class. Entries stay in a written table;
    of each row only its margin and label come to the driver, for the calibration."""
    rows = labelled_sample(docs, labels, "quality", fold, bound)
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    fits, held = parts_of(cut(entry_rows(rows), "entries"), 0.75)
    start = np.zeros(2 * SIZE + 1)
    start[-1] = np.log((counts[1] + 1) / (counts[0] + 1))
    params = descend(fits, gradient, start, np.append(np.ones(2 * SIZE), 0.1), 1e-6, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(margins_of(params, batch), pa.float64())], ["y", "margin"])

    got = held.mapInArrow(run, "y int, margin double").toPandas()  # two numbers for each row of the bounded sample
    model = Regression()
    model.w, model.bias = params[:-1], float(params[-1])
    model.slope, model.offset = platt(got["margin"].to_numpy(), got["y"].to_numpy(float))
    return model


def verdicts(docs: DataFrame, model: Regression | None, threshold: float = THRESHOLD) -> DataFrame:
    """The base counts of every whole text, base_failed, probability and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tokens = shared.value, _tokens()
        for batch in batches:
            counts, margins = [], []
            for text in batch.column("text"):
                raw = text.as_py().encode()
                words = raw.split()
                counts.append(base(raw, words))
                margins.append(m.margin(*slots(raw, words, tokens)) if m else 0.0)
            p = m.probability(np.array(margins)) if m else np.ones(len(margins))
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(p, pa.float64())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"])

    out = documents(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Fitted on three of four folds, so that the fourth measures it."""
    return verdicts(docs, fit(docs, labels, remainder(4) != 2, bound))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their columns, that pass all rules."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, remainder(4) != 2, bound))

    def scores(texts: list[str]) -> np.ndarray:
        """Probability of a good text, 0 where a base rule fails."""
        m, tokens, out = shared.value, _tokens(), []
        for text in texts:
            raw = text.encode()
            words = raw.split()
            n, _, _, _, repeats = base(raw, words)
            good = n >= LEAST_WORDS and 100 * repeats <= MOST_REPEATS * n
            out.append((float(m.probability(np.array(m.margin(*slots(raw, words, tokens))))) if m else 1.0) if good else 0.0)
        return np.array(out)

    name = free_name(docs, "quality")
    return with_scores(docs, scores, name).where(F.col(name) >= threshold).drop(name)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
