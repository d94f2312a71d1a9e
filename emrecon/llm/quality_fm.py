"""Quality by a factorisation machine.

A document is a sparse vector: its distinct words, hashed, at equal weights of unit norm;
its structure statistics and, as metadata, its character count, each as the quantile
bin that it falls in. The machine has a weight and a short vector for each entry; the sum
over all pairs is taken in linear time as half of the squared sum less the sum of squares.
It is fitted on a bounded sample of labelled rows and calibrated on a part kept apart.

Defined cases: null and empty texts have no words and statistics of 0; the column
n_chars is not needed, the count is taken anew; a text of any length is scored whole;
repeated rows get the same score; a value on a bin's edge falls below it; of several labels
of a document the larger counts; a null doc_id is in no fold, so held_out is null; without
labelled rows of both classes every score is the share of good rows (0.5 without any); an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.llm.common import cut, documents, held
from emrecon.llm.training import descend, labelled_sample, parts_of, platt, remainder, sigmoid

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 10_000
#: Entries for hashed words (a power of two), bins for each statistic, length of the vectors.
WORDS, BINS, FACTORS = 1 << 14, 12, 8
#: Passes over the sample, step length and decay of the parameters.
STEPS, RATE, DECAY = 40, 0.05, 1e-4
#: Tokens whose entries a worker keeps at most; then it starts anew.
CACHE = 500_000

STATISTICS = ["n_words", "mean_word", "distinct", "top_word", "neighbours", "symbols", "capitals", "digits", "punctuation", "exclamation", "bars", "lines", "repeated_lines", "mean_line", "n_chars"]


class Words:
    """token -> entry of the word part."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if new := set(tokens).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(tokens)
            self.known.update({t: zlib.crc32(t.lower().encode()) & (WORDS - 1) for t in new})
        return np.fromiter(map(self.known.__getitem__, tokens), np.int32, len(tokens))


def _chars(s: str) -> np.ndarray:
    return np.array([chr(i) in s for i in range(256)], float)


_SYMBOLS, _UPPER, _DIGITS, _PUNCT = _chars("#*$%&|<>"), _chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _chars("0123456789"), _chars(".,;:!?'\"()-")


def entries(text: str, n_chars: int | None, words: Words) -> tuple[np.ndarray, list[float]]:
    """Distinct word entries, and the statistics by the order of STATISTICS."""
    tokens = text.split()
    ids = words(tokens)
    distinct, counts = np.unique(ids, return_counts=True)
    raw = np.frombuffer(text.encode(), np.uint8)
    hist, size, n = np.bincount(raw, minlength=256), max(1, len(raw)), max(1, len(ids))
    lines = [x for x in text.split("\n") if x.strip()]
    same = int((ids[1:] == ids[:-1]).sum()) if len(ids) > 1 else 0
    stats = [np.log1p(len(ids)), size / n, len(distinct) / n, counts.max(initial=0) / n, same / n, hist @ _SYMBOLS / size, hist @ _UPPER / size, hist @ _DIGITS / size, hist @ _PUNCT / size, hist[33] / size, hist[124] / size]
    stats += [np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(ids) / max(1, len(lines)), np.log1p(max(0, n_chars or 0))]
    return distinct, [float(s) for s in stats]


class Machine:
    """Weights, vectors and offset over word entries and statistics' bins."""

    def __init__(self, edges: list[np.ndarray], seed: int = 0):
        rng = np.random.default_rng(seed)
        m = WORDS + len(edges) * (BINS + 1)
        self.edges, self.w0, self.w, self.v = edges, 0.0, np.zeros(m), rng.normal(0, 0.02, (m, FACTORS))
        self.slope, self.offset = 1.0, 0.0

    def vector(self, distinct: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        bins = [WORDS + f * (BINS + 1) + int(np.searchsorted(e, s)) for f, (e, s) in enumerate(zip(self.edges, stats, strict=True))]
        at = np.concatenate([distinct, np.array(bins, np.int32)])
        x = np.ones(len(at))
        x[: len(distinct)] = 1 / np.sqrt(max(1, len(distinct)))
        return at, x

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        xv = self.v[at] * x[:, None]
        return float(self.w0 + self.w[at] @ x + 0.5 * ((xv.sum(0) ** 2).sum() - (xv**2).sum()))

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margin + self.offset)


def entry_rows(rows: DataFrame) -> DataFrame:
    """y, part, word entries and statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            got = [entries(t.as_py(), len(t.as_py()), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), pa.array([a.tolist() for a, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float64()))], ["y", "part", "at", "stats"])

    return rows.select("y", "part", "text").mapInArrow(run, "y int, part double, at array<int>, stats array<double>")


def vectors(batch: pa.RecordBatch, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all rows of a batch, their values, and where each row begins: of each row
    first one bin for each statistic, then its words."""
    n, k = batch.num_rows, len(edges)
    lists = batch.column("at")
    counts = np.diff(lists.offsets.to_numpy())
    stats = batch.column("stats").flatten().to_numpy().reshape(n, k)
    begins = np.cumsum(np.r_[0, counts[:-1] + k])
    at, x = np.empty(int(counts.sum()) + n * k, np.int64), np.ones(int(counts.sum()) + n * k)
    bins = (begins[:, None] + np.arange(k)).ravel()
    at[bins] = np.stack([WORDS + f * (BINS + 1) + np.searchsorted(e, stats[:, f]) for f, e in enumerate(edges)], 1).ravel()
    is_word = np.ones(len(at), bool)
    is_word[bins] = False
    at[is_word], x[is_word] = lists.flatten().to_numpy(), np.repeat(1 / np.sqrt(np.maximum(1, counts)), counts)
    return at, x, begins


def _margins(params: np.ndarray, at: np.ndarray, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins of the rows, the entries' parts of the factor sums, and these sums."""
    m = (len(params) - 1) // (FACTORS + 1)
    xv = params[m:-1].reshape(m, FACTORS)[at] * x[:, None]
    sums = np.add.reduceat(xv, begins)
    pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((xv**2).sum(1), begins))
    return params[-1] + np.add.reduceat(params[at] * x, begins) + pairs, xv, sums


def gradient(params: np.ndarray, batch: pa.RecordBatch, edges: list[np.ndarray]) -> np.ndarray:
    """Gradient of the logistic loss, summed over a batch: weights, vectors, offset."""
    at, x, begins = vectors(batch, edges)
    m = (len(params) - 1) // (FACTORS + 1)
    margin, xv, sums = _margins(params, at, x, begins)
    err = sigmoid(margin) - batch.column("y").to_numpy()
    row = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(at)]))
    gv = (err[row] * x)[:, None] * (sums[row] - xv)
    return np.concatenate([np.bincount(at, err[row] * x, m), np.stack([np.bincount(at, gv[:, k], m) for k in range(FACTORS)], 1).ravel(), [err.sum()]])


def fit(docs: DataFrame, labels: DataFrame, fold, bound: int = SAMPLE, steps: int = STEPS) -> Machine | float:
    """The machine, or a constant score where the sample lacks a class. Entries stay in a
    written table; of each row its statistics, then its margin, come to the driver."""
    rows = labelled_sample(docs, labels, "quality", fold, bound)
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    fits, held = parts_of(cut(entry_rows(rows), "entries"), 0.75)
    stats = np.stack(fits.select("stats").toPandas()["stats"].to_numpy())  # len(STATISTICS) numbers for each row of the bounded sample
    edges = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(stats.shape[1])]
    machine = Machine(edges)
    m = len(machine.w)
    start = np.concatenate([machine.w, machine.v.ravel(), [np.log((counts[1] + 1) / (counts[0] + 1))]])
    params = descend(fits, lambda p, batch: gradient(p, batch, edges), start, np.full(len(start), RATE), np.append(np.full(len(start) - 1, DECAY), 0.0), steps)
    machine.w, machine.v, machine.w0 = params[:m], params[m:-1].reshape(m, FACTORS), float(params[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(_margins(params, *vectors(batch, edges))[0], pa.float64())], ["y", "margin"])

    got = held.mapInArrow(run, "y int, margin double").toPandas()  # two numbers for each row of the bounded sample
    machine.slope, machine.offset = platt(got["margin"].to_numpy(), got["y"].to_numpy(float))
    return machine


def _words() -> Words:
    return held("entries", Words)


def score(docs: DataFrame, model: Machine | float) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by WORDS, BINS and FACTORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if isinstance(m, float):
                s = np.full(batch.num_rows, m)
            else:
                # n_chars is the text's own length, as in the table
                s = m.probability(np.array([m.margin(*m.vector(*entries(t, len(t), _words()))) for t in map(pa.StringScalar.as_py, batch.column("text"))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, remainder(4) != 2, bound))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
