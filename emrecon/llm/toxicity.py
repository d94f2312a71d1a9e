"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: words and word beginnings that occur almost only in toxic rows.
Of a bounded sample of labelled rows one part yields the lexicon, counted by Spark, one
the trees and one the calibration. Trees see densities and counts of lexicon words, hits
near a second-person word, rates of capitals and punctuation, and rates of disguised
spellings; every whole text is scored in Arrow batches.

Defined cases: null and empty texts have zero features and get a score like any other;
a text of any length is scored whole; repeated rows get the same score; a null doc_id is in
no fold, so held_out is null; of several labels of a document the larger counts, and of
lexicon terms with one bound the first by name; without labelled rows of both classes every
score is the share of toxic rows (0.5 without any); an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.llm.common import documents, free_name, held
from emrecon.llm.training import isotonic, labelled_sample, remainder, sigmoid, with_scores

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Entries of the lexicon at most.
LEXICON = 5_000
#: Lengths of the word beginnings that are counted beside whole words.
STEMS = (4, 5, 6)
#: Tokens whose flags a worker keeps at most; then it starts anew.
CACHE = 200_000

# Second-person words of four languages, and letters that digits and signs stand for.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros su".split())
FOLD = str.maketrans("0134578@$!|", "oieastbasil")
EDGES = string.punctuation + "«»¿¡…“”„’‘–—"
WORD, STEM, WEAK, YOU, HIDDEN, MIXED, CAPS = (1 << i for i in range(7))

FEATURES = ["word_density", "word_hits", "stem_density", "stem_hits", "weak_density", "weak_hits", "near_second", "second", "hidden_hits", "mixed", "all_caps", "capitals", "punctuation", "exclamation", "elongated", "n_words", "word_length"]


def core(token: str) -> str:
    return token.strip(EDGES).lower()


def unfolded(word: str) -> str:
    """The spelling that signs, digits, gaps and repeated letters may hide."""
    plain = "".join(c for c in word.translate(FOLD) if c.isalpha())
    return "".join(c for i, c in enumerate(plain) if plain[i - 2 : i] != c * 2 or i < 2)


def count_terms(rows: DataFrame) -> DataFrame:
    """term, pos, neg: rows with the term by class. Beginnings end in an asterisk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(), Counter()
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                words = {core(t) for t in set(text.as_py().split())}
                words |= {w[:k] + "*" for w in words for k in STEMS if len(w) > k}
                seen[y].update(words)
            terms = [*{*seen[0], *seen[1]} - {""}]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[y][t] for t in terms], pa.int64()) for y in (1, 0))], ["term", "pos", "neg"])

    return rows.select("y", "text").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def lexicon(rows: DataFrame, most: int = LEXICON) -> dict[str, int]:
    """term -> WORD, STEM or WEAK, by the lower bound (95 %) of the share of toxic rows
    among those with the term."""
    n, share = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    z = 1.96**2
    bound = (share + z / (2 * n) - F.sqrt(z * (share * (1 - share) + z / (4 * n)) / n)) / (1 + z / n)
    top = count_terms(rows).where("pos >= 3").withColumn("bound", bound).where("bound >= 0.4").orderBy(F.desc("bound"), "term").limit(most)
    return {r["term"]: (STEM if r["term"].endswith("*") else WORD) if r["bound"] >= 0.7 else WEAK for r in top.collect()}


class Flags:
    """token -> bits of what it is, for the tokens that came up last."""

    def __init__(self, lex: dict[str, int]):
        self.lex, self.known = lex, {}

    def of(self, token: str) -> int:
        word = core(token)
        lex = self.lex
        bits = lex.get(word, 0) | (YOU if word in SECOND else 0)
        for k in STEMS:
            bits |= lex.get(word[:k] + "*", 0) if len(word) > k else 0
        if not word.isalpha() and any(c.isalpha() for c in word):
            bits |= MIXED
        plain = unfolded(word) if bits & MIXED or len(word) > 3 else word
        if plain != word and (lex.get(plain, 0) | max((lex.get(plain[:k] + "*", 0) for k in STEMS if len(plain) > k), default=0)) & (WORD | STEM):
            bits |= HIDDEN
        return bits | (CAPS if len(word) > 1 and token.isupper() else 0)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if new := set(tokens).difference(self.known):
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(tokens)
            for t in new:
                self.known[t] = self.of(t)
        return np.frombuffer(bytes(map(self.known.__getitem__, tokens)), np.uint8)


_UPPER, _PUNCT = (np.array([chr(i) in s for i in range(256)], float) for s in (string.ascii_uppercase, string.punctuation))


def features(text: str, flags: Flags) -> list[float]:
    tokens = text.split()
    raw = np.frombuffer(text.encode(), np.uint8)
    bits, n, size = flags(tokens), max(1, len(tokens)), max(1, len(raw))
    hist = np.bincount(raw, minlength=256)
    counts = {b: int(np.count_nonzero(bits & b)) for b in (WORD, STEM, WEAK, YOU, HIDDEN, MIXED, CAPS)}
    near = 0
    if counts[YOU]:
        hits, you = np.flatnonzero(bits & (WORD | STEM | HIDDEN)), np.flatnonzero(bits & YOU)
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(hits - you[np.maximum(at - 1, 0)]))
        near = int((gap <= 3).sum())
    elongated = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] > 64)).sum()) if len(raw) > 2 else 0
    out = []
    for b in (WORD, STEM, WEAK):
        out += [100 * counts[b] / n, float(np.log1p(counts[b]))]
    return [*out, float(near), counts[YOU] / n, float(np.log1p(counts[HIDDEN])), counts[MIXED] / n, counts[CAPS] / n, hist @ _UPPER / size, hist @ _PUNCT / size, hist[33] / size, elongated / size, float(np.log1p(len(tokens))), size / n]


class Trees:
    """Boosted trees of one depth for the logistic loss, over binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.start, self.nodes, self.leaves = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        self.start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        margin = np.full(n, self.start)
        for _ in range(self.trees):
            p = sigmoid(margin)
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, splits = np.zeros(n, int), []
            for level in range(self.depth):
                k = 1 << level
                best = np.zeros(k), np.zeros(k, int), np.full(k, self.bins)
                for f in range(m):
                    sums = [np.bincount(node * self.bins + binned[:, f], w, k * self.bins).reshape(k, self.bins) for w in (g, h)]
                    (gl, hl), (gt, ht) = (s.cumsum(1)[:, :-1] for s in sums), (s.sum(1, keepdims=True) for s in sums)
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(k), at]
                    better = top > best[0] + 1e-9
                    for b, v in zip(best, (top, np.full(k, f), at), strict=True):
                        b[better] = v[better]
                splits.append([(int(f), float(edges[f][t]) if t < len(edges[f]) else np.inf) for f, t in zip(best[1], best[2], strict=True)])
                node = node * 2 + (binned[np.arange(n), best[1][node]] > best[2][node])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, k) / (np.bincount(node, h, k) + 1)
            self.nodes.append(splits)
            self.leaves.append(leaf)
            margin += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for splits, leaf in zip(self.nodes, self.leaves, strict=True):
            node = np.zeros(len(x), int)
            for level in splits:
                which, cut = np.array([s[0] for s in level]), np.array([s[1] for s in level])
                node = node * 2 + (x[np.arange(len(x)), which[node]] > cut[node])
            out += leaf[node]
        return out


class Model:
    """Trees with their lexicon and calibration. The raw probability breaks the ties that
    the isotonic steps leave, at a weight of a thousandth."""

    def __init__(self, lex: dict[str, int], trees: Trees, knots: tuple[np.ndarray, np.ndarray]):
        self.lex, self.trees, self.knots = lex, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.trees.margin(x)
        return (np.interp(m, *self.knots) + 1e-3 * sigmoid(m)) / 1.001


def feature_rows(rows: DataFrame, lex: dict[str, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = Flags(lex)
        for batch in batches:
            x = [features(t.as_py(), flags) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), pa.array(x, pa.list_(pa.float64()))], ["y", "part", "x"])

    return rows.select("y", "part", "text").mapInArrow(run, "y int, part double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, fold, bound: int = SAMPLE) -> Model | float:
    """The model, or a constant score where the sample lacks a class."""
    rows = labelled_sample(docs, labels, "toxic", fold, bound)
    lex = lexicon(rows.where("part < 0.4"))
    got = feature_rows(rows.where("part >= 0.4"), lex).toPandas()  # a row of features for each row of the bounded sample
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        known = rows.agg(F.avg("y")).first()[0]
        return 0.5 if known is None else float(known)
    x, part = np.stack(got["x"].to_numpy()), got["part"].to_numpy()
    fits = part < 0.8
    if len(set(y[fits])) < 2 or len(set(y[~fits])) < 2:
        fits[:] = True
    trees = Trees().fit(x[fits], y[fits])
    held = ~fits if not fits.all() else fits
    return Model(lex, trees, isotonic(trees.margin(x[held]), y[held]))


def _flags(model: Model) -> Flags:
    found = held("flags", lambda: Flags(model.lex))
    if found.lex is not model.lex:
        found.lex, found.known = model.lex, {}
    return found


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON entries and the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        flags = None if isinstance(m, float) else _flags(m)
        for batch in batches:
            n = batch.num_rows
            s = np.full(n, m) if flags is None else m.score(np.array([features(t.as_py(), flags) for t in batch.column("text")]).reshape(n, -1)) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, remainder(5) != 0, bound))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score is below ``threshold``; all
    of them where labels of one class are missing."""
    model = fit(docs, labels, remainder(5) != 0, bound)
    if isinstance(model, float):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: list[str]) -> np.ndarray:
        m = shared.value
        flags = _flags(m)
        return m.score(np.array([features(t, flags) for t in texts]))

    name = free_name(docs, "toxicity")
    return with_scores(docs, scores, name).where(F.col(name) < threshold).drop(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
