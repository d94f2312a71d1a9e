"""Toxicity, quality classifier, quality rules."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emrecon.llm import quality_fm, quality_rules, toxicity
from emrecon.llm.training import isotonic, platt

SF = "/root/testdata/sf0.01"


def held(spark, rows, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return [(truth[r.doc_id], r) for r in rows if r.doc_id in truth and r.held_out]


def test_toxicity_on_held_out_rows(spark):
    rows = toxicity.op2_toxicity(spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    pairs = held(spark, rows, "toxic")
    assert sum(y == r.predicted for y, r in pairs) >= 0.93 * len(pairs)


def test_toxicity_finds_toxic_rows(spark):
    """Rank order and recall on the fold that is held out, over enough toxic rows."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(truth[r.doc_id], r.score, r.predicted) for r in toxicity.op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for y, s, _ in rows if not y], [s for y, s, _ in rows if y]
    assert len(bad) > 60
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.95
    assert sum(p for y, _, p in rows if y) >= 0.8 * len(bad) and sum(p for y, _, p in rows if not y) <= 0.01 * len(good)


TOKENS = st.lists(st.sampled_from(["you", "You,", "your", "bad", "b4d", "badly", "BAD", "fine", "soooo", "aaa", "a1", "!!!", "é", "word"]), max_size=30)


@settings(max_examples=150, deadline=None)
@given(TOKENS)
def test_toxic_features_against_slow_versions(tokens):
    flags = toxicity.Flags({"bad": toxicity.WORD, "fine": toxicity.WEAK})
    text = " ".join(tokens)
    got = toxicity.features(text, flags)
    bits = [flags.of(t) for t in tokens]
    n, size = max(1, len(tokens)), max(1, len(text.encode()))
    count = lambda b: sum(bool(x & b) for x in bits)
    hits = [i for i, x in enumerate(bits) if x & (toxicity.WORD | toxicity.STEM | toxicity.HIDDEN)]
    you = [i for i, x in enumerate(bits) if x & toxicity.YOU]
    raw = text.encode()
    want = [v for b in (toxicity.WORD, toxicity.STEM, toxicity.WEAK) for v in (100 * count(b) / n, np.log1p(count(b)))]
    want += [sum(any(abs(i - j) <= 3 for j in you) for i in hits), count(toxicity.YOU) / n, np.log1p(count(toxicity.HIDDEN)), count(toxicity.MIXED) / n, count(toxicity.CAPS) / n]
    want += [sum(65 <= b <= 90 for b in raw) / size, sum(chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in raw) / size, raw.count(b"!") / size]
    want += [sum(a == b == c and c > 64 for a, b, c in zip(raw, raw[1:], raw[2:])) / size, np.log1p(len(tokens)), size / n]
    assert got == pytest.approx(want)


def test_quality_on_held_out_rows(spark):
    rows = quality_fm.op8_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    pairs = held(spark, rows, "quality")
    assert sum(y == r.predicted for y, r in pairs) >= 0.93 * len(pairs)


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_rules_on_all_documents(spark):
    rows = {r.doc_id: r for r in quality_rules.op10_quality_rules(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(d.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and not rows[r.doc_id].base_failed]
    assert sum(rows[r.doc_id].kept == bool(r.quality) for r in labels) >= 0.95 * len(labels)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab |#\n\t\x0bé漢")), max_size=60))
def test_base_counts(text):
    raw = text.encode()
    assert quality_rules.base(raw, raw.split()) == brute_base(text)


def made(docs_of, spark, bad):
    """Good prose and bad rows, with labels, the fold of each left to chance."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["tree", "house", "river", "stone", "cloud", "you"], k=70)) + (bad(rng) if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs_of(rows), labels


def test_disguised_words(spark, docs_of):
    docs, labels = made(docs_of, spark, lambda r: " " + r.choice(["idiot", "moron"]))
    model = toxicity.fit(docs, labels, toxicity.remainder(5) != 0)
    flags = toxicity.Flags(model.lex)
    assert flags("you 1d!ot".split())[1] & toxicity.HIDDEN and flags(["IDIOT!!"])[0] & (toxicity.WORD | toxicity.CAPS)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 4 for r in kept.collect()} == {1, 2, 3} and kept.count() == 300


def test_rules_keep_clean_rows(spark, docs_of):
    docs, labels = made(docs_of, spark, lambda r: " ### %%% $$$" * 20)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.collect()} & set(range(0, 400, 4))


@pytest.mark.parametrize("classify", [toxicity.classify, quality_fm.classify])
def test_no_labels_and_odd_rows(odd, none, labels, classify):
    rows = classify(odd, labels).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    assert [r.held_out for r in rows if r.doc_id is None] == [None]
    assert classify(none, labels).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality_fm, quality_rules])
def test_odd_rows_with_a_model(spark, odd, docs_of, module):
    docs, labels = made(docs_of, spark, lambda r: " IDIOT ### ### ###")
    labels = labels.unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 0)], labels.schema))
    both = docs.unionByName(odd)
    out = (module.judge if module is quality_rules else module.classify)(both, labels)
    assert out.count() == both.count()
    if module is quality_rules:
        odd_rows = {r.doc_id: r for r in module.verdicts(odd, None).collect()}
        assert odd_rows[1].base_failed and odd_rows[6].n_words == 30_000 and odd_rows[6].kept


def test_linear_time_pairs():
    m = quality_fm.Machine([np.array([0.5])])
    rng = np.random.default_rng(0)
    at, x = np.array([3, 9, 40, quality_fm.WORDS]), rng.normal(size=4)
    m.w[:] = rng.normal(size=len(m.w))
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margin(at, x) == pytest.approx(m.w[at] @ x + pairs)


def test_calibration():
    margin, y = np.array([-2.0, -1.0, 0.0, 1.0, 2.0]), np.array([0, 0, 1, 0, 1.0])
    knots, values = isotonic(margin, y)
    assert values.tolist() == [0.0, 0.5, 1.0] or values.tolist() == [0, 0.5, 1]
    slope, offset = platt(np.r_[margin, margin], np.r_[y, y])
    assert slope > 0 and platt(margin, np.ones(5)) == (1.0, 0.0)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    t = toxicity.Trees().fit(x[:400], y[:400])
    assert ((t.margin(x[400:]) > 0) == y[400:]).mean() > 0.9


def test_entries_and_gradients_against_slow_versions():
    """Word entries and pair sums of the machine, slots of the rules, both gradients by differences."""
    import pyarrow as pa

    text = "Good words, good WORDS | and 12 more\n\nwords ! !"
    distinct, stats = quality_fm.entries(text, len(text), quality_fm.Words())
    tokens = text.split()
    assert distinct.tolist() == sorted({zlib.crc32(t.lower().encode()) % quality_fm.WORDS for t in tokens})
    by = dict(zip(quality_fm.STATISTICS, stats, strict=True))
    assert by["n_words"] == pytest.approx(np.log1p(len(tokens))) and by["neighbours"] == pytest.approx(1 / len(tokens))
    assert by["bars"] == pytest.approx(1 / len(text)) and by["lines"] == pytest.approx(np.log1p(2))
    texts, y = [text, "other text entirely here", "", "good good good words"], [1, 0, 0, 1]
    got = [quality_fm.entries(t, len(t), quality_fm.Words()) for t in texts]
    edges = [np.array([0.1, 0.5])] * len(quality_fm.STATISTICS)
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array([a.tolist() for a, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float64()))], ["y", "at", "stats"])
    m = quality_fm.Machine(edges)
    m.w[:] = np.random.default_rng(1).normal(size=len(m.w))
    params = np.concatenate([m.w, m.v.ravel(), [0.3]])
    m.w0 = 0.3
    margins = quality_fm._margins(params, *quality_fm.vectors(batch, edges))[0]
    assert margins == pytest.approx([m.margin(*m.vector(*g)) for g in got])
    loss = lambda p: float(np.sum(np.log1p(np.exp(-(2 * np.array(y) - 1) * quality_fm._margins(p, *quality_fm.vectors(batch, edges))[0]))))
    g = quality_fm.gradient(params, batch, edges)
    for at in [*np.flatnonzero(np.abs(g) > 1e-9)[::97], len(params) - 1]:
        step = np.zeros(len(params))
        step[at] = 1e-5
        assert g[at] == pytest.approx((loss(params + step) - loss(params - step)) / 2e-5, abs=1e-5)

    tok = quality_rules.Tokens()
    word, char = quality_rules.slots(text.encode(), text.encode().split(), tok)
    assert len(word) == len(tokens) + 2 * (len(tokens) - 1) and len(char) == len(text.encode()) - 3
    raw = text.encode()
    slow = [int(quality_rules._slot(np.array([int.from_bytes(raw[i : i + 4], "little")], np.uint64), 4)[0]) for i in range(len(raw) - 3)]
    assert char.tolist() == slow
    rows = [quality_rules.shares(*quality_rules.slots(t.encode(), t.encode().split(), tok)) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in rows], pa.binary())], ["y", "at", "x"])
    params = np.random.default_rng(2).normal(size=2 * quality_rules.SIZE + 1)
    loss = lambda p: float(np.sum(np.log1p(np.exp(-(2 * np.array(y) - 1) * quality_rules.margins_of(p, batch)))))
    g = quality_rules.gradient(params, batch)
    model = quality_rules.Regression()
    model.w, model.bias = params[:-1], float(params[-1])
    assert quality_rules.margins_of(params, batch)[0] == pytest.approx(model.margin(word, char), abs=1e-5)
    for at in [*np.flatnonzero(np.abs(g) > 1e-9)[::13], len(params) - 1]:
        step = np.zeros(len(params))
        step[at] = 1e-5
        assert g[at] == pytest.approx((loss(params + step) - loss(params - step)) / 2e-5, abs=1e-5)
