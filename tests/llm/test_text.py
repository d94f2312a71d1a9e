"""Chat formatting, token counts, packing, BPE."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tests.support import DATA, same
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emrecon.llm import bpe, chat_format, packing, token_files, vocab
from emrecon.llm.common import new_path
from pyspark.sql import functions as F

BYTE, RANKS, WORD = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def test_chat_equals_sql(spark, duck):
    same(chat_format.op1_chat_formatting(spark, DATA).toPandas(), duck.sql(chat_format.ORACLE).df())


MARKS = ["</s>", "[INST]", "[/INST]", "\\", "<\\/s>", "[\\INST]", "<", "[", "a\n", "", "</s", "INST]", "é🙂"]


def test_chat_reads_back(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "", None, "[INST]"]), "".join(rng.choices(MARKS, k=rng.randrange(6))) if rng.random() < 0.9 else None) for c in range(40) for t in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_trees(chat_format.as_tree(df)).withColumns({"turns": chat_format.read_back(F.col("formatted")), "learnt": chat_format.under_loss(F.col("formatted"), F.col("loss"))})
    got = {r.tree.id: r for r in out.collect()}
    for c in range(40):
        own = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].learnt == "".join(r[3] or "" for r in own if r[2] == "assistant")


def test_chat_branches(spark):
    # 1 - 2 - 4, 1 - 3 - 5 - 6, and a root whose parent is missing
    rows = [(1, None, 0.0), (2, 1, 5.0), (4, 2, 5.0), (3, 1, 1.0), (5, 3, None), (6, 5, 9.0), (7, 99, 1.0)]
    m = spark.createDataFrame([(1, i, p, "user", f"m{i}", s) for i, p, s in rows], "tree long, msg long, parent long, role string, text string, score double")
    best = chat_format.best_branches(m, 2)
    path = lambda b: [r.msg for r in best.where(F.col("branch") == b).orderBy(F.desc("up")).collect()]
    assert path(1) == [1, 2, 4] and path(2) == [1, 3, 5, 6]
    assert chat_format.format_trees(m.where("false")).count() == 0
    loop = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2)], "tree long, msg long, parent long").selectExpr("*", "'user' AS role", "'t' AS text", "0D AS score")
    with pytest.raises(ValueError):
        chat_format.format_trees(loop)


def test_chat_ties_long_texts_and_other_columns(spark):
    long = "</s>[INST] " * 40_000
    m = spark.createDataFrame([(1, i, p, "assistant" if p else "user", long if i == 1 else f"m{i}", 1.0) for i, p in [(1, None), (2, 1), (3, 1), (4, 2), (5, 3)]], "tree long, msg long, parent long, role string, text string, score double")
    best = chat_format.best_branches(m, 3)
    path = lambda b: [r.msg for r in best.where(F.col("branch") == b).orderBy(F.desc("up")).collect()]
    assert path(1) == [1, 2, 4] and path(2) == [1, 3, 5] and path(3) == []  # of equal scores the smaller leaf
    clashing = m.selectExpr("*", "'x' AS branch", "'x' AS leaf", "'x' AS up", "'x' AS formatted", "'x' AS loss", "'x' AS start", "'x' AS head")
    out = chat_format.format_trees(clashing.select(m.columns), 1).withColumn("turns", chat_format.read_back(F.col("formatted")))
    [row] = out.collect()
    assert [t.text for t in row.turns] == [long, "m2", "m4"]


def test_chat_of_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string, tree string, msg string")
    rows.write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat_format.op1_chat_formatting(spark, f"file://{tmp_path}").collect()] == [-1]


def test_chat_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, 1, "user", "a"), (None, None, None, None), (3, 1, "assistant", "x"), (3, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {r.tree.none: r for r in chat_format.format_trees(chat_format.as_tree(df)).collect()}
    assert got[False].formatted.count("assistant") == 2 and len(got[False].loss) == 2
    assert got[True].formatted == "[INST][/INST]</s>[INST]user[/INST]a</s>"


TEXTS = st.text(st.sampled_from(list("ab eé漢🙂'\n\t1!<|\x1f\x1c İΣ")) | st.characters(exclude_categories=("Cs",)), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_encoders_equal_the_library(text):
    ids = bpe.encoder(BYTE, RANKS)(text)
    want = vocab.load(BYTE).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert bpe.decode(ids, BYTE).decode() == vocab.load(BYTE).decode(want, skip_special_tokens=False)
    assert np.frombuffer(vocab.word_bpe(WORD)(text), "<u4").tolist() == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids if len(text) < 5 else True
    assert np.frombuffer(vocab.word_bpe(WORD)(text), "<u4").tolist() == vocab.load(WORD).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ["x", "ab", "abcdefgh", "é漢🙂", "!?.'", "12", " ", "the and ing"[:3] + "aeiou"])
@pytest.mark.parametrize("window", [1, 4])
def test_trees_equal_the_library(alphabet, window):
    rng = random.Random(3)
    encode = bpe.TreeEncoder(BYTE, RANKS, leaf=16, window=window)
    for n in (17, 100, 3000):
        text = "".join(rng.choices(alphabet, k=n))
        assert encode(text + " end " + text).tolist() == vocab.load(BYTE).encode(text + " end " + text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab  eé漢🙂'\n\t1!<|\x1c\u00a0 sto.")), max_size=80), st.sampled_from(["", "<|endoftext|>", " <|endoftext|> "]), st.sampled_from([1, 3, 8]))
def test_halved_texts_equal_the_library(text, special, leaf):
    text = text[: len(text) // 2] + special + text[len(text) // 2 :]
    encode = bpe.TreeEncoder(BYTE, RANKS, window=1, text_leaf=leaf)
    assert encode(text).tolist() == vocab.load(BYTE).encode(text, add_special_tokens=False).ids
    assert encode.joins or len(text) <= leaf


def test_texts_with_long_runs_are_halved():
    words = " ".join(f"word{i}" for i in range(3000))
    for run in ("x" * 1500, "é" * 3000, " " * 1500, "ab12" * 2000):
        text = words + " " + run + " " + words
        encode = bpe.TreeEncoder(BYTE, RANKS)
        assert encode(text).tolist() == vocab.load(BYTE).encode(text, add_special_tokens=False).ids
        assert encode.joins >= len(text) // bpe.TEXT_LEAF // 2


def test_exchange_goes_on_while_it_saves(spark):
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(random.Random(8).choices(range(200, 1200), k=1500))]
    pieces = spark.createDataFrame(rows, packing.ITEM)
    got = packing.pack(pieces, partition=20).collect()
    bins = len({r.sequence_id for r in got})
    fill = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(got) == 1500
    assert bins <= 1.01 * packing.lower_bound(np.array([r[4] for r in rows]), 2048) + 1


def test_bpe_of_all_documents(spark):
    """Equal to the library; the tree joins parts of most documents, and of rows in several tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in bpe.op7_bpe(spark, "/root/testdata/sf0.01").collect()}
    dealt = {r.doc_id: r for r in bpe.digests(docs, BYTE, RANKS, chunk=3000).collect()}
    assert rows == dealt and len(rows) == docs.count()
    library, tree, halved = vocab.load(BYTE), bpe.TreeEncoder(BYTE, RANKS), 0
    for d in docs.collect():
        ids = library.encode(d.text, add_special_tokens=False).ids
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256) == (len(ids), *want)
        assert tree(d.text).tolist() == ids
        halved += len(d.text) > bpe.TEXT_LEAF
    assert halved > 50 and tree.joins >= halved


def test_bpe_rows(spark, odd, none):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, BYTE, RANKS).collect()}
    for r in odd.collect():
        ids = vocab.load(BYTE).encode(r.text or "", add_special_tokens=False).ids
        text = vocab.load(BYTE).decode(ids, skip_special_tokens=False)
        assert (r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) in got
    assert bpe.digests(none, BYTE, RANKS).count() == 0
    table = {r.doc_id: r for r in bpe.encode_table(odd.where("doc_id < 6"), BYTE, RANKS).collect()}
    assert table[5].decoded == "one two" and len(table[1].ids) == 0


def pieces_of(texts):
    out = {}
    for i, t in texts:
        ids = np.array([*vocab.load(WORD).encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out[i] = [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    return out


def check_packing(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) >= -(-sum(r.length for r in rows) // capacity)
    return len(bins)


def test_packing_of_all_documents(spark):
    rows = packing.op6_best_fit_packing(spark, DATA).collect()
    n = check_packing(rows)
    assert n <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    want = pieces_of([(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_packing_of_odd_rows(spark, odd, none):
    rows = packing.pack(packing.tokenize(odd, WORD), partition=5).collect()
    check_packing(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in odd.collect())
    assert packing.pack(packing.tokenize(none, WORD)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_bounds_and_best_fit(lengths):
    bins = packing.best_fit(lengths, 40)
    fill = Counter()
    for n, b in zip(lengths, bins, strict=True):
        fill[b] += n
    assert max(fill.values()) <= 40
    assert packing.lower_bound(np.array(lengths), 40) <= len(fill)


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([21] * 10), 40) == 10
    assert packing.lower_bound(np.array([14] * 9), 40) == 5  # two fit, three do not


def test_exchange_saves_bins(spark):
    items = [(i, i, 0, 0, 1 + i * 37 % 2047, 0) for i in range(600)]
    rows = packing.pack(spark.createDataFrame(items, packing.ITEM), partition=20).collect()
    n = check_packing(rows)
    assert n <= packing.lower_bound(np.array([i[4] for i in items]), 2048) * 1.03 + 1


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_token_counts(spark, odd, block):
    folder = new_path(spark, "t")
    listed = token_files.write_files(odd.where("doc_id <> 6 AND doc_id <> 8 AND doc_id <> 12 OR doc_id IS NULL") if block < 100 else odd, folder, RANKS)
    got = token_files.count_tokens(listed, folder, block=block).join(listed, ["file", "ordinal"])
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = got.collect()
    assert len(rows) == listed.count() > 8
    for r in rows:
        assert r.n_tokens == len(vocab.byte_ranks(RANKS).encode_ordinary(texts[r.doc_id]))


@pytest.mark.parametrize("span", [1, 2, 4096])
def test_token_files_from_elsewhere(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(token_files, "SPAN", span)
    np.array([7, 7, 9, 9, 5, 9, 1, 2], "<u4").tofile(tmp_path / "a")
    np.array([9], "<u4").tofile(tmp_path / "b")
    np.array([], "<u4").tofile(tmp_path / "c")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    for block in (4, 8, 1024):
        got = token_files.count_tokens(files, f"file://{tmp_path}", 9, "<u4", block).orderBy("file", "ordinal").collect()
        assert [tuple(r) for r in got] == [("a", 0, 2), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 0, 0)]
    with pytest.raises(ValueError):
        token_files.count_tokens(files, f"file://{tmp_path}", 9, "<u4", 6)


def test_token_counts_of_all_documents(spark, none):
    got = {r.doc_id: r.n_tokens for r in token_files.op3_token_counts(spark, DATA).collect()}
    want = {r.doc_id: len(vocab.byte_ranks(RANKS).encode_ordinary(r.text)) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert got == want
    folder = new_path(spark, "t")
    assert token_files.count_tokens(token_files.write_files(none, folder, RANKS), folder).count() == 0
