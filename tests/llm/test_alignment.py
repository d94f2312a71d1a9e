"""Cross-tokenizer alignment against the libraries and a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tests.support import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emrecon.llm import alignment
from emrecon.llm.bpe import byte_table

FILES = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[2])


def slow(rows, both):
    """doc -> columns, pair by pair, from (doc_id, text) rows."""
    a, b = both
    table, docs, counts = byte_table(FILES[0]), [], Counter()
    for doc, text in rows:
        ta = a.encode(" " + (text or ""), add_special_tokens=False).ids
        tb = b.encode(text or "", num_threads=1)
        ba = [table[i] for i in ta]
        bb = []
        for i in tb:
            p = b.id_to_piece(i)
            bb.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        want = (" " + (text or "")).encode()
        if not text or b"".join(ba) != want or b"".join(bb) != want:
            docs.append((doc, [], [], [], ""))
            continue
        spans = []
        for parts in (ba, bb):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(tb) and spans[1][k][0] < e:
                links.append((ta[i], tb[k]))
                k += 1
        groups, i, j = [], 0, 0
        for hi in ends:
            group = []
            for ids, own, at in ((ta, spans[0], i), (tb, spans[1], j)):
                to = at
                while to < len(own) and own[to][1] <= hi:
                    to += 1
                group.append((",".join(map(str, ids[at:to])), to))
            groups.append(group[0][0] + "|" + group[1][0])
            i, j = group[0][1], group[1][1]
        docs.append((doc, ta, tb, links, ";".join(groups)))
        counts.update(set(links))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for doc, ta, tb, links, groups in docs:
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((doc, len(ta), len(tb), len(groups.split(";")) if groups else 0, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


PARTS = st.lists(st.sampled_from(["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " ", "  ", "\n", "\t", "word", "Words", "é", "漢字", "🙂", "\x00", "▁", "123", "'s", "ﬁ", "①", " ", "　", "xyz" * 9, ",", "!?", "\r\n"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_words_give_the_pieces_of_the_whole(both, text):
    align = alignment.aligner(*FILES)
    ids = both[1].encode(text, num_threads=1)
    whole = b"".join(align.b[i] for i in ids) == f" {text}".encode()
    got = align.tokens(text)
    assert (got is None) == (not whole or not text)
    if got:
        assert got[1].tolist() == ids


@settings(max_examples=200, deadline=None)
@given(PARTS)
def test_first_tokens_are_the_librarys(both, text):
    found = alignment.aligner(*FILES).tokens(text)
    if found:
        assert found[0].tolist() == both[0].encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=30))
def test_packing_reads_back(numbers):
    assert alignment.unpacked(alignment.packed(np.array(numbers, np.int64))).tolist() == numbers


@pytest.mark.parametrize("hot", [1 << 18, 50])
def test_query_equals_brute_force(spark, both, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    got = alignment.op11_alignment(spark, DATA)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert set(got.columns) == set(COLUMNS)
    assert rows_of(got) == slow(docs, both)


def test_odd_rows(spark, odd, none, both):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(alignment.measures(odd, *FILES)) == slow(docs, both)
    assert alignment.measures(none, *FILES).collect() == []


def test_copies_are_aligned_once_and_counted_all(spark, docs_of, both):
    rng = random.Random(3)
    rows = [(i, "the same words here" if i % 3 == 0 else " ".join(rng.choices(["alpha", "béta", "gamma's", "▁", "x1"], k=rng.randrange(6)))) for i in range(300)]
    docs = docs_of(rows)
    texts = alignment.distinct_texts(docs)
    assert texts.count() == len({t for _, t in rows if t}) and sum(r.copies for r in texts.collect()) == sum(bool(t) for _, t in rows)
    assert rows_of(alignment.measures(docs, *FILES)) == slow(rows, both)


def test_full_output(spark, docs_of):
    docs = docs_of([(1, "hello world"), (2, "hello world")])
    [row] = alignment.aligned(alignment.distinct_texts(docs), *FILES, full=True).collect()
    assert row.copies == 2 and len(row.a_ids) == row.n_a and len(row.b_ids) == row.n_b
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1
