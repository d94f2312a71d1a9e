"""Fill-in-middle: the skip list's cuts, forms, round trips, SQL."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tests.support import DATA

from emrecon.llm import fill_in_middle as fim

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def slow(doc_id, text):
    """By the definition, unit by unit."""
    units = UNITS.findall(text)
    n, (h1, h2, h3, h4) = len(units), fim.draws(doc_id)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = st.lists(st.sampled_from(["<P>", "<S", ">", "<", "<M", "ab", "Z", " ", "\n", "é", "漢", "🙂", "\x00", "[", "@", "{", "`", "x" * 40]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_every_cut(text, block):
    units = UNITS.findall(text)
    cuts = fim.SkipList(text, block)
    assert cuts.units == len(units)
    at = 0
    for rank, unit in enumerate([*units, ""]):
        assert cuts.place(rank) == at
        at += len(unit)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(0, 10_000)), TEXTS)
def test_outputs_and_round_trip(doc_id, text):
    got = fim.transform(doc_id, text)
    assert got == slow(doc_id, text)
    assert fim.restore(got[4], got[1]) == text


def test_long_texts_descend_in_few_steps():
    text = "word, " * 400_000 + "x" * 300_000 + "é" * 300_000
    cuts = fim.SkipList(text)
    ends = [m.end() for m in UNITS.finditer(text)]
    for rank in (0, 1, 15, 777_777, len(ends) - 299_999, len(ends) - 1, len(ends)):
        cuts.steps = 0
        assert cuts.place(rank) == (ends[rank - 1] if rank else 0)
        assert cuts.steps < 40 * len(cuts.lanes)
    assert len(cuts.lanes) >= 4 and len(cuts.lanes[-1][0]) < len(ends) / 12


def test_all_forms_occur(spark):
    rows = fim.op12_fill_in_middle(spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and len(rows) == len(texts)
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_equals_sql(spark, duck):
    got = fim.op12_fill_in_middle(spark, DATA)
    want = duck.sql(fim.ORACLE).fetchall()
    assert got.columns == [c[0] for c in duck.sql(fim.ORACLE).description]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_rows(odd, none):
    rows = fim.read_back(fim.fill_in_middle(odd)).collect()
    want = sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert sorted((str(r.doc_id), r.restored) for r in rows) == want
    assert sorted((str(r.doc_id), *slow(r.doc_id, r.restored)) for r in rows) == sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows)
    assert fim.fill_in_middle(none).collect() == [] and fim.digests(none).collect() == []
