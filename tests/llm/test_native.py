"""Exact dedup, sharding."""

import hashlib
import re
from collections import Counter

import pytest
from tests.support import DATA, same

from emrecon.llm import exact_dedup, sharding

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()


def test_dedup_equals_sql(spark, duck):
    same(exact_dedup.op5_exact_dedup(spark, DATA).toPandas(), duck.sql(exact_dedup.ORACLE).df())


def test_dedup_odd_rows(spark, odd, tmp_path):
    rows = exact_dedup.dedup_batch(spark, odd, f"file://{tmp_path}/i", buckets=4).collect()
    assert len(rows) == odd.count()
    by_sha = {}
    for r in rows:
        by_sha.setdefault(r.text_sha256, []).append(r)
    want = Counter(sha(r.text) for r in odd.collect())
    assert {k: len(v) for k, v in by_sha.items()} == want
    for k, group in by_sha.items():
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {want[k]}
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {min(ids, default=None)}


def test_dedup_batches(spark, docs_of, none, tmp_path):
    path = f"file://{tmp_path}/i"
    assert exact_dedup.dedup_batch(spark, none, path, buckets=4).count() == 0
    first = exact_dedup.dedup_batch(spark, docs_of([(5, "a b"), (6, "c")]), path, buckets=4)
    assert first.where("kept").count() == 2
    second = {r.doc_id: r for r in exact_dedup.dedup_batch(spark, docs_of([(1, "a  b"), (2, "d"), (3, "d")]), path, buckets=4).collect()}
    assert not second[1].kept and second[1].keep_id == 5
    assert second[2].kept and not second[3].kept and second[3].keep_id == 2
    again = exact_dedup.dedup_batch(spark, docs_of([(2, "d")]), path, buckets=4).collect()
    assert not again[0].kept and again[0].keep_id == 2
    # the same index with other buckets, each in one file
    assert exact_dedup.compact(spark, path, rows=1, least=1) == 3
    later = {r.doc_id: r for r in exact_dedup.dedup_batch(spark, docs_of([(9, "a b"), (10, "e")]), path).collect()}
    assert not later[9].kept and later[9].keep_id == 5 and later[10].kept


def test_a_batch_runs_again_after_a_crash(spark, docs_of, tmp_path, monkeypatch):
    """Its digests were appended, its result was not written."""
    path, rows = f"file://{tmp_path}/i", docs_of([(1, "a"), (2, "b"), (3, "b"), (4, "c")])
    exact_dedup.dedup_batch(spark, docs_of([(0, "c")]), path, "earlier", 4)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "attach", lost)
        try:
            exact_dedup.dedup_batch(spark, rows, path, "today", 4)
        except OSError:
            pass
    for _ in range(2):
        got = {r.doc_id: (r.kept, r.keep_id) for r in exact_dedup.dedup_batch(spark, rows, path, "today", 4).collect()}
        assert got == {1: (True, 1), 2: (True, 2), 3: (False, 2), 4: (False, 0)}
    assert sorted(r.doc_id for r in exact_dedup.keep_first(spark, rows, path, "today").collect()) == [1, 2]
    assert exact_dedup.keep_first(spark, rows, path, "tomorrow").count() == 0


def test_compact_that_broke_off(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/k"
    rows = docs_of([(1, "a"), (2, "b"), (3, "c")])
    exact_dedup.dedup_batch(spark, rows, path, "one", 4).collect()
    exact_dedup.compact(spark, path, rows=1, least=1)
    (tmp_path / "k" / "generation-1-3" / "_SUCCESS").unlink()  # as if it had ended before
    assert exact_dedup._generations(spark, path) == [(0, 4)]
    assert exact_dedup.compact(spark, path, rows=1, least=1) == 3
    assert exact_dedup._generations(spark, path)[-1] == (2, 3)
    got = {r.doc_id: r.kept for r in exact_dedup.dedup_batch(spark, docs_of([(3, "c"), (4, "d")]), path, "two", 4).collect()}
    assert got == {3: False, 4: True}


def test_an_index_with_a_text_twice_gives_each_row_once(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/k"
    exact_dedup.dedup_batch(spark, docs_of([(1, "a"), (2, "b")]), path, "one", 4).collect()
    index, buckets = exact_dedup.open_index(spark, path, 4)
    exact_dedup._append(spark.createDataFrame(spark.table(index).collect(), "text_sha256 string, keep_id long, batch string"), index, buckets)
    rows = exact_dedup.dedup_batch(spark, docs_of([(3, "a")]), path, "two", 4).collect()
    assert [(r.doc_id, r.keep_id, r.kept) for r in rows] == [(3, 1, False)]


def test_keep_first_of_repeated_and_null_ids(spark, docs_of, tmp_path):
    rows = docs_of([(1, "a b"), (1, "a b"), (1, "a  b"), (None, "n"), (None, "n"), (2, None), (3, "")])
    kept = exact_dedup.keep_first(spark, rows, f"file://{tmp_path}/k")
    assert kept.count() == 3 and [r.doc_id for r in kept.where("doc_id IS NULL").collect()] == [None]


def test_keep_first_keeps_columns(spark, odd, tmp_path):
    kept = exact_dedup.keep_first(spark, odd, f"file://{tmp_path}/k")
    assert kept.columns == odd.columns
    assert sorted(sha(r.text) for r in kept.collect()) == sorted({sha(r.text) for r in odd.collect()})


def check_shards(rows, shards, texts=None):
    n = len(rows)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(shards))
    assert all(n // shards <= sizes.get(s, 0) <= -(-n // shards) for s in range(shards))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards_are_even_and_keep_copies_together(spark):
    rows = sharding.op9_sharding(spark, DATA).collect()
    check_shards(rows, 40)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    places = {}
    for r in rows:
        places.setdefault(texts[r.doc_id], []).append(r.shard)
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.law == "rows" and r.grown_shard is None
    assert all(len(set(p)) == 1 for p in places.values() if len(p) <= len(rows) // 40)


def test_a_third_in_one_group(spark, docs_of):
    rows = sharding.shard_by_labels(docs_of([(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(900)]), 10).collect()
    check_shards(rows, 10)
    assert len({r.shard for r in rows if r.doc_id % 3 == 0}) <= 6  # 300 rows, 90 to a shard: 4 could hold them, if no other text had copies there


def brute_cuts(rows, text_of, quota):
    """Texts of several rows, those in more shards than need be, links, links across shards."""
    places = {}
    for r in rows:
        places.setdefault(text_of[r.doc_id], []).append(r.shard)
    own = [p for p in places.values() if len(p) > 1]
    pairs = [(a, b) for p in own for i, a in enumerate(p) for b in p[:i]]
    return len(own), sum(len(set(p)) > -(-len(p) // quota) for p in own), len(pairs), sum(a != b for a, b in pairs)


@pytest.mark.parametrize(("texts", "each", "shards"), [(2000, 3, 40), (290, 4, 7), (150, 7, 12)])
def test_copies_that_fill_the_table(docs_of, texts, each, shards):
    """No row is unlinked: none of the triples need be cut, of others fewer than shards."""
    text_of = {i: f"t{i % texts}" for i in range(texts * each)}
    report = []
    rows = sharding.shard_by_labels(docs_of([*text_of.items()]), shards, report).collect()
    check_shards(rows, shards)
    quota = len(rows) // shards
    before, after = report
    assert tuple(after) == brute_cuts(rows, text_of, quota)
    assert after.cut == 0 if quota % each == 0 and len(rows) % shards == 0 else after.cut < shards
    assert before.cut > 0.8 * texts and after.cut_links < before.cut_links / 10


def test_what_no_shard_holds_whole_is_cut(spark):
    loose = spark.createDataFrame([(f"g{i}", 5) for i in range(6)], "g string, total long")
    got = sharding._laid_out(loose, [6, 6, 6, 6, 6], 4).collect()
    assert sum(r.n for r in got) == 30 and all(sum(r.n for r in got if r.shard == s) <= 6 for s in range(5))
    assert sum(len([r for r in got if r.g == f"g{i}"]) > 1 for i in range(6)) == 1


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_by_labels(odd, 5).collect()
    assert len(rows) == odd.count()
    check_shards(rows, 5)
    check_shards(sharding.shard_by_labels(odd, 40).collect(), 40)
    assert sharding.shard_by_labels(none, 5).count() == 0


def test_admission_keeps_quotas():
    share = sharding.admitted([10, 10, 0], [10, 10, 10], {(0, 1): 5, (1, 0): 3, (0, 2): 20})
    assert share[2] == 0.5 and share[0] == 1.0 and abs(share[1] - 0.6) < 1e-9  # shard 1 has room for the three that leave it
