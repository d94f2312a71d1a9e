"""Chosen-path near-dedup against brute force, its recall and its groups."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.test_jaccard import brute, corpus, result
from tests.support import DATA, same

from emrecon.llm import chosen_path as C


def test_all_documents(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = C.op13_minhash_near_dedup(spark, DATA)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = found.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    same(found.toPandas(), duck.sql(C.ORACLE).df())


def test_recall_on_more_documents(spark, tmp_path):
    """The components equal those of the exact join, of which SQL gives the rows."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    same(C.op13_minhash_near_dedup(spark, sf).toPandas(), c.sql(C.ORACLE).df())


@pytest.mark.parametrize(("k", "t", "limit", "block"), [(2, 80, 64, 256), (2, 80, 2, 8), (3, 70, 4, 16)])
def test_random_corpora(docs_of, monkeypatch, k, t, limit, block):
    """With small limits nodes branch, are dealt to blocks and meet their pivots."""
    monkeypatch.setattr(C, "LIMIT", limit)
    monkeypatch.setattr(C, "BLOCK", block)
    rows = corpus(k * t)
    assert result(C.near_duplicates(docs_of(rows), k, t, 0.999999)) == brute(rows, k, t)


def test_a_large_group_of_near_copies(docs_of):
    """A third of all rows copies of one text, a third near copies of another, one passage in all."""
    rng = random.Random(1)
    base, passage = [f"b{i}" for i in range(60)], " ".join(f"p{i}" for i in range(12))
    rows = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, ["same text again and again", " ".join(words), " ".join(f"u{rng.randrange(4000)}" for _ in range(40)) + " " + passage][i % 3]))
    got = result(C.near_duplicates(docs_of(rows), 2, 80))
    assert {c for i, (_, c) in got.items() if i % 3 == 0} == {0} and {c for i, (_, c) in got.items() if i % 3 == 1} == {1}
    assert all(c == i for i, (_, c) in got.items() if i % 3 == 2)


def test_tokens_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        off = []
        for _ in range(30):
            union = rng.integers(0, 2**64, 1500, np.uint64)
            both, rest = union[: int(1500 * share)], union[int(1500 * share) :]
            a, b = C.tokens(np.r_[both, rest[::2]]), C.tokens(np.r_[both, rest[1::2]])
            off.append((a == b).mean() - share)
        assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.07
    assert (C.tokens(np.arange(5000, dtype=np.uint64)) == np.minimum(C.tokens(np.arange(2000, dtype=np.uint64)), C.tokens(np.arange(2000, 5000, dtype=np.uint64)))).all()


def test_trees_meet_pairs_at_the_limit(spark):
    """How often trees bring a pair at the limit together at the depth that they are counted for."""
    assert C.trees_for(0.9999, 80) * np.log(C.missed(80, C.DEEP)) <= np.log(1e-4)
    assert C.missed(80, 1) == pytest.approx(0.04) and C.trees_for(0.9, 100) == 1
    rng = random.Random(4)
    rows = []
    for pair in range(300):
        a = rng.randbytes(2 * C.TOKENS)
        same = [rng.random() < 0.8 for _ in range(C.TOKENS)] * 2
        b = bytes(x if s else x ^ 77 for x, s in zip(a, same, strict=True))
        rows += [(2 * pair, bytearray(a)), (2 * pair + 1, bytearray(b))]
    reps = spark.createDataFrame(rows, "rid long, mins binary").cache()
    assert C.roots(reps, range(3), 80, 1).count() == 600 * 3 * C.ROOT
    live = C.roots(reps, range(1), 80).cache()
    for depth in range(C.START, C.START + 3):
        met = live.groupBy("node").agg(F.collect_set("rid").alias("r")).where(F.size("r") == 2).select(F.floor(F.col("r")[0] / 2).alias("pair")).distinct().count()
        assert abs(met / 300 - (1 - C.missed(80, depth))) < 0.12
        live = C.grown(live, reps, 80).cache()


@pytest.mark.parametrize("strays", [3, 20])
def test_strays_meet_all_of_their_node(spark, monkeypatch, strays):
    monkeypatch.setattr(C, "LIMIT", 8)
    monkeypatch.setattr(C, "BLOCK", 16)
    rows = spark.createDataFrame([(7, i, i if i < strays else 99, 99, 100, strays) for i in range(100)], "node long, rid long, comp long, main long, size long, strays long")
    groups = {}
    for r in C.ended(rows).collect():
        groups.setdefault(r.g, set()).add(r.rid)
    met = {(i, j) for g in groups.values() for i in g for j in g}
    assert all((i, j) in met for i in range(strays) for j in range(100))
    assert max(map(len, groups.values())) <= 60
    blocks = {}
    for r in C.dealt(rows).collect():
        blocks.setdefault(r.g, set()).add(r.rid)
    assert set.union(*blocks.values()) == set(range(100)) and len(set.intersection(*blocks.values())) >= 1


def test_groups_are_whole_across_batches():
    g = np.sort(np.random.default_rng(0).integers(0, 40, 300))
    batches = [pa.record_batch({"g": g[a : a + 7]}) for a in range(0, 300, 7)]
    tables = [t.column("g").to_pylist() for t in C.whole_groups(iter(batches))]
    assert [x for t in tables for x in t] == g.tolist()
    assert all(not set(a) & set(b) for k, a in enumerate(tables) for b in tables[k + 1 :])
    assert list(C.whole_groups(iter([pa.record_batch({"g": g[:0]})]))) == []


def test_odd_rows(odd, none):
    rows = sorted(C.near_duplicates(odd, 2, 80).collect(), key=str)
    own = {str(r.doc_id): r for r in rows}
    assert len(rows) == odd.count() and own["8"].component_id == 6 and own["None"].component_id is None and own["None"].kept
    assert [own[i].n_shingles for i in "1234"] == [0, 0, 0, 1] and all(own[i].component_id == int(i) for i in "1234")
    assert own["10"].component_id == own["11"].component_id == 7
    assert C.near_duplicates(none, 2, 80).collect() == []


def test_rows_without_ids_are_linear(docs_of):
    base = [f"w{i}" for i in range(50)]
    rows = [(None, " ".join([*base[:k % 50], f"z{k}", *base[k % 50 + 1 :]])) for k in range(120)] + [(None, "one text")] * 50
    got = C.near_duplicates(docs_of([*rows, (5, " ".join(base))]), 2, 80).collect()
    assert len(got) == 171 and sum(r.component_id == 5 for r in got) == 121
    sets = C.sketched(docs_of(rows), 2).cache()
    reps = sets.dropDuplicates(["dig"]).cache()
    assert C.full_sets(docs_of(rows), reps.select("rid"), reps, 2).count() <= 121 + 4


def test_no_level_moves_the_tokens_of_all(spark, docs_of):
    """Only groups and nodes are exchanged by rid; full sets go from the texts to their groups."""
    docs = docs_of(corpus(5))
    sets = C.sketched(docs, 2).cache()
    reps = C.representatives(sets, sets.where("n > 0").groupBy("dig").agg(F.min("rid").alias("node")), 10)
    groups = reps.selectExpr("rid % 7 AS g", "rid", "rid AS comp").unionByName(reps.selectExpr("rid % 5 + 100 AS g", "rid", "rid AS comp")).cache()
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = C.sent(groups, docs, reps, 2)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (C.compared(groups, reps, 80), C.grown(groups.selectExpr("g AS node", "rid"), reps, 80), rows.repartition("g"))]
        assert {(r.g, r.rid) for r in rows.collect()} == {(r.g, r.rid) for r in groups.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [p.count("Exchange hashpartitioning(rid") for p in plans[:2]] == [1, 1]
    # the sets' plan reads the written keys of the members, so their one exchange is by g
    assert [plans[2].count(f"Exchange hashpartitioning({k}") for k in ("rid", "g")] == [0, 1]


def test_overlapping_groups_are_sent_once(spark, docs_of, monkeypatch):
    rows = [(g, rid, 100 + rid) for g, members in ((1, (1, 2)), (2, (2, 3)), (3, (1, 3)), (4, (9, 10)), (5, (4, 5)), (6, (5, 6, 7))) for rid in members]
    groups = spark.createDataFrame(rows, "g long, rid long, comp long")
    monkeypatch.setattr(C, "LIMIT", 3)
    got = C.overlapping(groups).collect()
    assert len(got) == 3 + 2 + 5 and all(r.comp == 100 + r.rid for r in got)
    named = {frozenset(r.rid for r in got if r.g == g) for g in {r.g for r in got}}
    assert named == {frozenset(m) for m in ((1, 2, 3), (9, 10), (4, 5), (5, 6, 7))}  # the last two would be four together
    monkeypatch.setattr(C, "OFTEN", 0)
    monkeypatch.setattr(C, "LIMIT", 16)
    rows = corpus(31)
    assert result(C.near_duplicates(docs_of(rows), 2, 80, 0.999999)) == brute(rows, 2, 80)
