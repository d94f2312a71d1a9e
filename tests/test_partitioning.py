import math

import pytest

from emrecon.operators import partitioning as P
from emrecon.operators import transpose as T


@pytest.fixture(scope="module")
def lengths(spark):
    counts = [3, 0, 2, 5, 1, 1, 0, 4, 2, 6, 1, 0]
    return counts, spark.createDataFrame(list(enumerate(counts)), "r long, cnt long")


@pytest.mark.parametrize("rule", ["left", "right", "start"])
@pytest.mark.parametrize("parts", [1, 3, 5, 20])
def test_rules(lengths, rule, parts):
    counts, df = lengths
    got = {r["r"]: r["pid"] for r in P.by_rule(df, parts, rule).collect()}
    nnz, before = sum(counts), 0
    for r, n in enumerate(counts):
        want = {"left": math.ceil(before * parts / nnz) - 1, "right": math.ceil((before + n) * parts / nnz) - 1, "start": math.floor(before * parts / nnz)}[rule]
        assert got[r] == min(max(want, 0), parts - 1)
        before += n
    assert [got[r] for r in range(len(counts))] == sorted(got.values())


def test_running_sum_across_blocks(lengths, monkeypatch):
    counts, df = lengths
    monkeypatch.setattr(P, "BLOCK", 4)
    got = {r["r"]: r["running"] for r in P.running(df, "r", "cnt", base=5).collect()}
    assert [got[r] for r in range(12)] == [5 + sum(counts[: r + 1]) for r in range(12)]
    got = {r["r"]: r["running"] for r in P.running(df, "r", "cnt", inclusive=False).collect()}
    assert [got[r] for r in range(12)] == [sum(counts[:r]) for r in range(12)]


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_slices_cover_each_element_once(lengths, parts):
    counts, df = lengths
    seen = [(s["r"], e) for s in P.element_slices(df, parts).collect() for e in range(s["from"], s["to"])]
    assert sorted(seen) == [(r, e) for r, n in enumerate(counts) for e in range(n)]


def test_two_level_and_shrink(lengths):
    counts, df = lengths
    rows = P.two_level(df, 3, 2).collect()
    assert {r["tid"] for r in rows} <= {0, 1} and len(rows) == 12
    left = P.shrink(P.by_rule(df, 4, "left"), lambda p: p % 2 == 0).collect()
    assert {r["pid"] for r in left} == {0, 1} and sum(r["cnt"] for r in left) == sum(counts)


def test_transpose_twice_and_packing(spark):
    a = spark.createDataFrame([(0, 2, 1.0), (0, 1, 2.0), (2, 2, 3.0)], "r long, c long, v double")
    assert sorted(T.transpose(T.transpose(a)).collect()) == sorted(a.collect())
    packed = T.csr_arrays(a, spark.range(3).withColumnRenamed("id", "r")).orderBy("r").collect()
    assert [tuple(r) for r in packed] == [(0, 0, [1, 2], [2.0, 1.0]), (1, 2, [], []), (2, 2, [2], [3.0])]
