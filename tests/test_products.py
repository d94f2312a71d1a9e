"""Co-partitioned and tiled products against the plain ones, and their plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emrecon.operators import checkpoints, copartitioned, fused, mlem, tiles, transpose
from emrecon.sources.scratch import bucketed


@pytest.fixture(scope="module")
def small(spark):
    """A third of all elements in row 5 and in column 7, repeated cells, empty rows and columns."""
    rng = np.random.default_rng(3)
    cells = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 90, 900), rng.integers(0, 70, 900), rng.integers(1, 5, 900), strict=True) if r % 11 and c % 13]
    cells += [(5, int(c), 1.0) for c in rng.integers(0, 70, 300)] + [(int(r), 7, 2.0) for r in rng.integers(0, 90, 300)]
    a = spark.createDataFrame(cells, "r long, c long, v double").cache()
    y = spark.range(90).selectExpr("id AS r", "cast(id % 9 AS int) AS y").cache()
    return a, y, spark.range(70).selectExpr("id AS c").cache()


def values(df):
    return {r.c: r.x for r in df.collect()}


def close(got, want):
    assert set(got) == set(want) and np.allclose([got[k] for k in want], [*want.values()], rtol=1e-9)


@pytest.mark.parametrize("most", [None, 100])
def test_copartitioned(small, most):
    close(values(copartitioned.mlem_copartitioned(*small, 3, buckets=4, most=most)), values(mlem.mlem(*small, 3)))
    assert copartitioned.copy_by(small[0], "r", "c", 4, 100).long_keys.count() >= 1
    close(values(copartitioned.mlem_copartitioned(*small, 0, buckets=4)), values(mlem.mlem(*small, 0)))


def exchanged(df) -> list[str]:
    """What stands below each exchange of the plan: the first node that is no column step."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    out = []
    for k, line in enumerate(lines):
        if re.search(r"\bExchange\b", line):
            below = (re.sub(r"^[\s:+\-*()\d]*", "", x) for x in lines[k + 1 :])
            out.append(next(x for x in below if x and not re.match("Project|Filter|Sort |ColumnarToRow|WholeStage|InputAdapter", x)))
    return out


@pytest.mark.parametrize("most", [None, 100])
def test_the_matrix_is_not_exchanged(spark, small, most, monkeypatch):
    monkeypatch.setattr(mlem, "VECTOR_ROWS", 0)
    a, y, columns = small
    by_row, by_column = (copartitioned.copy_by(a, k, o, 8, most) for k, o in (("r", "c"), ("c", "r")))
    image = bucketed(columns.select("c", F.lit(1.0).alias("x")), "c", 8)
    cor = bucketed(y.select("r", F.lit(1.0).alias("k")), "r", 8)
    for df in (copartitioned.forward(by_column, image), copartitioned.backward(by_row, cor)):
        below = exchanged(df)
        assert below and all(re.match(r"HashAggregate\(.*partial_sum", x) for x in below), below


@pytest.mark.parametrize("most", [None, 100])
def test_sums_before_the_loop_do_not_exchange_elements(small, most):
    a, _, columns = small
    by_column = copartitioned.copy_by(a, "c", "r", 8, most)
    sums = copartitioned.column_sums(by_column, columns)
    # the long elements lie dealt, and each task sums them up before the exchange
    assert all(re.match(r"HashAggregate\(.*partial_sum", x) for x in exchanged(sums)) and len(exchanged(sums)) == (0 if most is None else 1)
    assert {r.c: r.n for r in sums.collect()} == {r.c: r.n for r in mlem.column_sums(a, columns).collect()}


@pytest.mark.parametrize("slots", [1, 3, 1000])
def test_long_keys(small, slots):
    a = small[0]
    for key in "rc":
        counts = {x[key]: x["count"] for x in a.groupBy(key).count().collect()}
        for most in (0, 12, 100, 10_000):
            found = copartitioned.long_keys(a, key, most, slots)
            assert sorted([] if found is None else (x[key] for x in found.collect())) == sorted(k for k, n in counts.items() if n > most)


@pytest.mark.parametrize(("edge", "record"), [(16, 40), (1 << 10, 1 << 20), (7, 1)])
def test_tiles(spark, small, edge, record):
    a, y, columns = small
    close(values(tiles.mlem_tiled(a, y, columns, 2, edge, record)), values(mlem.mlem(a, y, columns, 2)))
    got = tiles.tiled(a, edge, record)
    sizes = [len(r.values) for r in got.collect()]
    assert sum(sizes) == a.count()
    if record == 40:
        assert max(sizes) < 4 * record and len(sizes) > -(-a.count() // 80)
        assert got.where("array_max(rows) >= 16 OR array_max(columns) >= 16").isEmpty()


def test_nothing_to_multiply(spark, small):
    none = small[0].where("false")
    close(values(tiles.mlem_tiled(none, small[1], small[2], 1)), values(mlem.mlem(none, small[1], small[2], 1)))
    close(values(copartitioned.mlem_copartitioned(none, small[1], small[2], 1)), values(mlem.mlem(none, small[1], small[2], 1)))
    for form in (tiles.mlem_tiled, copartitioned.mlem_copartitioned):
        with pytest.raises(ValueError):
            form(*small, -1)


@pytest.mark.parametrize("chunk", [1, 16, 1 << 16])
def test_fused_over_chunks(small, monkeypatch, chunk):
    monkeypatch.setattr(mlem, "VECTOR_ROWS", 0)  # bounds nothing here
    a, y, columns = small
    close(values(fused.mlem_fused(a, y, columns, 3, chunk)), values(mlem.mlem(a, y, columns, 3)))
    close(values(fused.mlem_fused(a, y, columns, 0, chunk)), values(mlem.mlem(a, y, columns, 0)))


def test_fused_without_elements_or_columns(spark, small):
    a, y, columns = small
    none = a.where("false")
    close(values(fused.mlem_fused(none, y, columns, 2, 16)), dict.fromkeys(range(70), 0.0))
    assert fused.mlem_fused(none, y, columns.where("false"), 1).collect() == []
    for bad in (columns.selectExpr("c + 1 AS c"), columns.where("c <> 3")):
        with pytest.raises(ValueError):
            fused.mlem_fused(none, y, bad, 1)


def test_only_touched_chunks_are_loaded(spark, tmp_path):
    image = spark.createDataFrame([(k, [float(4 * k + i) for i in range(4 if k < 9 else 2)]) for k in range(10)], "k long, x array<double>")
    image.write.parquet(f"file://{tmp_path}/x")
    chunks = fused.Chunks(spark.read.parquet(f"file://{tmp_path}/x").inputFiles(), 4)
    assert chunks.entries(np.array([5, 37, 4])).tolist() == [5.0, 37.0, 4.0] and set(chunks.loaded) == {1, 9}
    assert chunks.entries(np.array([36, 0])).tolist() == [36.0, 0.0] and set(chunks.loaded) == {0, 1, 9}


def test_metrics_without_jobs_of_their_own(spark, small):
    a, y, columns = small
    rows, sums = [], []
    image = mlem.mlem(a, y, columns, 3, after=lambda i, x: sums.append(mlem.image_sum(x).first()[0]), metrics=rows)
    assert [r["iter"] for r in rows] == [1, 2, 3] and np.allclose([r["image_sum"] for r in rows], sums)
    assert all(r["forward"] > 0 < r["backward"] and abs(r["elapsed"] - r["forward"] - r["backward"]) < 1e-6 for r in rows)
    close(values(image), values(mlem.mlem(a, y, columns, 3)))
    _, metrics = checkpoints.run(a, y, columns, 2, f"{spark.conf.get('spark.checkpoint.dir')}/metrics", every=0)
    assert metrics.columns == ["iter", "elapsed", "forward", "backward", "image_sum"] and metrics.count() == 2


@pytest.mark.parametrize("in_block", [1, 150, 1 << 20])
def test_packed_transposition(spark, small, in_block):
    a, y, columns = small
    packed = transpose.csr_arrays(a, y).cache()
    rows = lambda df: sorted((r.c, r.start, r.rows, r.values) for r in df.collect())
    assert rows(transpose.transpose_packed(packed, columns, in_block)) == rows(transpose.csc_arrays(a, columns))
    parts = transpose.fragments(packed, [0, 20, 40]).collect()
    assert len(parts) <= 3 * 8 and sum(len(r.rows) for r in parts) == a.count()  # no row for each element
    none = transpose.csr_arrays(a.where("false"), y)
    assert rows(transpose.transpose_packed(none, columns)) == [(c, 0, [], []) for c in range(70)]


def test_thin_matrix_needs_few_records_and_entries(spark):
    """Tiles of a thin matrix are wide: neither records times segments nor entries asked for
    outgrow the elements, and the records are not exchanged."""
    rng = np.random.default_rng(5)
    cells = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 6000, 5000), rng.integers(0, 3000, 5000), rng.integers(1, 5, 5000), strict=True)]
    a = spark.createDataFrame(cells, "r long, c long, v double").cache()
    y, columns = spark.range(6000).selectExpr("id AS r", "cast(id % 9 AS int) AS y"), spark.range(3000).selectExpr("id AS c")
    own = tiles.tiled(a, 64, 64)
    assert own.count() * 64 <= 4 * a.count()
    laid = tiles.laid_out(a, 64, 64)
    assert laid.needs.selectExpr("sum(size(places))").first()[0] <= a.count()
    image = columns.select("c", F.lit(1.0).alias("x"))
    assert sum("parquet" in x for x in exchanged(tiles.forward(laid, image))) == 0
    close(values(tiles.mlem_tiled(a, y, columns, 2, 64, 64)), values(mlem.mlem(a, y, columns, 2)))


def test_hot_segments_answer_in_parts(spark, small, monkeypatch):
    monkeypatch.setattr(tiles, "ASKED", 8)
    a, y, columns = small
    assert tiles.laid_out(a, 16, 40).hot.count() >= 1
    close(values(tiles.mlem_tiled(a, y, columns, 2, 16, 40)), values(mlem.mlem(a, y, columns, 2)))
