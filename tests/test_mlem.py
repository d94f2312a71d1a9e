import numpy as np
import pytest

from emrecon.operators import checkpoints, fused, mlem, transpose


@pytest.fixture(scope="module")
def case(spark):
    """The 4 x 4 case: row 2 and column 3 are empty."""
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 2.0), (3, 0, 1.0), (3, 2, 1.0), (3, 2, 3.0)], "r long, c long, v double")
    y = spark.createDataFrame([(0, 3), (1, 4), (2, 7), (3, 10)], "r long, y int")
    return a, y, spark.range(4).withColumnRenamed("id", "c")


def values(df, key, name):
    return [r[name] for r in df.orderBy(key).collect()]


def test_golden(case):
    a, y, cols = case
    norm = mlem.column_sums(a, cols)
    assert values(norm, "c", "n") == [2, 3, 4, 0]
    x0 = mlem.start_image(norm, y)
    assert values(x0, "c", "x") == pytest.approx([24 / 9] * 4)
    fw = mlem.forward(a, x0)
    assert {r["r"]: r["fw"] for r in fw.collect()} == pytest.approx({0: 16 / 3, 1: 16 / 3, 3: 40 / 3})
    k = mlem.correlation(y, fw)
    assert values(k, "r", "k") == pytest.approx([0.5625, 0.75, 0, 0.75])
    x1 = mlem.step(a, y, x0, norm)
    assert values(x1, "c", "x") == pytest.approx([1.75, 11 / 6, 2.0, 0])
    assert mlem.image_sum(x1).first()[0] == pytest.approx(1.75 + 11 / 6 + 2)


def test_strategies_agree_and_keep_the_sum(case, spark):
    a, y, cols = case
    one = values(mlem.mlem(a, y, cols, 4), "c", "x")
    assert values(fused.mlem_fused(a, y, cols, 4), "c", "x") == pytest.approx(one, rel=1e-9)
    assert values(mlem.mlem(a, y, cols, 4, by_column=transpose.laid_out(a, 3, "c", "r")), "c", "x") == pytest.approx(one, rel=1e-9)
    assert np.dot(one, [2, 3, 4, 0]) == pytest.approx(3 + 4 + 10)


def test_shuffled_joins_agree(case, monkeypatch):
    a, y, cols = case
    one = values(mlem.mlem(a, y, cols, 2), "c", "x")
    monkeypatch.setattr(mlem, "VECTOR_ROWS", 0)
    assert values(mlem.mlem(a, y, cols, 2), "c", "x") == pytest.approx(one, rel=1e-12)


def test_no_iterations_and_errors(case, spark):
    a, y, cols = case
    assert values(mlem.mlem(a, y, cols, 0), "c", "x") == pytest.approx([24 / 9] * 4)
    with pytest.raises(ValueError):
        mlem.mlem(a, y, cols, -1)
    with pytest.raises(ValueError):
        mlem.mlem(a, y, cols, 1, image=spark.createDataFrame([(0, 1.0)], "c long, x double"))


def test_adjoint(case, spark):
    a, _, cols = case
    x = cols.selectExpr("c", "c + 1.5D AS x")
    k = spark.range(4).selectExpr("id AS r", "2D * id + 1 AS k")
    left = sum(r["fw"] * (2 * r["r"] + 1) for r in mlem.forward(a, x).collect())
    right = sum(r["u"] * (r["c"] + 1.5) for r in mlem.backward(a, k).collect())
    assert left == pytest.approx(right)


def test_resume(case, spark, tmp_path):
    a, y, cols = case
    path = f"file://{tmp_path}/states"
    whole = values(mlem.mlem(a, y, cols, 5), "c", "x")
    checkpoints.run(a, y, cols, 3, path, every=2, finish=False)
    assert checkpoints.saved(spark, path) == [2]
    image, metrics = checkpoints.run(a, y, cols, 5, path, every=2, resume=True)
    assert values(image, "c", "x") == pytest.approx(whole, rel=1e-12)
    assert [r["iter"] for r in metrics.collect()] == [3, 4, 5]
    assert checkpoints.saved(spark, path) == []
    checkpoints.run(a, y, cols, 2, path, every=1, finish=False)
    with pytest.raises(ValueError):
        checkpoints.run(a, y.selectExpr("r", "y + 1 AS y"), cols, 3, path, resume=True)


def test_fingerprint_knows_repeats_and_no_order(spark):
    from emrecon.operators.checkpoints import fingerprint

    y = spark.range(9).selectExpr("id AS r", "3 AS y")
    a = spark.range(900).selectExpr("id % 9 AS r", "id AS c", "cast(1 / (id + 3) AS double) AS v")
    marks = {fingerprint(a.repartition(n), y.repartition(n)) for n in (1, 3, 7)}
    assert len(marks) == 1
    twice = a.unionByName(a.limit(1)).unionByName(a.limit(1))
    assert fingerprint(twice, y) not in marks and fingerprint(a.where("false"), y) not in marks


def test_conservation(case):
    a, y, cols = case
    norm = mlem.column_sums(a, cols)
    x0 = mlem.start_image(norm, y)
    got = mlem.conservation(y, norm, mlem.forward(a, x0), mlem.step(a, y, x0, norm)).first()
    assert tuple(got) == pytest.approx((17, 17))


@pytest.mark.parametrize("keys", [[0, 1, 2], [0, 1, 2, 2], [1, 2, 3, 4], [0, 1, 2, 3, 4], []])
def test_counts_of_another_length_are_errors(case, spark, keys):
    assert mlem.require_counts(case[1], 4) is case[1]
    with pytest.raises(ValueError):
        mlem.require_counts(spark.createDataFrame([(k, 1) for k in keys], "r long, y int"), 4)


def test_rows_too_long_to_pack_are_errors(case, monkeypatch):
    monkeypatch.setattr(transpose, "MOST_IN_ROW", 2)
    with pytest.raises(ValueError):
        transpose.csr_arrays(case[0], case[1])


def test_layout_splits_a_long_row(spark):
    a = spark.range(0, 3_000_000, 1000).selectExpr("0L AS r", "id AS c", "1.0 AS v").union(spark.range(9).selectExpr("1 + id AS r", "id AS c", "2.0 AS v"))
    at = transpose.laid_out(a, 8, "r", "c").selectExpr("r", "spark_partition_id() AS part").distinct().groupBy("r").count().collect()
    assert {x["count"] for x in at if x["r"]} == {1}  # short rows lie together
    assert [x["count"] for x in at if not x["r"]][0] > 1
    assert transpose.written(a, "r", "c").count() == a.count()
