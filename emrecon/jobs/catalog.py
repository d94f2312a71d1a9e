"""Queries on the given tables and the DuckDB SQL that they are held against.

Matrix: order lines (order, part, quantity); counts: order prices in thousands; further
matrices: suppliers by parts, whose rows are long, and embeddings, which are dense."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.functions import geometry as G
from emrecon.operators import checkpoints, copartitioned, fused, mlem, partitioning, tiles, transpose
from emrecon.sources import csr4
from emrecon.sources.scratch import cut, new_path

#: Iterations of the reconstruction queries, parts of the partition queries.
ITERATIONS, PARTS = 3, 7
#: Rows and columns of a tile, small enough that the given tables have several.
EDGE = 1 << 13


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("r"), F.col("l_partkey").alias("c"), F.col("l_quantity").alias("v"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("r"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("y"))


def columns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("c"))


def _all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return matrix(spark, d), counts(spark, d), columns(spark, d)


def _start(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    a, y, c = _all(spark, d)
    norm = mlem.column_sums(a, c)
    return a, y, norm, mlem.start_image(norm, y)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def q_mlem(spark, d):
    return _rounded(mlem.mlem(*_all(spark, d), ITERATIONS), "x")


def q_mlem_fused(spark, d):
    return _rounded(fused.mlem_fused(*_all(spark, d), ITERATIONS), "x")


def q_mlem_by_column(spark, d):
    a, y, c = _all(spark, d)
    copy = transpose.written(a, "c", "r")
    return _rounded(mlem.mlem(a, y, c, ITERATIONS, by_column=copy), "x")


def q_mlem_blocked(spark, d):
    a, y, c = _all(spark, d)
    n = c.count()
    tiled = a.withColumn("block", partitioning.column_block(F.col("c"), n, 4))
    tiled = cut(tiled.repartitionByRange(8, "r").sortWithinPartitions("block", "r"), "tiled")
    return _rounded(mlem.mlem(tiled.drop("block"), y, c, ITERATIONS, copy=False), "x")


def q_mlem_copartitioned(spark, d):
    """Bucketed copies by row and column; no vector is broadcast."""
    return _rounded(copartitioned.mlem_copartitioned(*_all(spark, d), ITERATIONS), "x")


def q_mlem_tiled(spark, d):
    """Tiles of EDGE rows and columns, met by segments of the vectors."""
    return _rounded(tiles.mlem_tiled(*_all(spark, d), ITERATIONS, edge=EDGE, in_record=1 << 14), "x")


def q_mlem_resumed(spark, d):
    """Two iterations, then a restart from the saved state for the rest."""
    a, y, c = _all(spark, d)
    path = new_path(spark, "states")
    checkpoints.run(a, y, c, 2, path, every=1, finish=False)
    return _rounded(checkpoints.run(a, y, c, ITERATIONS, path, every=1, resume=True)[0], "x")


def q_iteration_sums(spark, d):
    """The progress figures of each iteration, without its times."""
    a, y, c = _all(spark, d)
    _, metrics = checkpoints.run(a, y, c, ITERATIONS, new_path(spark, "states"), every=0)
    return _rounded(metrics.select("iter", "image_sum"), "image_sum", digits=4)


def q_column_sums(spark, d):
    return mlem.column_sums(matrix(spark, d), columns(spark, d))


def q_start_image(spark, d):
    return _rounded(_start(spark, d)[3], "x")


def q_forward(spark, d):
    a, y, norm, x = _start(spark, d)
    fw = y.select("r").join(mlem.forward(a, x), "r", "left").select("r", F.coalesce("fw", F.lit(0.0)).alias("fw"))
    return _rounded(fw, "fw")


def q_correlation(spark, d):
    a, y, norm, x = _start(spark, d)
    return _rounded(mlem.correlation(y, mlem.forward(a, x)), "k")


def q_backward(spark, d):
    a, y, norm, x = _start(spark, d)
    return _rounded(mlem.backward(a, mlem.correlation(y, mlem.forward(a, x))), "u")


def q_update(spark, d):
    a, y, norm, x = _start(spark, d)
    return _rounded(mlem.step(a, y, x, norm), "x")


def q_image_sum(spark, d):
    a, y, norm, x = _start(spark, d)
    return _rounded(mlem.image_sum(mlem.step(a, y, x, norm)), "image_sum", digits=4)


def q_conservation(spark, d):
    """What an update keeps: the weighted image against the counts that it met."""
    a, y, norm, x = _start(spark, d)
    fw = mlem.forward(a, x)
    image = mlem.update(x, mlem.backward(a, mlem.correlation(y, fw)), norm)
    return _rounded(mlem.conservation(y, norm, fw, image), "weighted", "counted", digits=2)


def q_filtered(spark, d):
    """Two iterations over a matrix of which every fifth column is empty."""
    a, y, c = _all(spark, d)
    return _rounded(mlem.mlem(a.where(F.col("c") % 5 != 0), y, c, 2), "x")


def q_supplier_mlem(spark, d):
    """Two iterations over long rows: suppliers by parts, counts from their balances."""
    a = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c"), F.col("l_quantity").alias("v"))
    y = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("r"), F.greatest(F.floor("s_acctbal"), F.lit(0)).cast("int").alias("y"))
    return _rounded(mlem.mlem(a, y, columns(spark, d), 2), "x")


def _dense(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v"))
    return e.select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v"))


def q_dense_forward(spark, d):
    x = spark.range(64).select(F.col("id").alias("c"), (F.col("id") + 1).cast("double").alias("x"))
    return _rounded(mlem.forward(_dense(spark, d), x, 64), "fw", digits=4)


def q_dense_backward(spark, d):
    a = _dense(spark, d)
    k = a.select("r").distinct().select("r", (F.col("r") % 7).cast("double").alias("k"))
    return _rounded(mlem.backward(a, k), "u", digits=4)


def _lengths(spark, d):
    return partitioning.row_lengths(matrix(spark, d), counts(spark, d))


def q_row_lengths(spark, d):
    return _lengths(spark, d)


def q_row_range(spark, d):
    """The first fifth of the rows."""
    to = counts(spark, d).count() // 5
    return matrix(spark, d).where(F.col("r") < to)


def q_prefix_sums(spark, d):
    n = _lengths(spark, d)
    both = partitioning.running(partitioning.running(n, "r", "cnt", True, 0, "incl"), "r", "cnt", False, 10, "excl")
    return both


def q_partition(rule, spark, d):
    return partitioning.by_rule(_lengths(spark, d), PARTS, rule)


def q_partition_report(spark, d):
    return partitioning.report(partitioning.by_rule(_lengths(spark, d), PARTS, "left"))


def q_two_level(spark, d):
    return partitioning.two_level(_lengths(spark, d), PARTS, 3)


def q_element_slices(spark, d):
    return partitioning.element_slices(_lengths(spark, d), PARTS)


def q_column_blocks(spark, d):
    c = columns(spark, d)
    a = matrix(spark, d).withColumn("block", partitioning.column_block(F.col("c"), c.count(), 5))
    return a.groupBy("block").agg(F.count(F.lit(1)).alias("cnt"), F.sum("v").alias("total"))


def q_shrink(spark, d):
    rows = partitioning.by_rule(_lengths(spark, d), PARTS, "left")
    return partitioning.report(partitioning.shrink(rows, lambda p: p % 2 == 0)).select("pid", "nnz")


def q_transpose(spark, d):
    return transpose.transpose(matrix(spark, d))


def q_pattern(spark, d):
    return transpose.transpose(matrix(spark, d), values=False)


def _as_text(c: str):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("long").cast("string"))).alias(c)


def q_csr_arrays(spark, d):
    rows = transpose.csr_arrays(matrix(spark, d), counts(spark, d))
    return rows.select("r", "start", _as_text("columns"), _as_text("values"))


def q_csc_arrays(spark, d):
    packed = transpose.csc_arrays(matrix(spark, d), columns(spark, d))
    return packed.select("c", "start", _as_text("rows"), _as_text("values"))


def q_csc_packed(spark, d):
    """The same from packed rows, with no row for each element on the way."""
    rows = cut(transpose.csr_arrays(matrix(spark, d), counts(spark, d)), "packed")
    packed = transpose.transpose_packed(rows, columns(spark, d))
    return packed.select("c", "start", _as_text("rows"), _as_text("values"))


#: A fixed value: the scanner that matrix files of the queries carry.
SCANNER = {"layers": [(1.0, 2.0, 3.0, 4.0, 0.5), (1.0, 2.0, 3.0, 6.0, 0.5)], "nblocks": 8, "block_gaps": [0.1, 0.1, 0.1], "ring_gaps": [0.2, 0.2, 0.2], "voxel_size": (0.5, 0.5, 0.5), "grid_dim": (100, 100, 10)}


def q_csr4_roundtrip(spark, d):
    """The matrix through a matrix file."""
    got = spark.read.format("csr4").option("path", _file(spark, d)).load()
    return got.select("r", "c", F.col("v").cast("double").alias("v"))


def _file(spark, d) -> str:
    path = new_path(spark, "matrix") + ".csr4"
    a, y, c = _all(spark, d)
    csr4.register(spark)
    csr4.write_csr4(a, path, y.count(), c.count(), SCANNER)
    return path


def q_csr4_row_range(spark, d):
    """The middle third of the rows of a matrix file, by filters on ``r``."""
    rows = counts(spark, d).count()
    got = spark.read.format("csr4").option("path", _file(spark, d)).load()
    return got.where((F.col("r") >= rows // 3) & (F.col("r") < 2 * rows // 3)).select("r", "c", F.col("v").cast("double").alias("v"))


def q_forward_sliced(spark, d):
    """The forward projection of a matrix file that is read by equal slices of elements: rows
    that slices cut are summed up in a second phase."""
    a, y, norm, x = _start(spark, d)
    sliced = spark.read.format("csr4").option("path", _file(spark, d)).option("slices", True).option("partitions", PARTS).load()
    fw = y.select("r").join(mlem.forward(sliced, x), "r", "left").select("r", F.coalesce("fw", F.lit(0.0)).alias("fw"))
    return _rounded(fw, "fw")


def q_row_index(spark, d):
    """Where each row of a matrix file begins and how long it is, from its stored row ends."""
    return spark.read.format("csr4index").option("path", _file(spark, d)).load()


def q_csr4_saved(spark, d):
    """The matrix through a folder of matrix files, written and read by tasks alone."""
    path = new_path(spark, "matrix")
    a, y, c = _all(spark, d)
    csr4.register(spark)
    csr4.save_csr4(a, path, y.count(), c.count(), SCANNER)
    return spark.read.format("csr4").option("path", path).load().select("r", "c", F.col("v").cast("double").alias("v"))


def q_matrix_meta(spark, d):
    """Dimensions and scanner as a matrix file states them."""
    meta = csr4.metadata(spark, _file(spark, d))
    return meta.select("n_rows", "n_cols", "nnz", F.col("sym.x").alias("sym_x"), "nblocks", F.size("layers").alias("layers"), (F.size("ring_gaps") + 1).alias("rings"), "grid_dim.x", "grid_dim.z")


def q_vector_roundtrip(spark, d):
    """The counts through a raw vector file."""
    csr4.register(spark)
    path = new_path(spark, "vector") + ".raw"
    csr4.write_vector(counts(spark, d).select(F.col("r").alias("i"), F.col("y").alias("x")), path, "int32")
    return spark.read.format("rawvec").option("path", path).option("dtype", "int32").load()


def q_voxels(spark, d):
    n = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 7 + F.col("l_partkey")).alias("n")).distinct()
    v = n.withColumn("p", G.voxel_of("n", 13, 11))
    return v.select("n", "p.x", "p.y", "p.z", G.voxel_number("p.x", "p.y", "p.z", 13, 11).alias("back"))


def q_scanner_counts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") % 5 + 1).alias("s"))
    n = G.crystals("s", 8, 2, 4)
    gaps = F.array_repeat(F.lit(0.1), F.col("s"))
    return p.select("p_partkey", n.alias("crystals"), G.lines_of_response(n).alias("lines"), G.voxels(100, "s", 10).alias("voxels"), G.with_gaps(gaps).cast("long").alias("rings"))


def q_vectors(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    a, b = G.vec("l_quantity", "l_linenumber", 2), G.vec("l_linenumber", 3, "l_quantity")
    v = t.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    s, c, m, u = G.add("a", "b"), G.cross("a", "b"), G.subtract("a", "b"), G.unit("a")
    k = G.negate(G.scale("a", 2.0))
    out = v.select("l_orderkey", "l_linenumber", G.dot("a", "b").alias("dot"), G.squared_norm("a").alias("sq"), F.round(G.norm("a"), 6).alias("norm"), s["x"].alias("sx"), m["z"].alias("mz"), c["x"].alias("cx"), c["y"].alias("cy"), c["z"].alias("cz"), k["y"].alias("ky"), F.round(u["x"], 6).alias("ux"))
    return out


def q_sphere(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", G.from_sphere(F.col("p_size") / 10.0, F.col("p_partkey") % 3, 2.0).alias("s"))
    return t.select("p_partkey", *((F.round(f"s.{n}", 6) + F.lit(0.0)).alias(n) for n in "xyz"))


def q_text_forms(spark, d):
    return matrix(spark, d).select(G.as_text("r", "c", F.col("v").cast("long")).alias("element"), G.as_text("c", F.col("v").cast("long")).alias("in_row"))


QUERIES = {
    "mlem_sql": q_mlem,
    "mlem_fused": q_mlem_fused,
    "mlem_by_column": q_mlem_by_column,
    "mlem_blocked": q_mlem_blocked,
    "mlem_copartitioned": q_mlem_copartitioned,
    "mlem_tiled": q_mlem_tiled,
    "mlem_resumed": q_mlem_resumed,
    "iteration_sums": q_iteration_sums,
    "column_sums": q_column_sums,
    "start_image": q_start_image,
    "forward_projection": q_forward,
    "correlation": q_correlation,
    "back_projection": q_backward,
    "image_update": q_update,
    "image_sum": q_image_sum,
    "conservation_check": q_conservation,
    "reconstruct_filtered": q_filtered,
    "supplier_mlem": q_supplier_mlem,
    "dense_forward": q_dense_forward,
    "dense_backward": q_dense_backward,
    "row_lengths": q_row_lengths,
    "row_range": q_row_range,
    "prefix_sums": q_prefix_sums,
    "partition_left": partial(q_partition, "left"),
    "partition_right": partial(q_partition, "right"),
    "partition_start": partial(q_partition, "start"),
    "partition_report": q_partition_report,
    "partition_two_level": q_two_level,
    "element_slices": q_element_slices,
    "column_blocks": q_column_blocks,
    "shrink": q_shrink,
    "transpose": q_transpose,
    "transpose_pattern": q_pattern,
    "csr_arrays": q_csr_arrays,
    "csc_arrays": q_csc_arrays,
    "csc_packed": q_csc_packed,
    "csr4_roundtrip": q_csr4_roundtrip,
    "csr4_row_range": q_csr4_row_range,
    "csr4_saved": q_csr4_saved,
    "forward_sliced": q_forward_sliced,
    "row_index": q_row_index,
    "matrix_meta": q_matrix_meta,
    "vector_roundtrip": q_vector_roundtrip,
    "voxels": q_voxels,
    "scanner_counts": q_scanner_counts,
    "vectors": q_vectors,
    "sphere": q_sphere,
    "text_forms": q_text_forms,
}

_TABLES = """WITH a AS MATERIALIZED (SELECT l_orderkey AS r, l_partkey AS c, l_quantity AS v FROM lineitem),
y AS MATERIALIZED (SELECT o_orderkey AS r, floor(o_totalprice / 1000)::INT AS y FROM orders),
d AS MATERIALIZED (SELECT p_partkey AS c FROM part)"""


def _steps(iterations: int, tables: str = _TABLES) -> str:
    """Common table expressions norm, x0 to xN, and f1, k1, u1 and so on."""
    sql = tables + """,
norm AS MATERIALIZED (SELECT d.c, coalesce(sum(v), 0) AS n FROM d LEFT JOIN a USING (c) GROUP BY d.c),
x0 AS MATERIALIZED (SELECT c, (SELECT sum(y) FROM y)::DOUBLE / (SELECT sum(n) FROM norm) AS x FROM norm)"""
    for i in range(1, iterations + 1):
        sql += f""",
f{i} AS MATERIALIZED (SELECT a.r, sum(v * x) AS fw FROM a JOIN x{i - 1} USING (c) GROUP BY a.r),
k{i} AS MATERIALIZED (SELECT y.r, CASE WHEN coalesce(fw, 0) <> 0 THEN y / fw ELSE 0 END AS k FROM y LEFT JOIN f{i} USING (r)),
u{i} AS MATERIALIZED (SELECT a.c, sum(v * k) AS u FROM a JOIN k{i} USING (r) GROUP BY a.c),
x{i} AS MATERIALIZED (SELECT o.c, x * CASE WHEN n <> 0 THEN coalesce(u, 0) / n ELSE coalesce(u, 0) END AS x FROM x{i - 1} o JOIN norm USING (c) LEFT JOIN u{i} USING (c))"""
    return sql


_MLEM = _steps(ITERATIONS) + f" SELECT c, round(x, 6) AS x FROM x{ITERATIONS}"
_LENGTHS = _TABLES + ", n AS MATERIALIZED (SELECT y.r, count(a.c) AS cnt FROM y LEFT JOIN a USING (r) GROUP BY y.r), w AS MATERIALIZED (SELECT *, sum(cnt) OVER (ORDER BY r)::BIGINT AS incl, (SELECT sum(cnt) FROM n)::BIGINT AS nnz FROM n)"


def _rule(share: str) -> str:
    return f", p AS MATERIALIZED (SELECT r, cnt, incl, least(greatest({share}, 0), {PARTS - 1})::INT AS pid FROM w)"


_LEFT, _RIGHT, _FIRST = (_rule(s) for s in (f"ceil((incl - cnt) * {PARTS} / nnz) - 1", f"ceil(incl * {PARTS} / nnz) - 1", f"floor((incl - cnt) * {PARTS} / nnz)"))
_DENSE = "WITH a AS (SELECT vec_id AS r, unnest(range(64)) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_SUPPLIER = """WITH a AS MATERIALIZED (SELECT l_suppkey AS r, l_partkey AS c, l_quantity AS v FROM lineitem),
y AS MATERIALIZED (SELECT s_suppkey AS r, greatest(floor(s_acctbal), 0)::INT AS y FROM supplier),
d AS MATERIALIZED (SELECT p_partkey AS c FROM part)"""

ORACLES = {
    **dict.fromkeys(("mlem_sql", "mlem_fused", "mlem_by_column", "mlem_blocked", "mlem_copartitioned", "mlem_tiled", "mlem_resumed"), _MLEM),
    "forward_sliced": _steps(1) + " SELECT y.r, round(coalesce(fw, 0), 6) AS fw FROM y LEFT JOIN f1 USING (r)",
    "row_index": _LENGTHS + " SELECT r, incl - cnt AS begin, cnt FROM w",
    "csr4_saved": _TABLES + " SELECT r, c, v FROM a",
    "iteration_sums": _steps(ITERATIONS) + " " + " UNION ALL ".join(f"SELECT {i}::INT AS iter, round(sum(x), 4) AS image_sum FROM x{i}" for i in range(1, ITERATIONS + 1)),
    "column_sums": _steps(0) + " SELECT c, n FROM norm",
    "start_image": _steps(0) + " SELECT c, round(x, 6) AS x FROM x0",
    "forward_projection": _steps(1) + " SELECT y.r, round(coalesce(fw, 0), 6) AS fw FROM y LEFT JOIN f1 USING (r)",
    "correlation": _steps(1) + " SELECT r, round(k, 6) AS k FROM k1",
    "back_projection": _steps(1) + " SELECT c, round(u, 6) AS u FROM u1",
    "image_update": _steps(1) + " SELECT c, round(x, 6) AS x FROM x1",
    "image_sum": _steps(1) + " SELECT round(sum(x), 4) AS image_sum FROM x1",
    "conservation_check": _steps(1) + " SELECT round((SELECT sum(x * n) FROM x1 JOIN norm USING (c)), 2) AS weighted, round((SELECT sum(y)::DOUBLE FROM y JOIN f1 USING (r) WHERE fw <> 0), 2) AS counted",
    "reconstruct_filtered": _steps(2, _TABLES.replace("FROM lineitem", "FROM lineitem WHERE l_partkey % 5 <> 0")) + " SELECT c, round(x, 6) AS x FROM x2",
    "supplier_mlem": _steps(2, _SUPPLIER) + " SELECT c, round(x, 6) AS x FROM x2",
    "dense_forward": _DENSE + " SELECT r, round(sum(v * (c + 1)), 4) AS fw FROM a GROUP BY r",
    "dense_backward": _DENSE + " SELECT c, round(sum(v * (r % 7)), 4) AS u FROM a GROUP BY c",
    "row_lengths": _LENGTHS + " SELECT r, cnt FROM n",
    "row_range": _TABLES + " SELECT * FROM a WHERE r < (SELECT count(*) // 5 FROM y)",
    "prefix_sums": _LENGTHS + " SELECT r, cnt, incl, incl - cnt + 10 AS excl FROM w",
    "partition_left": _LENGTHS + _LEFT + " SELECT r, cnt, pid FROM p",
    "partition_right": _LENGTHS + _RIGHT + " SELECT r, cnt, pid FROM p",
    "partition_start": _LENGTHS + _FIRST + " SELECT r, cnt, pid FROM p",
    "partition_report": _LENGTHS + _LEFT + " SELECT pid, min(r) AS row_start, max(r) + 1 AS row_end, sum(cnt)::BIGINT AS nnz FROM p GROUP BY pid",
    "partition_two_level": _LENGTHS + _RIGHT + ", t AS (SELECT *, sum(cnt) OVER (PARTITION BY pid ORDER BY r)::BIGINT AS i, sum(cnt) OVER (PARTITION BY pid)::BIGINT AS own FROM p) SELECT r, cnt, pid, CASE WHEN own > 0 THEN least(greatest(ceil(i * 3 / own) - 1, 0), 2) ELSE 0 END::INT AS tid FROM t",
    "element_slices": _LENGTHS + f", s AS (SELECT q::INT AS pid, ceil(q * nnz / {PARTS})::BIGINT AS lo, ceil((q + 1) * nnz / {PARTS})::BIGINT AS hi FROM range({PARTS}) t(q), (SELECT max(nnz) AS nnz FROM w)) SELECT pid, r, greatest(incl - cnt, lo) - (incl - cnt) AS \"from\", least(incl, hi) - (incl - cnt) AS \"to\" FROM w JOIN s ON incl > lo AND incl - cnt < hi WHERE cnt > 0",
    "column_blocks": _TABLES + " SELECT least(floor(c * 5 / (SELECT count(*) FROM d)), 4)::INT AS block, count(*) AS cnt, sum(v) AS total FROM a GROUP BY 1",
    "shrink": _LENGTHS + _LEFT + f" SELECT CASE WHEN pid % 2 = 0 THEN pid // 2 ELSE pid % {(PARTS + 1) // 2} END::INT AS pid, sum(cnt)::BIGINT AS nnz FROM p GROUP BY 1",
    "transpose": _TABLES + " SELECT c AS r, r AS c, v FROM a",
    "transpose_pattern": _TABLES + " SELECT c AS r, r AS c FROM a",
    "csr_arrays": _LENGTHS + " SELECT w.r, incl - cnt AS start, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c, v), '') AS columns, coalesce(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY c, v), '') AS values FROM w LEFT JOIN a USING (r) GROUP BY w.r, incl, cnt",
    **dict.fromkeys(("csc_arrays", "csc_packed"), _TABLES + ", n AS (SELECT d.c, count(a.r) AS cnt, coalesce(string_agg(r::VARCHAR, ',' ORDER BY r, v), '') AS rows, coalesce(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY r, v), '') AS values FROM d LEFT JOIN a USING (c) GROUP BY d.c) SELECT c, (sum(cnt) OVER (ORDER BY c) - cnt)::BIGINT AS start, rows, values FROM n"),
    "csr4_row_range": _TABLES + " SELECT * FROM a WHERE r >= (SELECT count(*) // 3 FROM y) AND r < (SELECT 2 * count(*) // 3 FROM y)",
    "matrix_meta": "SELECT (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM part) AS n_cols, (SELECT count(*) FROM lineitem) AS nnz, false AS sym_x, 8::BIGINT AS nblocks, 2::INT AS layers, 4::INT AS rings, 100::BIGINT AS x, 10::BIGINT AS z",
    "csr4_roundtrip": _TABLES + " SELECT r, c, v FROM a",
    "vector_roundtrip": _TABLES + " SELECT r AS i, y AS x FROM y",
    "voxels": "SELECT DISTINCT n, n % 13 AS x, (n % 143) // 13 AS y, n // 143 AS z, n AS back FROM (SELECT l_orderkey * 7 + l_partkey AS n FROM lineitem)",
    "scanner_counts": "SELECT p_partkey, s * 64 AS crystals, (s * 64) * (s * 64) AS lines, 1000 * s AS voxels, s + 1 AS rings FROM (SELECT p_partkey, (p_size % 5 + 1)::BIGINT AS s FROM part)",
    "vectors": "SELECT l_orderkey, l_linenumber, q * l + l * 3 + 2 * q AS dot, q * q + l * l + 4 AS sq, round(sqrt(q * q + l * l + 4), 6) AS norm, q + l AS sx, 2 - q AS mz, l * q - 6 AS cx, 2 * l - q * q AS cy, q * 3 - l * l AS cz, -2.0::DOUBLE * l AS ky, round(q / sqrt(q * q + l * l + 4), 6) AS ux FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_linenumber::DOUBLE AS l FROM lineitem)",
    "sphere": "SELECT p_partkey, round(2 * sin(t) * cos(f), 6) + 0.0 AS x, round(2 * sin(t) * sin(f), 6) + 0.0 AS y, round(2 * cos(t), 6) + 0.0 AS z FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS f, (p_partkey % 3)::DOUBLE AS t FROM part)",
    "text_forms": "SELECT format('({}, {}, {})', r, c, v::BIGINT) AS element, format('({}, {})', c, v::BIGINT) AS in_row FROM (SELECT l_orderkey AS r, l_partkey AS c, l_quantity AS v FROM lineitem)",
}
