"""Command line: ``python -m emrecon.jobs.run MATRIX COUNTS ITERATIONS OUTPUT [options]``.

MATRIX is a matrix file (.csr4) or a Parquet table (r, c, v); COUNTS a raw file of 32-bit
numbers or a Parquet table (r, y); OUTPUT a Parquet folder for the image (c, x), or a raw
file of 32-bit floats if it ends in .raw."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emrecon.operators import checkpoints, fused, mlem
from emrecon.operators.transpose import written
from emrecon.sources import csr4
from emrecon.sources.scratch import cut


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("matrix")
    p.add_argument("counts")
    p.add_argument("iterations", type=int)
    p.add_argument("output")
    p.add_argument("--strategy", choices=("joins", "fused", "by_column"), default="joins")
    p.add_argument("--columns", type=int, help="number of columns of a Parquet matrix")
    p.add_argument("--metrics", help="folder for the metrics of each iteration as CSV; needs --states")
    p.add_argument("--states", help="folder for saved states")
    p.add_argument("--every", type=int, default=5, help="iterations between saved states")
    p.add_argument("--resume", action="store_true", help="go on from the last saved state")
    p.add_argument("--partitions", type=int, default=64)
    return p.parse_args(args)


def main(args: list[str] | None = None) -> None:
    o = arguments(args)
    spark = SparkSession.builder.appName("emrecon").getOrCreate()
    csr4.register(spark)
    if o.matrix.endswith(".csr4"):
        a = spark.read.format("csr4").option("path", o.matrix).option("partitions", o.partitions).load()
        head = csr4.files_of(o.matrix)[1]
        a, n, rows = cut(a, "matrix"), head["n_cols"], head["n_rows"]
    else:
        a = spark.read.parquet(o.matrix)
        n, rows = o.columns or (a.agg(F.max("c")).first()[0] or 0) + 1, None
    if o.counts.endswith(".raw"):
        y = spark.read.format("rawvec").option("path", o.counts).option("dtype", "int32").load().toDF("r", "y")
    else:
        y = spark.read.parquet(o.counts).select("r", "y")
    if rows is not None:
        y = mlem.require_counts(y, rows)
    columns = spark.range(n).withColumnRenamed("id", "c")
    if o.strategy == "fused":
        image = fused.mlem_fused(a, y, columns, o.iterations)
    elif o.states:
        image, metrics = checkpoints.run(a, y, columns, o.iterations, o.states, o.every, o.resume)
        metrics.show(o.iterations, truncate=False)
        if o.metrics:
            metrics.write.mode("overwrite").option("header", True).csv(o.metrics)
    else:
        copy = written(a, "c", "r") if o.strategy == "by_column" else None
        image = mlem.mlem(a, y, columns, o.iterations, by_column=copy, copy=rows is None)  # a file's copy is in order of rows
    if o.output.endswith(".raw"):
        csr4.write_vector(image.select(F.col("c").alias("i"), "x"), o.output)
    else:
        image.write.mode("overwrite").parquet(o.output)


if __name__ == "__main__":
    main()
