"""Restartable runs: an image for each saved iteration, and the metrics of all of them.

A state is a folder ``iteration=N`` of Parquet files, written as a whole by Spark's
commit, with the fingerprint of matrix and counts that it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.operators.mlem import column_sums, mlem, start_image
from emrecon.sources.scratch import cut, remove


def fingerprint(a: DataFrame, y: DataFrame) -> str:
    """Depends on the elements and counts, not on their order or partitions: sums of hashes
    are exact, and repeated cells do not cancel out."""

    def total(*cols: str):
        return F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))

    one = a.agg(F.count(F.lit(1)), total("r", "c", "v")).first()
    two = y.agg(F.count(F.lit(1)), total("r", "y")).first()
    return "-".join(map(str, [*one, *two]))


def _folder(path: str, iteration: int) -> str:
    return f"{path}/iteration={iteration}"


def save(image: DataFrame, path: str, iteration: int, mark: str) -> None:
    image.select("c", "x", F.lit(mark).alias("mark")).write.mode("overwrite").parquet(_folder(path, iteration))


def saved(spark: SparkSession, path: str) -> list[int]:
    """Iterations with a complete state, in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("iteration=") and done(n))


def restore(spark: SparkSession, path: str, mark: str) -> tuple[int, DataFrame] | None:
    """The last state and its iteration, if there is one; an error if it is another matrix's."""
    if not (found := saved(spark, path)):
        return None
    image = spark.read.parquet(_folder(path, found[-1]))
    if not image.where(F.col("mark") != mark).isEmpty():
        raise ValueError("the saved state belongs to another matrix or other counts")
    return found[-1], image.select("c", "x")


def run(a: DataFrame, y: DataFrame, columns: DataFrame, iterations: int, path: str, every: int = 5, resume: bool = False, finish: bool = True) -> tuple[DataFrame, DataFrame]:
    """(image, metrics) with a state saved after every ``every`` iterations. With
    ``resume`` the run goes on from the last state; with ``finish`` states are deleted at
    the end. Metrics: iter, elapsed, forward, backward, image_sum; they cost no job of their
    own."""
    spark = a.sparkSession
    mark = fingerprint(a, y)
    state = restore(spark, path, mark) if resume else None
    done, image = state or (0, None)
    rows: list[dict] = []

    def after(i: int, x: DataFrame) -> None:
        if every and (done + i) % every == 0:
            save(x, path, done + i, mark)

    image = mlem(a, y, columns, max(0, iterations - done), None if image is None else cut(image, "image"), after=after, metrics=rows)
    if finish:
        remove(spark, path)
    schema = "iter int, elapsed double, forward double, backward double, image_sum double"
    return image, spark.createDataFrame([(done + r["iter"], *(r[k] for k in ("elapsed", "forward", "backward", "image_sum"))) for r in rows], schema)


def start_state(a: DataFrame, y: DataFrame, columns: DataFrame) -> DataFrame:
    return start_image(column_sums(a, columns), y)
