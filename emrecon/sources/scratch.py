"""Tables that cut a plan's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where none
    is named and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="emrecon-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/emrecon/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: the lineage ends
    there, and a lost executor costs a file read instead of a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library, on whatever file system it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bucketed(df: DataFrame, key: str | list[str], buckets: int, *order: str, dealt: bool = False) -> DataFrame:
    """A written table of ``df`` in the shared folder, bucketed by ``key`` and sorted in each
    bucket by it and by ``order``: joins and sums by the key need no exchange. ``dealt``: the
    rows lie in as many partitions by the key already."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    path = new_path(spark, f"bucketed_by_{'_'.join(keys)}")
    name = f"emrecon_{path.rpartition('-')[2]}"
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` or ``bucketed`` gave, once nothing reads it."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/emrecon/" in path:
            remove(df.sparkSession, path)
