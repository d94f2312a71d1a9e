"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest: one row per text ever seen,
with the name of the batch that brought it. A batch is reduced to one row per digest with
map-side sums, anti-joined with the index by sort-merge, and what is new is appended.
DataFrame operations only.

An index lies in a folder for each of its generations, named by number and buckets; the
last complete one counts. ``compact`` writes the next one, with as many buckets as its rows
need, each sorted in one file again; one that broke off is left aside, and the next try takes
a new folder. Appends become visible as a whole, when Spark commits.

Defined cases: null texts count as empty ones; a text of any length is taken whole, and
equal texts of any number are one group; an empty batch gives no rows and leaves the index
as it is; repeated rows are members of a group like any other, and exactly one row of a
group stays, of rows that share the smallest doc_id any one; a null doc_id sorts after all
others; further columns, whatever their names, are ignored. A batch that is run again under
its name, as after a crash before its result was written, gets the result that it had:
what it has appended itself does not count as seen. Under another name it keeps nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.llm.common import TAGS, attach, buckets_for, cut, documents, new_path, only_marked, tags

#: ASCII white space, a run of which counts as one space.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows of a bucket, about, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 64


def digest(text) -> F.Column:
    """SHA-256, in hex, of the UTF-8 text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(text, BLANKS, " ").cast("binary"), 256)


def _generations(spark: SparkSession, path: str, complete: bool = True) -> list[tuple[int, int]]:
    """(number, buckets) of the generations of an index, in order: of the complete ones, or
    of all that were begun."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = [(m, n) for n in names if (m := re.fullmatch(r"generation-(\d+)-(\d+)", n))]
    return sorted((int(m[1]), int(m[2])) for m, n in found if not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _table(spark: SparkSession, path: str, number: int, buckets: int) -> str:
    where = f"{path}/generation-{number}-{buckets}"
    name = f"digest_index_{hashlib.md5(where.encode()).hexdigest()}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (text_sha256 STRING, keep_id BIGINT, batch STRING) USING parquet "
        f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{where}'"
    )
    return name


def _append(rows: DataFrame, index: str, buckets: int) -> None:
    rows.select("text_sha256", "keep_id", "batch").repartition(buckets, "text_sha256").write.insertInto(index)
    rows.sparkSession.catalog.refreshTable(index)


def open_index(spark: SparkSession, path: str, buckets: int) -> tuple[str, int]:
    """Name of the table over the index at ``path`` and its number of buckets; where there
    is none it is created, with ``buckets``."""
    number, own = (_generations(spark, path) or [(0, buckets)])[-1]
    return _table(spark, path, number, own), own


def compact(spark: SparkSession, path: str, rows: int = BUCKET_ROWS, least: int = LEAST_BUCKETS) -> int:
    """Write the next generation of an index, of about ``rows`` rows a bucket, one file for
    each; give the number of buckets. The generation before can be deleted then."""
    if not (found := _generations(spark, path)):
        raise ValueError(f"no index at {path}")
    old = spark.table(_table(spark, path, *found[-1]))
    buckets = buckets_for(old.count(), rows, least)
    number = _generations(spark, path, complete=False)[-1][0] + 1
    _append(old, _table(spark, path, number, buckets), buckets)
    return buckets


def _dedup(spark: SparkSession, docs: DataFrame, path: str, name: str | None, buckets: int | None) -> DataFrame:
    """The columns of ``dedup_batch``, and TAGS."""
    name = name or uuid.uuid4().hex
    text = F.col("text")
    batch = cut(documents(docs).select("doc_id", F.monotonically_increasing_id().alias("rid"), digest(text).alias("text_sha256"), *tags(text)), "digests")
    total = batch.count()
    # min_by has fixed-width buffers, so copies are summed up by hash before the shuffle
    groups = cut(
        batch.groupBy("text_sha256").agg(
            F.min("doc_id").alias("first_id"), F.coalesce(F.min_by("rid", "doc_id"), F.min("rid")).alias("first_rid"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    index, buckets = open_index(spark, path, buckets or buckets_for(total, BUCKET_ROWS, LEAST_BUCKETS))
    known = spark.table(index)
    fresh = cut(groups.join(known.where(F.col("batch") != name).hint("merge"), "text_sha256", "left_anti"), "fresh")
    unwritten = cut(fresh.join(known.where(F.col("batch") == name).hint("merge"), "text_sha256", "left_anti"), "unwritten")
    # an index has a text once; a copy that was left by anything else must not give a row twice
    others = known.where(F.col("batch") != name).groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"))
    seen = groups.join(others.hint("merge"), "text_sha256").select("text_sha256", "keep_id", "group_size", F.lit(None).cast("long").alias("stays"))
    facts = cut(seen.unionByName(fresh.select("text_sha256", F.col("first_id").alias("keep_id"), "group_size", F.col("first_rid").alias("stays"))), "facts")
    _append(unwritten.select("text_sha256", F.col("first_id").alias("keep_id"), F.lit(name).alias("batch")), index, buckets)
    out = attach(batch, facts, "text_sha256", "group_size", total)
    kept = F.coalesce(F.col("rid") == F.col("stays"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *TAGS)


def dedup_batch(spark: SparkSession, docs: DataFrame, index_path: str, name: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the row that stays, perhaps one of an
    earlier batch), group_size (rows of this batch), kept, text_sha256. ``name`` tells a
    batch from others; ``buckets`` counts where the index is created."""
    return _dedup(spark, docs, index_path, name, buckets).drop(*TAGS)


def keep_first(spark: SparkSession, docs: DataFrame, index_path: str, name: str | None = None) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay. Only digests and keys are
    shuffled, no texts."""
    return only_marked(docs, _dedup(spark, docs, index_path, name, None).withColumnRenamed("kept", "stays"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch over a new index in the shared folder."""
    return dedup_batch(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "digest-index"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
