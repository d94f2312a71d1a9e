"""What the operators of this subpackage share: cut points, two-level ranks, joins on hot keys."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emrecon.sources.scratch import cut, new_path

__all__ = ["TAGS", "attach", "buckets_for", "cut", "documents", "held", "new_path", "only_marked", "ranked", "tags"]

#: Up to so many keys of rows are broadcast to find the rows; more are joined.
BROADCAST_IDS = 500_000
#: Columns that tell rows with one doc_id apart by their texts.
TAGS = ["tag_a", "tag_b"]

#: A key is hot with at least this share of the rows, so at most this many keys are hot.
HOT_SHARE = 1024


_held: dict = {}


def held(key, make):
    """What ``make`` gives, kept for this worker's next batches and tasks until another
    operator keeps something: workers outlive stages, and one cache at a time is enough."""
    if key not in _held:
        if _held:
            _held.clear()
            _give_back()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Free memory goes back to the system, where its C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text, null counting as empty; other columns only as named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def buckets_for(rows: int, each: int = 20_000, least: int = 1) -> int:
    """How many buckets keep a bucket near ``each`` rows, whatever the size of the input."""
    return max(least, -(-rows // each))


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one fact row per ``key``. ``facts[weight]`` counts the
    rows of each key: keys with 1/1024 of ``total`` rows or more, of which there can be
    1024 at most, are broadcast; all others meet in a sort-merge join."""
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    hot = facts.where(is_hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~is_hot), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def ranked(df: DataFrame, groups: list[str], order: list[str], bucket: str, out: str, weight: str | None = None) -> DataFrame:
    """0-based rank (or running total of ``weight`` before the row) within ``groups``.

    Rows are dealt by groups and ``bucket``, ranked there, and shifted by the totals of
    the buckets before; so a group of any size is spread over its buckets. The running
    sum over bucket totals sees one row per group and bucket only."""
    w = F.lit(1) if weight is None else F.col(weight)
    sums = df.groupBy(*groups, bucket).agg(F.sum(w).cast("long").alias("__sum"))
    before = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = df.withColumn("__own", F.sum(w).over(inside).cast("long") - w)
    return own.join(sums, [*groups, bucket]).withColumn(out, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before")


def tags(text: Column) -> list[Column]:
    """The columns named in TAGS: 96 bits of hashes of the text as it is."""
    return [F.xxhash64(text).alias(TAGS[0]), F.hash(text).alias(TAGS[1])]


def only_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that stay, by ``marked``: doc_id, TAGS and
    ``stays`` of each row. Of rows alike in doc_id and text one stays if any is marked so.
    Only keys of rows that go meet the texts, so these are not shuffled while the keys are
    few enough for a broadcast."""
    per_key = cut(marked.groupBy("doc_id", *TAGS).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows")).where("NOT stays OR rows > 1"), "marks")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))

    def same(keys: DataFrame):
        a, b = (t.eqNullSafe(keys[name]) for t, name in zip(tags(text), TAGS, strict=True))
        return docs["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & a & b

    gone, once = per_key.where("NOT stays"), per_key.where("stays")
    if per_key.count() <= BROADCAST_IDS:
        gone, once = F.broadcast(gone), F.broadcast(once)
    if once.isEmpty():
        return docs.join(gone, same(gone), "left_anti")
    single = docs.join(gone, same(gone), "left_anti").join(once, same(once), "left_anti")
    names = [free_name(docs, k) for k in ("doc_id_key", *TAGS)]
    keys = [docs["doc_id"].cast("long").alias(names[0]), *(t.alias(n) for t, n in zip(tags(text), names[1:], strict=True))]
    repeated = docs.join(once, same(once), "left_semi").select("*", *keys).dropDuplicates(names).drop(*names)
    return single.unionByName(repeated)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
