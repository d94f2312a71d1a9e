"""Partition rules: row ranges of like weight, element blocks, column blocks.

Running sums are taken over per-row counts, in three levels: inside blocks of consecutive
rows, over the totals of blocks inside a block of blocks, and over the totals of these, of
which there is one for each 2 ** 32 keys; so no task orders all rows or all blocks. A rule is
a closed form of the number of elements before or through a row, in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Consecutive keys of a block of the running sum.
BLOCK = 1 << 16


def running(df: DataFrame, key: str, value: str, inclusive: bool = True, base: int = 0, out: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows with a smaller ``key`` (or through the
    row's own) plus ``base``. Keys are distinct integers; null values count as 0."""
    v, size = F.coalesce(F.col(value), F.lit(0)), F.lit(BLOCK)
    df = df.withColumn("__b", div(F.col(key), size))
    sums = df.groupBy("__b").agg(F.sum(v).alias("__s")).withColumn("__t", div(F.col("__b"), size))
    tops = sums.groupBy("__t").agg(F.sum("__s").alias("__s"))
    earlier = lambda w, order: F.coalesce(F.sum("__s").over(w.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("__t", earlier(W.partitionBy(F.lit(0)), "__t").alias("__top"))  # a row for each BLOCK ** 2 keys
    sums = sums.withColumn("__inner", earlier(W.partitionBy("__t"), "__b")).join(tops, "__t").select("__b", (F.col("__inner") + F.col("__top")).alias("__before"))
    inside = W.partitionBy("__b").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = df.withColumn("__own", F.sum(v).over(inside) - (F.lit(0) if inclusive else v))
    return own.join(sums, "__b").withColumn(out, F.col("__own") + F.col("__before") + base).drop("__b", "__own", "__before")


def div(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)


def _div_up(a: Column, b: Column) -> Column:
    return div(a + b - 1, b)


def row_lengths(a: DataFrame, rows: DataFrame) -> DataFrame:
    """(r, cnt) for each row of the domain."""
    counts = a.groupBy("r").agg(F.count(F.lit(1)).alias("cnt"))
    return rows.select("r").join(counts, "r", "left").select("r", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def _clip(pid: Column, parts: int) -> Column:
    return F.least(F.greatest(pid.cast("int"), F.lit(0)), F.lit(parts - 1))


def by_rule(lengths: DataFrame, parts: int, rule: str) -> DataFrame:
    """(r, cnt, pid) by ``left`` (a row across a limit stays with the part before),
    ``right`` (goes to the part after) or ``start`` (the part that its first element is in)."""
    through = running(lengths, "r", "cnt", out="incl").withColumn("before", F.col("incl") - F.col("cnt"))
    total = lengths.agg(F.sum("cnt").alias("nnz"))
    rows = through.crossJoin(F.broadcast(total))  # one row
    share = {"left": _div_up(F.col("before") * parts, F.col("nnz")) - 1, "right": _div_up(F.col("incl") * parts, F.col("nnz")) - 1, "start": div(F.col("before") * parts, F.col("nnz"))}[rule]
    return rows.select("r", "cnt", _clip(F.when(F.col("nnz") > 0, share).otherwise(0), parts).alias("pid"))


def two_level(lengths: DataFrame, parts: int, inner: int) -> DataFrame:
    """(r, cnt, pid, tid): rule ``right`` for the parts, and again inside each part."""
    rows = by_rule(lengths, parts, "right")
    totals = rows.groupBy("pid").agg(F.sum("cnt").alias("own"))
    starts = totals.select("pid", "own", F.coalesce(F.sum("own").over(W.partitionBy(F.lit(0)).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("from"))  # a row for each part
    rows = running(rows, "r", "cnt", out="incl").join(F.broadcast(starts), "pid")
    tid = _div_up((F.col("incl") - F.col("from")) * inner, F.when(F.col("own") > 0, F.col("own"))) - 1
    return rows.select("r", "cnt", "pid", _clip(F.coalesce(tid, F.lit(0)), inner).alias("tid"))


def column_block(c: Column, columns: int, blocks: int) -> Column:
    return F.least(div(c * F.lit(blocks), F.lit(columns)), F.lit(blocks - 1)).cast("int")


def element_slices(lengths: DataFrame, parts: int) -> DataFrame:
    """(pid, r, from, to): which elements of which row each of ``parts`` equal element
    blocks covers; a row may lie in several. Slices and rows overlap as ranges."""
    rows = running(lengths, "r", "cnt", inclusive=False, out="begin").crossJoin(F.broadcast(lengths.agg(F.sum("cnt").alias("nnz"))))
    rows = rows.where("cnt > 0").withColumn("end", F.col("begin") + F.col("cnt"))
    first = div(F.col("begin") * parts, F.col("nnz"))
    last = div((F.col("end") - 1) * parts, F.col("nnz"))
    spans = rows.withColumn("pid", F.explode(F.sequence(first, F.least(last + 1, F.lit(parts - 1)))))
    lo, hi = (_div_up(p * F.col("nnz"), F.lit(parts)) for p in (F.col("pid"), F.col("pid") + 1))
    spans = spans.withColumn("from", F.greatest("begin", lo)).withColumn("to", F.least("end", hi))
    return spans.where(F.col("from") < F.col("to")).select(F.col("pid").cast("int").alias("pid"), "r", (F.col("from") - F.col("begin")).alias("from"), (F.col("to") - F.col("begin")).alias("to"))


def report(rows: DataFrame) -> DataFrame:
    """(pid, row_start, row_end, nnz): half-open row range and weight of each part."""
    return rows.groupBy("pid").agg(F.min("r").alias("row_start"), (F.max("r") + 1).alias("row_end"), F.sum("cnt").alias("nnz"))


def shrink(rows: DataFrame, keep) -> DataFrame:
    """Parts renumbered after dropping those for which ``keep(pid)`` is false; rows of a
    dropped part are taken over by the kept parts in turn."""
    parts = rows.select("pid").distinct()
    kept = parts.where(keep(F.col("pid"))).select("pid", (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("pid")) - 1).alias("new"))  # a row for each part
    n = kept.agg(F.count(F.lit(1)).alias("left"))
    out = rows.join(F.broadcast(kept), "pid", "left").crossJoin(F.broadcast(n))
    return out.select("r", "cnt", F.coalesce("new", (F.col("pid") % F.col("left"))).cast("int").alias("pid"))
