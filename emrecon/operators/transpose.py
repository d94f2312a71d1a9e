"""Sparse transposition and packed forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emrecon.operators.partitioning import running
from emrecon.sources.scratch import cut

#: Elements of a row that is packed into one record.
MOST_IN_ROW = 4_000_000
#: Elements of a part of a written copy, about, and keys of a block of a row or column.
IN_PART, IN_BLOCK = 4_000_000, 1_000_000


def transpose(a: DataFrame, values: bool = True) -> DataFrame:
    """(r, c, v) of the transposed matrix; the pattern alone without ``values``."""
    cols = [F.col("c").alias("r"), F.col("r").alias("c")]
    return a.select(*cols, *(["v"] if values else []))


def laid_out(a: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``a`` dealt by the first key and sorted by all keys in each part: what belongs to
    one row or column lies together, but a long one is split in blocks of the second key."""
    salt = [F.floor(F.col(k) / IN_BLOCK) for k in keys[1:2]]
    return a.repartition(parts, keys[0], *salt).sortWithinPartitions(*keys)


def parts_for(a: DataFrame) -> int:
    """Of how many parts a copy of ``a`` is: no fewer than a shuffle has partitions, even
    where the source is a file that one task reads."""
    return max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-a.count() // IN_PART))


def written(a: DataFrame, *keys: str) -> DataFrame:
    """A written copy of ``a``, laid out by the keys, for jobs that read it many times. A
    sum by the first key is complete but for rows of several blocks before any exchange."""
    return cut(laid_out(a, parts_for(a), *keys), f"by_{keys[0]}")


def csr_arrays(a: DataFrame, rows: DataFrame) -> DataFrame:
    """(r, start, columns, values): for each row of the domain the place of its first
    element and its elements in order of columns. A row above ``MOST_IN_ROW`` elements is
    an error, as it would be one record."""
    longest = a.groupBy("r").count().agg(F.max("count")).first()[0] or 0
    if longest > MOST_IN_ROW:
        raise ValueError(f"a row of {longest} elements cannot be packed")
    packed = a.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("e"))
    full = rows.select("r").join(packed, "r", "left").withColumn("cnt", F.coalesce(F.size("e"), F.lit(0)).cast("long"))
    full = full.withColumn("cnt", F.greatest("cnt", F.lit(0)))
    out = running(full, "r", "cnt", inclusive=False, out="start")
    return out.select("r", "start", F.coalesce("e.c", F.array().cast("array<long>")).alias("columns"), F.coalesce("e.v", F.array().cast("array<double>")).alias("values"))


def csc_arrays(a: DataFrame, columns: DataFrame) -> DataFrame:
    """(c, start, rows, values): the same by columns, elements in order of rows."""
    packed = csr_arrays(transpose(a), columns.select(F.col("c").alias("r")))
    return packed.select(F.col("r").alias("c"), "start", F.col("columns").alias("rows"), "values")


def fragments(packed: DataFrame, bounds: list[int]) -> DataFrame:
    """(block, columns, rows, values): the elements of packed rows (r, columns, values) in
    order of columns, a record for each batch of rows and block of columns. Block k has the
    columns from ``bounds[k]`` on."""
    shared = packed.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))
    kinds = [pa.int64(), *([pa.list_(pa.int64())] * 2), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("columns")
            c, v = lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy(zero_copy_only=False)
            if not len(c):
                continue
            r = np.repeat(batch.column("r").to_numpy(), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(c, kind="stable")
            c, r, v = c[order], r[order], v[order]
            block = np.searchsorted(shared.value, c, side="right") - 1
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist()
            ends = [*starts[1:], len(c)]
            parts = [[block[lo] for lo in starts], *([x[lo:hi] for lo, hi in zip(starts, ends, strict=True)] for x in (c, r, v))]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(parts, kinds, strict=True)], ["block", "columns", "rows", "values"])

    return packed.select("r", "columns", "values").mapInArrow(run, "block long, columns array<long>, rows array<long>, values array<double>")


def merged(parts: DataFrame) -> DataFrame:
    """(c, rows, values) from fragments: the sorted runs of a block of columns are merged,
    one block at a time."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def block(runs: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        c, r, v = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.lexsort((v, r, c))
        c, r, v = c[order], r[order], v[order]
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        offsets = pa.array(np.r_[starts, len(c)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c[starts]), pa.ListArray.from_arrays(offsets, pa.array(r)), pa.ListArray.from_arrays(offsets, pa.array(v))], schema=pa.schema(zip(("c", "rows", "values"), kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = None, []
        for batch in batches:
            for k, *lists in zip(batch.column("block").to_pylist(), *(batch.column(x) for x in ("columns", "rows", "values")), strict=True):
                if runs and k != key:
                    yield block(runs)
                    runs = []
                key = k
                runs.append(tuple(x.values.to_numpy(zero_copy_only=False) for x in lists))
        if runs:
            yield block(runs)

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "c long, rows array<long>, values array<double>")


def transpose_packed(packed: DataFrame, columns: DataFrame, in_block: int = IN_PART) -> DataFrame:
    """(c, start, rows, values), as ``csc_arrays`` gives it, from packed rows (r, columns,
    values), with no row for each element: columns are counted and their places summed up;
    blocks of columns begin where another ``in_block`` elements do; batches of rows are
    scattered to blocks, and what a block gets is merged. There are as many blocks as the
    matrix has parts, so their limits are broadcast."""
    lengths = packed.select(F.explode("columns").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("cnt"))
    full = columns.select("c").join(lengths, "c", "left").select("c", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    places = cut(running(full, "c", "cnt", inclusive=False, out="start"), "places")
    longest = places.agg(F.max("cnt")).first()[0] or 0
    if longest > MOST_IN_ROW:
        raise ValueError(f"a column of {longest} elements cannot be packed")
    firsts = places.where("cnt > 0").groupBy(F.expr(f"start div {in_block}").alias("b")).agg(F.min("c").alias("c")).orderBy("c").collect()  # a row for each block
    found = merged(fragments(packed, [r["c"] for r in firsts]))
    out = places.join(found, "c", "left")
    return out.select("c", "start", F.coalesce("rows", F.array().cast("array<long>")).alias("rows"), F.coalesce("values", F.array().cast("array<double>")).alias("values"))
