"""The fused iteration: both projections in one pass over whole rows.

Rows lie packed, one record a row, so projection and correlation need no exchange. Vectors
over columns are tables of dense chunks, a record for ``CHUNK`` consecutive columns. A task
loads each chunk of the image that its rows touch once, from the files of the written
table, and sends one dense partial update for each; these are summed up by chunk, a stream
at a time, and the update of the image is a column expression on chunks. No vector passes
the driver, and a task holds the touched chunks of image and update, however many columns
there are. ``transpose.MOST_IN_ROW`` bounds a packed row; beyond it the join form in
``mlem`` is to be used, and this one says so."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emrecon.operators.mlem import column_sums
from emrecon.operators.transpose import IN_PART, MOST_IN_ROW
from emrecon.sources.scratch import cut, forget

#: Columns of a chunk.
CHUNK = 1 << 16


def packed_rows(a: DataFrame) -> DataFrame:
    """(r, columns, values): one record for each row with an element."""
    return a.groupBy("r").agg(F.collect_list(F.struct("c", F.col("v").cast("double").alias("v"))).alias("e")).select("r", F.col("e.c").alias("columns"), F.col("e.v").alias("values"))


def _row_of(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def chunked(vector: DataFrame, value: str, chunk: int = CHUNK) -> DataFrame:
    """(k, ``value``): dense chunks of a vector with an entry for each c from 0 on."""
    rows = vector.groupBy(F.expr(f"c div {chunk}").alias("k")).agg(F.sort_array(F.collect_list(F.struct("c", F.col(value).alias("x")))).alias("e"))
    return rows.select("k", F.col("e.x").alias(value))


class Chunks:
    """Chunks of a written table (k, x), loaded when they are first asked for."""

    def __init__(self, files: list[str], chunk: int):
        fs = FileSystem.from_uri(files[0])[0] if files else None
        self.table = ds.dataset([FileSystem.from_uri(f)[1] for f in files], filesystem=fs, format="parquet") if files else None
        self.chunk, self.loaded = chunk, {}

    def entries(self, c: np.ndarray) -> np.ndarray:
        at = c // self.chunk
        needed = np.unique(at)
        if new := [k for k in needed.tolist() if k not in self.loaded]:
            found = self.table.to_table(columns=["k", "x"], filter=ds.field("k").isin(new))
            for k, x in zip(found.column("k").to_pylist(), found.column("x"), strict=True):
                self.loaded[k] = x.values.to_numpy()
        # the touched chunks side by side
        base = np.zeros(int(needed[-1]) + 1 if len(needed) else 0, np.int64)
        parts = [self.loaded[k] for k in needed.tolist()]
        base[needed] = np.cumsum([0, *map(len, parts)])[:-1]
        return np.concatenate(parts)[base[at] + c % self.chunk] if parts else np.zeros(0)


def fused_update(rows: DataFrame, image: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(k, u) from packed rows with counts (r, y, columns, values) and the image's chunks,
    a written table."""
    files = image.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, upd = Chunks(files, chunk), {}
        for batch in batches:
            lists = batch.column("columns")
            c, v, r = lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy(), _row_of(lists)
            fw = np.bincount(r, v * x.entries(c), batch.num_rows)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            cor = np.divide(y, fw, out=np.zeros_like(fw), where=fw != 0)
            terms, at = v * cor[r], c // chunk
            if len(at) and at.min() == at.max():  # one chunk: nothing to sort
                order, starts = slice(None), [0]
            else:
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.r_[len(at) > 0, np.diff(at[order]) > 0]).tolist()
            c, at, terms = c[order], at[order], terms[order]
            for lo, hi in zip(starts, [*starts[1:], len(c)], strict=True):
                k = int(at[lo])
                own = np.bincount(c[lo:hi] - k * chunk, terms[lo:hi], chunk)
                upd[k] = upd[k] + own if k in upd else own
        for k, u in upd.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([u])], ["k", "u"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for k, u in zip(batch.column("k").to_pylist(), batch.column("u"), strict=True):
                if key is not None and k != key:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total])], ["k", "u"])
                    total = None
                u = u.values.to_numpy()
                key, total = k, u.copy() if total is None else total + u
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total])], ["k", "u"])

    parts = rows.select("y", "columns", "values").mapInArrow(run, "k long, u array<double>")
    return parts.repartition("k").sortWithinPartitions("k").mapInArrow(summed, "k long, u array<double>")


def updated(image: DataFrame, upd: DataFrame, norm: DataFrame) -> DataFrame:
    """(k, x): x u / n, and x u where the column sum n is 0."""
    rows = image.join(norm, "k").join(upd, "k", "left")
    factor = F.zip_with(F.coalesce("u", F.transform("n", lambda n: F.lit(0.0))), "n", lambda u, n: F.when(n != 0, u / F.when(n != 0, n)).otherwise(u))
    return rows.select("k", F.zip_with("x", F.slice(factor, F.lit(1), F.size("x")), lambda x, f: x * f).alias("x"))


def mlem_fused(a: DataFrame, y: DataFrame, columns: DataFrame, iterations: int, chunk: int = CHUNK) -> DataFrame:
    """(c, x) after the iterations. Columns are numbered from 0 without gaps."""
    if iterations < 0:
        raise ValueError("iterations cannot be negative")
    lengths = a.groupBy("r").count().agg(F.max("count"), F.sum("count")).first()
    longest, total = lengths[0] or 0, lengths[1] or 0
    sums = column_sums(a, columns)
    norm = cut(chunked(sums, "n", chunk), "norm")
    n, least, most = columns.agg(F.count(F.lit(1)), F.min("c"), F.max("c")).first()
    if longest > MOST_IN_ROW or n and (least, most) != (0, n - 1):
        raise ValueError("a row is too large for the fused form, or columns are not numbered from 0: use mlem()")
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // IN_PART))
    rows = cut(packed_rows(a.repartition(parts, "r")).join(y.select("r", F.col("y").cast("double").alias("y")), "r"), "rows")
    start = y.agg(F.coalesce(F.sum(F.col("y").cast("double")), F.lit(0.0)).alias("sy")).crossJoin(norm.agg(F.sum(F.aggregate("n", F.lit(0.0), lambda s, x: s + x)).alias("sn")))  # one row each
    even = F.when(F.col("sn") != 0, F.col("sy") / F.when(F.col("sn") != 0, F.col("sn"))).otherwise(0.0)
    image = cut(norm.crossJoin(F.broadcast(start)).select("k", F.transform("n", lambda _: even).alias("x")), "image")
    for _ in range(iterations):
        old, image = image, cut(updated(image, fused_update(rows, image, chunk), norm), "image")
        forget(old)
    return image.select("k", F.posexplode("x").alias("at", "x")).select((F.col("k") * chunk + F.col("at")).alias("c"), "x")
