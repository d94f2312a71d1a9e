"""What the classifiers share: a bounded sample of labelled rows, and calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from emrecon.llm.common import cut, documents


#: Texts that are scored at once.
SLICE = 256
#: Parts in which a sample's gradient is taken, each by one task.
PARTS = 8


def remainder(of: int) -> Column:
    """The fold of a row: crc32 of its doc_id as text, modulo ``of``. A null id has none."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, bound: int) -> DataFrame:
    """doc_id, text, y, part (0 to 1, random but fixed) of at most ``bound`` labelled rows
    of the fold; the bound also covers what is broadcast. Rows are drawn by a hash."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    ids = ids.where(fold).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    return cut(documents(docs).join(F.broadcast(cut(ids, "sample")), "doc_id").withColumn("part", part), "labelled")


def with_scores(docs: DataFrame, scores: Callable[[list[str]], np.ndarray], name: str) -> DataFrame:
    """``docs`` as it is, with ``scores`` of the texts (null: empty) as column ``name``: a
    filter needs no join back to the texts then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                own = pa.array(scores([t or "" for t in batch.column("text").to_pylist()]), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, name])

    # whole texts of 10 000 rows, the default, take hundreds of MB on their way to and from Python
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4 * SLICE)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def descend(rows: DataFrame, gradient: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], start: np.ndarray, rates: np.ndarray, decay: np.ndarray | float, steps: int) -> np.ndarray:
    """Parameters after ``steps`` of Adam over all of ``rows``, a written table. The rows
    stay where they are: in each step tasks get the parameters and give the sum of
    ``gradient`` over their batches, so that only PARTS vectors of the parameters' size reach
    the driver, however many entries the rows have. The sum is divided by the rows' number."""
    context, size = rows.sparkSession.sparkContext, len(start)
    params, first, second = start.astype(float), np.zeros(size), np.zeros(size)
    count = rows.count()
    for step in range(1, steps + 1):
        shared = context.broadcast(params.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, now = np.zeros(size), shared.value.astype(float)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    total += gradient(now, whole.slice(at, SLICE))
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["g"])

        parts = rows.coalesce(PARTS).mapInArrow(run, "g binary").collect()
        shared.destroy()
        g = sum((np.frombuffer(r["g"], np.float32).astype(float) for r in parts), np.zeros(size)) / max(1, count) + decay * params
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        params -= rates * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params


def has_both(rows: DataFrame) -> bool:
    return rows.select("y").distinct().count() > 1


def parts_of(rows: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The rows to fit on and those to calibrate with, apart where both have both classes."""
    fits, held = rows.where(F.col("part") < share), rows.where(F.col("part") >= share)
    return (fits, held) if has_both(fits) and has_both(held) else (rows, rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset that make sigmoid(slope * margin + offset) a probability,
    by Newton's method with smoothed targets; (1, 0) where one class is missing."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-6, float(margin.std()))
    x = np.stack([margin / scale, np.ones_like(margin)], 1)
    w = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(100):
        p = sigmoid(x @ w)
        g = x.T @ (p - target) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return max(1e-6, float(w[0]) / scale), float(w[1])


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
