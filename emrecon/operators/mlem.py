"""Maximum-likelihood expectation maximisation over a sparse matrix.

The matrix is a DataFrame (r, c, v) in which missing cells are 0 and repeated cells add
up; the counts are (r, y), the image (c, x), with a row for each key of their domain. A
projection is an equi-join, a product and a grouped sum, which Spark sums up map-side;
elementwise steps are left joins on a dense domain. Where a vector fits ``VECTOR_ROWS``
it is broadcast to the matrix, so that the matrix is never shuffled by the join; beyond
it the join is shuffled. The loop reads a written copy of the matrix, in
parts of like weight by row, and each iteration ends in a written table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from emrecon.operators.transpose import written
from emrecon.sources.scratch import cut, forget

#: Rows up to which a vector is broadcast to the matrix (16 bytes a row).
VECTOR_ROWS = 4_000_000


def _against(vector: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(vector) if rows is not None and rows <= VECTOR_ROWS else vector


def column_sums(a: DataFrame, columns: DataFrame) -> DataFrame:
    """(c, n) for each column of the domain; 0 where it has no element."""
    sums = a.groupBy("c").agg(F.sum(F.col("v").cast("double")).alias("n"))
    return columns.select("c").join(sums, "c", "left").select("c", F.coalesce("n", F.lit(0.0)).alias("n"))


def start_image(norm: DataFrame, y: DataFrame) -> DataFrame:
    """(c, x): all counts over all column sums, the same everywhere; 0 for a zero matrix."""
    totals = y.agg(F.sum(F.col("y").cast("double")).alias("sy")).crossJoin(norm.agg(F.sum("n").alias("sn")))  # one row each
    x = F.coalesce(F.when(F.col("sn") != 0, F.col("sy") / F.when(F.col("sn") != 0, F.col("sn"))), F.lit(0.0))
    return norm.select("c").crossJoin(F.broadcast(totals)).select("c", x.alias("x"))


def forward(a: DataFrame, image: DataFrame, columns: int | None = None) -> DataFrame:
    """(r, fw) for each row with an element."""
    return a.join(_against(image, columns), "c").groupBy("r").agg(F.sum(F.col("v").cast("double") * F.col("x")).alias("fw"))


def correlation(y: DataFrame, fw: DataFrame) -> DataFrame:
    """(r, k): counts over projection, 0 where the projection is 0 or the row is empty."""
    f = F.coalesce("fw", F.lit(0.0))
    return y.join(fw, "r", "left").select("r", F.when(f != 0, F.col("y").cast("double") / F.when(f != 0, f)).otherwise(0.0).alias("k"))


def backward(a: DataFrame, cor: DataFrame, rows: int | None = None) -> DataFrame:
    """(c, u) for each column with an element."""
    return a.join(_against(cor, rows), "r").groupBy("c").agg(F.sum(F.col("v").cast("double") * F.col("k")).alias("u"))


def update(image: DataFrame, upd: DataFrame, norm: DataFrame) -> DataFrame:
    """(c, x): x u / n, and x u where the column sum n is 0."""
    u, n = F.coalesce("u", F.lit(0.0)), F.col("n")
    return image.join(norm, "c").join(upd, "c", "left").select("c", (F.col("x") * F.when(n != 0, u / F.when(n != 0, n)).otherwise(u)).alias("x"))


def image_sum(image: DataFrame) -> DataFrame:
    return image.agg(F.sum("x").alias("image_sum"))


def conservation(y: DataFrame, norm: DataFrame, fw: DataFrame, image: DataFrame) -> DataFrame:
    """One row (weighted, counted), equal after an update: the image weighted by the column
    sums, and the counts of the rows whose projection ``fw`` before it was not 0."""
    weighted = image.join(norm, "c").agg(F.sum(F.col("x") * F.col("n")).alias("weighted"))
    met = y.join(fw.where("fw <> 0").select("r"), "r", "left_semi")
    return weighted.crossJoin(met.agg(F.sum(F.col("y").cast("double")).alias("counted")))  # one row each


def require_counts(y: DataFrame, rows: int) -> DataFrame:
    """``y``, if it has one count for each of a matrix's ``rows`` rows, numbered from 0."""
    n, distinct, least, most = y.agg(F.count(F.lit(1)), F.count_distinct("r"), F.min("r"), F.max("r")).first()
    if n != rows or (n and not (n == distinct == most + 1 and least == 0)):
        raise ValueError(f"{n} counts do not fit a matrix of {rows} rows")
    return y


def step(a: DataFrame, y: DataFrame, image: DataFrame, norm: DataFrame, columns: int | None = None, rows: int | None = None) -> DataFrame:
    """One iteration, not yet executed."""
    return update(image, backward(a, correlation(y, forward(a, image, columns)), rows), norm)


def mlem(a: DataFrame, y: DataFrame, columns: DataFrame, iterations: int, image: DataFrame | None = None, by_column: DataFrame | None = None, after=None, copy: bool = True, metrics: list[dict] | None = None) -> DataFrame:
    """The image after a fixed number of iterations, from ``image`` or the uniform start.

    ``by_column``: a second copy of the matrix, laid out by column, for back projections.
    ``after`` is called with each iteration's number (from 1) and image, which can be read
    until the next iteration has ended; older images are deleted. Without ``copy`` the matrix
    is read as it is, for one that has been laid out already. ``metrics`` gets iter, elapsed,
    forward, backward and image_sum of each iteration: the correlation is written then, which
    parts the times, and the sum is observed while the image is written."""
    if iterations < 0:
        raise ValueError("iterations cannot be negative")
    a = written(a, "r", "c") if copy and iterations else a
    norm = cut(column_sums(a, columns), "norm")
    n_columns, n_rows = norm.count(), y.count()
    given = image is not None
    image = cut(image if given else start_image(norm, y), "image")
    if given and image.count() != n_columns:
        raise ValueError("image and matrix differ in size")
    back = a if by_column is None else by_column
    for i in range(iterations):
        began = half = time.perf_counter()
        cor = correlation(y, forward(a, image, n_columns))
        seen = Observation()
        if metrics is not None:
            cor = cut(cor, "correlation")
            half = time.perf_counter()
        new = update(image, backward(back, cor, n_rows), norm)
        old, image = image, cut(new if metrics is None else new.observe(seen, F.sum("x").alias("image_sum")), "image")
        if metrics is not None:
            ended = time.perf_counter()
            metrics.append({"iter": i + 1, "elapsed": ended - began, "forward": half - began, "backward": ended - half, "image_sum": seen.get["image_sum"] or 0.0})
            forget(cor)
        forget(old)
        if after:
            after(i + 1, image)
    return image
