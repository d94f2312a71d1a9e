"""Projections that leave the matrix where it is, for vectors of any size.

The matrix is kept twice, bucketed by row and bucketed by column, and vectors are bucketed
alike. A projection joins a vector to the copy that is bucketed by the vector's key, without
an exchange of either, and sums the products up map-side; only partial sums, no more than
one per task and key of the result, are shuffled.

A row or column with more than a part's elements would make one large bucket. The elements
of these lie apart, dealt evenly; there can be no more such keys than the matrix has parts,
so their few vector entries are broadcast to them. They are looked for among the keys of full
hash slots only, and column sums are taken from the copy by column, so that the elements are
exchanged once for each copy and not for any sum before the loop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emrecon.operators import mlem
from emrecon.operators.transpose import IN_PART, parts_for
from emrecon.sources.scratch import bucketed, cut, forget


@dataclass
class Copy:
    """A matrix bucketed by ``key``, its elements in long rows or columns, and their keys."""

    key: str
    plain: DataFrame
    long: DataFrame | None
    long_keys: DataFrame | None
    buckets: int


#: Hash slots of the keys for each bucket: so a slot has far fewer elements than a part, in the mean.
SLOTS = 64


def long_keys(a: DataFrame, key: str, most: int, slots: int) -> DataFrame | None:
    """(``key``) of the keys with more than ``most`` elements, None if there are none. Their
    slots have as many, so keys of other slots need no count of their own."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).alias("slot")
    full = cut(a.groupBy(slot).count().where(F.col("count") > most).select("slot"), "full_slots")
    if full.isEmpty():
        return None
    some = a.select(key, slot).join(F.broadcast(full), "slot", "left_semi")
    keys = cut(some.groupBy(key).count().where(F.col("count") > most).select(key), "long_keys")
    return None if keys.isEmpty() else keys


def copy_by(a: DataFrame, key: str, other: str, buckets: int | None = None, most: int | None = None) -> Copy:
    """``most``: elements of a key above which they lie apart."""
    most, buckets = most or IN_PART, buckets or parts_for(a)
    a = a.select("r", "c", F.col("v").cast("double").alias("v"))
    keys = long_keys(a, key, most, SLOTS * buckets)
    if keys is None:
        return Copy(key, bucketed(a, key, buckets, other), None, None, buckets)
    plain = a.join(F.broadcast(keys), key, "left_anti")
    long = cut(a.join(F.broadcast(keys), key).repartition(buckets, key, other), "long")
    return Copy(key, bucketed(plain.select("r", "c", "v"), key, buckets, other), long.select("r", "c", "v"), keys, buckets)


def product(copy: Copy, vector: DataFrame, value: str, to: str, out: str) -> DataFrame:
    """(``to``, ``out``): sums of the copy's elements times ``vector`` (key, ``value``)."""
    terms = copy.plain.join(vector.hint("merge"), copy.key).select(to, (F.col("v") * F.col(value)).alias("p"))
    if copy.long is not None:
        few = vector.join(F.broadcast(copy.long_keys), copy.key)
        terms = terms.unionByName(copy.long.join(F.broadcast(few), copy.key).select(to, (F.col("v") * F.col(value)).alias("p")))
    return terms.groupBy(to).agg(F.sum("p").alias(out))


def column_sums(by_column: Copy, columns: DataFrame) -> DataFrame:
    """(c, n) for each column of the domain, as ``mlem.column_sums`` gives it."""
    parts = [x.groupBy("c").agg(F.sum("v").alias("n")) for x in (by_column.plain, by_column.long) if x is not None]
    sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])  # no column is in both
    return columns.select("c").join(sums, "c", "left").select("c", F.coalesce("n", F.lit(0.0)).alias("n"))


def forward(by_column: Copy, image: DataFrame) -> DataFrame:
    """(r, fw) for each row with an element; the image is bucketed by c."""
    return product(by_column, image, "x", "r", "fw")


def backward(by_row: Copy, cor: DataFrame) -> DataFrame:
    """(c, u) for each column with an element; the correlation is bucketed by r."""
    return product(by_row, cor, "k", "c", "u")


def mlem_copartitioned(a: DataFrame, y: DataFrame, columns: DataFrame, iterations: int, after=None, buckets: int | None = None, most: int | None = None) -> DataFrame:
    """(c, x) after the iterations, from the uniform start. Of the images and correlations
    on the way only the last are kept."""
    if iterations < 0:
        raise ValueError("iterations cannot be negative")
    buckets = buckets or parts_for(a)
    by_row = copy_by(a, "r", "c", buckets, most)
    by_column = copy_by(a, "c", "r", buckets, most)
    counts = bucketed(y.select("r", F.col("y").cast("double").alias("y")), "r", by_row.buckets)
    norm = bucketed(column_sums(by_column, columns), "c", by_column.buckets)
    image = bucketed(mlem.start_image(norm, y), "c", by_column.buckets)
    for i in range(iterations):
        cor = bucketed(mlem.correlation(counts, forward(by_column, image)), "r", by_row.buckets)
        old, image = image, bucketed(mlem.update(image, backward(by_row, cor), norm), "c", by_column.buckets)
        for done in (old, cor):
            forget(done)
        if after:
            after(i + 1, image)
    return image
