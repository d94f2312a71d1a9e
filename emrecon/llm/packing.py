"""Best-fit packing with certified bin counts.

Documents become id sequences, of which only those above the capacity are cut. Pieces of
full length are sequences by themselves; the others are dealt to partitions by hash and
packed best-fit decreasing. Dual feasible functions give a lower bound on each
partition's number of bins. A partition that meets its bound is certified, and only its
emptiest bin goes on; of one with a gap, or of all while the total is above the bound of
all pieces together, all bins that are not full go on. These bins
meet others in new, larger partitions, each as a whole, and are packed again; an
arrangement is replaced only by one with fewer bins. That ends when one partition held all that
was exchanged, or when a round saves nothing.

Defined cases: null and empty texts hold the separator alone; a text that exceeds the
capacity several times is cut whole; of equally tight bins the one opened or filled last is
taken, and of equal lengths the first in the partition's order goes first; repeated rows are separate documents; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count as count_up

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emrecon.llm.common import buckets_for, cut, documents
from emrecon.llm.vocab import word_bpe

CAPACITY = 2048
#: Id that ends each document.
SEPARATOR = 0
#: Pieces that a partition packs at first, on average; in later rounds up to 64 times as many.
PARTITION = 4000
#: Bits of a bin's number in its partition and of the partition's number, in a sequence's id.
BIN_BITS, PART_BITS = 20, 30
#: Share of bins above the bound of all pieces from which all bins that are not full go on.
SLACK = 0.001

ITEM = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document; ``rid`` tells rows apart that share a doc_id."""
    end = np.array([SEPARATOR], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(path)
        for batch in batches:
            cols: list[list[int]] = [[] for _ in range(6)]
            for rid, doc, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for col, value in zip(cols, (rid, doc, piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        col.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents(docs).withColumn("rid", F.monotonically_increasing_id())
    return rows.mapInArrow(run, ITEM)


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """Bin of each item, best-fit decreasing. Open bins are kept by the room they have;
    the bits of ``rooms`` tell which rooms occur, so the tightest fit is one shift away."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, out = 0, 0, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return out


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(hist: np.ndarray, capacity: int) -> int:
    """From how often each length occurs. No packing has fewer bins: the best of two families of dual feasible functions,
    which map lengths so that whatever fits one bin has images of ``capacity`` together at most.

    The first drops lengths below a threshold t and counts those above capacity - t as
    whole bins (t = 0: the plain sum). The second, for k from 1 on, maps x to the
    floor of (k + 1) x / capacity, in k-ths of a bin, and keeps x where that is exact."""
    hist = hist.astype(np.int64)
    sizes = np.arange(capacity + 1)
    count, total = np.cumsum(hist), np.cumsum(hist * sizes)
    t = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - t]
    middle = total[capacity - t] - total[t - 1]
    best = max(-(-int(total[-1]) // capacity), int((-(-(large * capacity + middle) // capacity)).max(initial=0)))
    for k in range(1, 21):
        x = (k + 1) * sizes
        image = np.where(x % capacity == 0, sizes * k, x // capacity * capacity)  # in parts of k * capacity
        best = max(best, -(-int((hist * image).sum()) // (k * capacity)))
    return best


def _pack(capacity: int, step: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        old = pdf["bin"].to_numpy()
        bins = np.array(best_fit(lengths.tolist(), capacity))
        names = (step << BIN_BITS + PART_BITS) + (int(key[0]) << BIN_BITS) + bins
        if step and len(np.unique(bins)) >= len(np.unique(old)):
            bins, names = np.unique(old, return_inverse=True)[1], old
        n = int(bins.max()) + 1
        fill = np.bincount(bins, weights=lengths, minlength=n)
        gap = n - lower_bound(lengths, capacity)
        goes = fill < capacity if gap else (np.arange(n) == fill.argmin()) & (fill < capacity)
        # places in a bin: largest piece first
        order = np.lexsort((pdf["piece"].to_numpy(), pdf["rid"].to_numpy(), -lengths, bins))
        sorted_bins, before = bins[order], np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, sorted_bins[1:] != sorted_bins[:-1]]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return pdf.assign(bin=names, offset=offset, goes=goes[bins], loose=(fill < capacity)[bins])[["rid", "doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "goes", "loose"]]

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition: int = PARTITION) -> DataFrame:
    """sequence_id and offset for each row of ``tokenize``."""
    pieces = cut(pieces, "pieces")
    whole = pieces.where(F.col("length") == capacity).withColumns({"bin": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    open_rows = pieces.where(F.col("length") < capacity).withColumn("bin", F.xxhash64("rid", "piece"))
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length
    hist = np.zeros(capacity + 1, np.int64)
    hist[[r["length"] for r in lengths]] = [r["n"] for r in lengths]
    bound, closed = bound_of(hist, capacity), int(hist[capacity])
    done, open_bins, count = [whole], None, int(hist[:capacity].sum())
    for step in count_up():  # each round but the last has fewer bins than the one before
        parts = buckets_for(count, partition * 4 ** min(step, 3))
        dealt = open_rows.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(step)), F.lit(parts)))
        packed = cut(dealt.groupBy("part").applyInPandas(_pack(capacity, step), f"{ITEM}, bin long, offset long, goes boolean, loose boolean"), "packed")
        bins = packed.select(F.count_distinct("bin")).first()[0]
        saved = open_bins is None or bins < open_bins
        # partitions may all be certified and yet need more bins than the whole would
        goes = F.col("loose") if closed + bins > bound * (1 + SLACK) + 1 else F.col("goes")
        going = packed.where(goes)
        open_bins = going.select(F.count_distinct("bin")).first()[0]
        if parts == 1 or not saved or open_bins <= 1:
            done.append(packed.drop("goes", "loose"))
            break
        closed += bins - open_bins
        done.append(packed.where(~goes).drop("goes", "loose"))
        open_rows = going.drop("goes", "loose", "offset")
        count = open_rows.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("bin", "sequence_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
