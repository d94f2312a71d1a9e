"""Token counts of flat token files by a separator scan.

A token file is a stream of ids of one width and nothing else: no index, no lengths; an
end-of-document id follows each document. A file is cut into blocks of equal size, each
block is read by itself, wherever documents begin and end, and a vectorised search finds
its separators. What crosses a block's edge is stitched by a prefix scan over the blocks
of the file: ids before the block, documents ended before it, place of the last
separator before it. The scan has two levels, blocks inside spans of ``SPAN`` and spans, so
no task orders the blocks of a large file.

Defined cases: null and empty texts are documents of no tokens; a document may fill many
blocks; ids after the last separator are a document of their own; an empty file or table
gives no rows; repeated rows are documents like any other; other columns are ignored. The
string of the separator's token in a text is plain text here, as only the end of a document
may have its id, where ``bpe`` takes it for that token.
Files are reached by their URI through Arrow's file systems. A task writes a file under
a new name and lists its documents; a file of a task that was lost is listed nowhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emrecon.llm.common import cut, documents, new_path
from emrecon.llm.vocab import byte_ranks

#: End-of-document id of the byte vocabulary, and the ids' width in a file.
END_ID, DTYPE = 50256, "<u2"
#: Bytes of a block.
BLOCK = 1 << 20
#: Blocks of a span of the prefix scan.
SPAN = 4096


def write_files(docs: DataFrame, folder: str, ranks: str) -> DataFrame:
    """Write token files to ``folder``, one a task; give file, ordinal, doc_id of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = byte_ranks(ranks), np.array([END_ID], DTYPE).tobytes()
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, at = f"{uuid.uuid4().hex}.ids", 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                for text in batch.column("text"):
                    out.write(encoding.encode_to_numpy(text.as_py(), disallowed_special=()).astype(DTYPE).tobytes() + end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), batch.column("doc_id")], ["file", "ordinal", "doc_id"])
                at += n

    return cut(documents(docs).mapInArrow(run, "file string, ordinal long, doc_id long"), "listed")


def blocks_of(files: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """file, block, offset, size: the blocks of each file named in ``files``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                size = fs.get_file_info(f"{root}/{name}").size
                for first in range(0, -(-size // block), SPAN):
                    number = np.arange(first, min(first + SPAN, -(-size // block)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(number), pa.string()), pa.array(number, pa.int64()), pa.array(number * block, pa.int64()), pa.array(np.minimum(block, size - number * block), pa.int64())], ["file", "block", "offset", "size"])

    return files.select("file").mapInArrow(run, "file string, block long, offset long, size long")


def count_tokens(files: DataFrame, folder: str, end_id: int = END_ID, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """file, ordinal, n_tokens (without the separator) of each document in the files."""
    if block % np.dtype(dtype).itemsize:
        raise ValueError("a block holds whole ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name, number, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "offset", "size")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(size, offset), dtype)
                ends = np.flatnonzero(ids == end_id)
                cols = [[name], [number], [len(ids)], [len(ends)], [int(ends[-1]) if len(ends) else None], [ends]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "block", "ids", "docs", "last", "ends"])

    spread = blocks_of(files.select("file").distinct(), folder, block).repartition("file", "block")
    scanned = cut(spread.mapInArrow(run, "file string, block long, ids long, docs long, last long, ends array<long>"), "scanned")
    sums = prefix_scan(scanned.select("file", "block", "ids", "docs", "last"))
    parts = scanned.select("file", "block", "ends").join(sums, ["file", "block"])
    rows = parts.select("file", "base", "first", "since", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("since")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("k"), F.lit(1))))
    done = rows.select("file", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("base") + F.col("end") - start - 1).alias("n_tokens"))
    whole = sums.groupBy("file").agg(F.sum("docs").alias("ordinal"), (F.sum("ids") - 1 - F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(-1))).alias("n_tokens"))
    return done.unionByName(whole.where("n_tokens > 0"))


def prefix_scan(blocks: DataFrame) -> DataFrame:
    """``blocks`` (file, block, ids, docs, last) with base and first, the ids and documents
    before a block in its file, and since, the place of the last separator before it (-1:
    none)."""
    blocks = blocks.withColumn("span", F.expr(f"block div {SPAN}"))
    inside = W.partitionBy("file", "span").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("file").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    spans = blocks.groupBy("file", "span").agg(F.sum("ids").alias("all_ids"), F.sum("docs").alias("all_docs"))
    spans = spans.select("file", "span", *(F.coalesce(F.sum(c).over(before), none).alias(f"{c}_before") for c in ("all_ids", "all_docs")))
    rows = blocks.join(spans, ["file", "span"])
    rows = rows.withColumns({to: F.col(f"all_{c}_before") + F.coalesce(F.sum(c).over(inside), none) for to, c in (("base", "ids"), ("first", "docs"))})
    rows = rows.withColumn("at", F.col("base") + F.col("last"))
    ends = rows.groupBy("file", "span").agg(F.max("at").alias("at")).select("file", "span", F.max("at").over(before).alias("earlier"))
    rows = rows.join(ends, ["file", "span"]).withColumn("since", F.coalesce(F.greatest(F.max("at").over(inside), F.col("earlier")), F.lit(-1)))
    return rows.select("file", "block", "ids", "docs", "last", "base", "first", "since")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of all documents, from token files that are written first."""
    folder = new_path(spark, "tokens")
    listed = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return count_tokens(listed, folder).join(listed, ["file", "ordinal"]).select("doc_id", "n_tokens")
