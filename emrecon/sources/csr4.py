"""Binary matrix and vector files as Spark data sources.

``csr4``: a little-endian header (magic, version, symmetry flags, row, column and element
counts, length of the scanner description), the scanner description, the inclusive end of
each row as 64-bit numbers, then (column, value) pairs of 32 bits each. A read is planned
by row ranges of like weight (rows and their elements; a row is never cut) and each task
reads its own bytes; the options ``from`` and ``to`` prune the ranges, and so do filters
that compare ``r`` with numbers. With the option ``slices`` a read is planned by equal
ranges of elements, which may begin and end inside a row: each task finds the row of its
first element by binary search in the stored row ends, and one row with most of the elements
is read by many tasks. ``csr4index``: the stored row ends alone, as (r, begin, cnt); no
element is read. ``rawvec``: values of one type without a header, keyed by their place.

``df.write.format("csr4")`` writes a folder: a matrix file for the rows of each partition,
made by its task, and a manifest that the driver adds at the end, which makes them one
matrix. Readers take a folder as they take a file. If the write fails its files are deleted,
and without a manifest there is no matrix. ``write_csr4`` makes a single file.

Files are opened by URI through Arrow's file systems, in tasks as on the driver."""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Fixed values of the format.
MAGIC, VERSION = b"PCSR", 4
HEADER = struct.Struct("<4sBBHIIQI")
ELEMENT = np.dtype([("c", "<u4"), ("v", "<f4")])
KINDS = {"int32": "int", "float32": "float", "int64": "long", "float64": "double"}
LEAST_SCANNER, MOST_SCANNER = 60, 1000

SCANNER = "layers array<struct<width:float,height:float,depth:float,radius:float,mu:float>>, nblocks long, block_gaps array<float>, ring_gaps array<float>, voxel_size struct<x:float,y:float,z:float>, grid_dim struct<x:long,y:long,z:long>"
META = f"n_rows long, n_cols long, nnz long, sym struct<x:boolean,y:boolean,z:boolean>, {SCANNER}"


class FormatError(ValueError):
    """The file is no file of this format, or is damaged."""


def _system(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _open(path: str):
    fs, own = _system(path)
    info = fs.get_file_info(own)
    if info.type != FileType.File:
        raise FormatError(f"cannot open {path}")
    return fs.open_input_file(own), info.size


def scanner_bytes(s: dict) -> bytes:
    """The scanner description: layers, blocks, gaps inside a block, rings, voxels."""
    out = [struct.pack("<I", len(s["layers"])), *(struct.pack("<5f", *layer) for layer in s["layers"])]
    out.append(struct.pack("<II", s["nblocks"], len(s["block_gaps"]) + 1) + struct.pack(f"<{len(s['block_gaps'])}f", *s["block_gaps"]))
    out.append(struct.pack("<I", len(s["ring_gaps"]) + 1) + struct.pack(f"<{len(s['ring_gaps'])}f", *s["ring_gaps"]))
    return b"".join(out) + struct.pack("<3f3I", *s["voxel_size"], *s["grid_dim"])


def parse_scanner(raw: bytes) -> dict:
    at = 0

    def take(kind: str):
        nonlocal at
        size = struct.calcsize("<" + kind)
        if at + size > len(raw):
            raise FormatError("the scanner description is too short")
        got = struct.unpack_from("<" + kind, raw, at)
        at += size
        return got

    layers = [take("5f") for _ in range(take("I")[0])]
    nblocks, blocksize = take("II")
    block_gaps = take(f"{max(0, blocksize - 1)}f")
    ring_gaps = take(f"{max(0, take('I')[0] - 1)}f")
    voxel_size, grid_dim = take("3f"), take("3I")
    if at != len(raw):
        raise FormatError("the scanner description has another length than the header says")
    return {"layers": layers, "nblocks": nblocks, "block_gaps": list(block_gaps), "ring_gaps": list(ring_gaps), "voxel_size": voxel_size, "grid_dim": grid_dim}


def read_header(path: str) -> dict:
    """All that precedes the row ends, checked against the file's length in 64 bits."""
    f, size = _open(path)
    with f:
        if size < HEADER.size:
            raise FormatError("the file is shorter than a header")
        magic, version, flags, _, rows, cols, nnz, n = HEADER.unpack(f.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise FormatError("wrong magic")
        if version != VERSION:
            raise FormatError(f"version {version} is not supported")
        if n < LEAST_SCANNER or n + HEADER.size > MOST_SCANNER:
            raise FormatError("the scanner description has an impossible length")
        if size < HEADER.size + n + 8 * rows + 8 * nnz:
            raise FormatError("the file is shorter than its header says")
        scanner = parse_scanner(f.read_at(n, HEADER.size))
    return {"n_rows": rows, "n_cols": cols, "nnz": nnz, "sym": tuple(bool(flags & b) for b in (1, 2, 4)), "scanner": scanner, "ends_at": HEADER.size + n, "elements_at": HEADER.size + n + 8 * rows}


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row of dimensions, symmetries and scanner, of a file or a folder."""
    h = files_of(path)[1]
    return spark.createDataFrame([(h["n_rows"], h["n_cols"], h["nnz"], h["sym"], *(h["scanner"][k] for k in ("layers", "nblocks", "block_gaps", "ring_gaps", "voxel_size", "grid_dim")))], META)


class RowRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Slice(InputPartition):
    """Elements ``start`` to ``end`` of a file, whose first row is ``base`` of the matrix."""

    def __init__(self, path: str, base: int, start: int, end: int):
        self.path, self.base, self.start, self.end = path, base, start, end


class FileRows(InputPartition):
    """Rows ``start`` to ``end`` of a file, whose first row is ``base`` of the matrix."""

    def __init__(self, path: str, base: int, start: int, end: int):
        self.path, self.base, self.start, self.end = path, base, start, end


MANIFEST = "manifest.json"


def files_of(path: str) -> tuple[list[dict], dict]:
    """Files of a matrix, each with ``path`` and ``base``, and the header of the whole."""
    fs, own = _system(path)
    if fs.get_file_info(own).type != FileType.Directory:
        return [{"path": path, "base": 0}], read_header(path)
    if fs.get_file_info(f"{own}/{MANIFEST}").type != FileType.File:
        raise FormatError(f"{path} has no manifest: the write was not completed")
    with fs.open_input_file(f"{own}/{MANIFEST}") as f:
        m = json.loads(f.read())
    return [{"path": f"{path}/{p['name']}", "base": p["base"]} for p in m["parts"]], m | {"sym": tuple(m["sym"]), "scanner": parse_scanner(scanner_bytes(m["scanner"]))}


def _end(f, h: dict, row: int) -> int:
    """Elements through a row, the stored row end; 0 before the first."""
    return struct.unpack("<Q", f.read_at(8, h["ends_at"] + 8 * row))[0] if row >= 0 else 0


class Csr4Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", 8))
        self.lo, self.hi = int(options.get("from", 0)), int(options.get("to", 1 << 62))
        self.slices = str(options.get("slices", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ``r`` narrow the row range; all other filters are left to Spark."""
        for f in filters:
            ours = getattr(f, "attribute", None) == ("r",) and isinstance(getattr(f, "value", None), int)
            if ours and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            if ours and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.hi = min(self.hi, f.value + (not isinstance(f, LessThan)))
            if not (ours and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo)):
                yield f

    def partitions(self) -> list[InputPartition]:
        """Equal shares of what there is to read, over all files of the matrix."""
        plans = []
        for part in files_of(self.path)[0]:
            h = read_header(part["path"])
            lo, hi = max(0, self.lo - part["base"]), min(h["n_rows"], self.hi - part["base"])
            if hi > lo:
                plans.append((part, h, lo, hi))
        out = []
        for part, h, lo, hi in plans:
            f, _ = _open(part["path"])
            with f:
                parts = -(-self.parts // len(plans))
                out += [kind(part["path"], part["base"], a, b) for kind, a, b in self.cuts(f, h, lo, hi, parts) if b > a]
        return out

    def cuts(self, f, h: dict, lo: int, hi: int, parts: int) -> list[tuple]:
        if self.slices:
            first, last = _end(f, h, lo - 1), _end(f, h, hi - 1)
            bounds = [first + (last - first) * k // parts for k in range(parts + 1)]
            return [(Slice, a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        # equal shares of rows and elements, found by bisection in the stored row ends
        weight = lambda row: row + _end(f, h, row - 1)
        first, all_, parts = weight(lo), weight(hi) - weight(lo), min(parts, hi - lo)
        inner = [lo + bisect_left(range(lo, hi), first + all_ * k // parts, key=weight) for k in range(1, parts)]
        return [(FileRows, a, b) for a, b in zip([lo, *inner], [*inner, hi], strict=True)]

    def read(self, partition: FileRows | Slice | None, rows: int = 1 << 16, elements: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where no range is left
            return
        h = read_header(partition.path)
        f, _ = _open(partition.path)
        with f:
            row, end, first, last = partition.start, partition.end, 0, h["nnz"]
            if isinstance(partition, Slice):
                first, last = partition.start, partition.end
                row = bisect_right(range(h["n_rows"]), first, key=lambda r: _end(f, h, r))
                end = h["n_rows"]
            for start in range(row, end, rows):
                to_row = min(end, start + rows)
                before = max(0, start - 1)
                ends = np.frombuffer(f.read_at(8 * (to_row - before), h["ends_at"] + 8 * before), "<u8").astype(np.int64)
                ends = np.r_[0, ends] if start == 0 else ends
                for at in range(max(first, int(ends[0])), min(last, int(ends[-1])), elements):
                    to = min(last, int(ends[-1]), at + elements)
                    e = np.frombuffer(f.read_at(8 * (to - at), h["elements_at"] + 8 * at), ELEMENT)
                    r = partition.base + start + np.searchsorted(ends, np.arange(at, to), side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(e["c"].astype(np.int64)), pa.array(e["v"])], ["r", "c", "v"])
                if ends[-1] >= last:
                    return


class IndexReader(Csr4Reader):
    """The stored row ends of a matrix, in equal ranges of rows; elements are not read."""

    def cuts(self, f, h: dict, lo: int, hi: int, parts: int) -> list[tuple]:
        bounds = [lo + (hi - lo) * k // parts for k in range(parts + 1)]
        return [(FileRows, a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def partitions(self) -> list[InputPartition]:
        """Rows that no file has are empty; the first element of a file follows those before."""
        files, whole = files_of(self.path)
        if len(files) > 1 or files and files[0]["base"]:
            raise FormatError("the index of a matrix in several files is not one: sum up its elements")
        return super().partitions() if whole["n_rows"] else []

    def read(self, partition: FileRows | None, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        h = read_header(partition.path)
        f, _ = _open(partition.path)
        with f:
            for start in range(partition.start, partition.end, rows):
                to = min(partition.end, start + rows)
                before = max(0, start - 1)
                ends = np.frombuffer(f.read_at(8 * (to - before), h["ends_at"] + 8 * before), "<u8").astype(np.int64)
                ends = np.r_[0, ends] if start == 0 else ends
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, to), pa.int64()), pa.array(ends[:-1]), pa.array(np.diff(ends))], ["r", "begin", "cnt"])


class Part(WriterCommitMessage):
    def __init__(self, name: str, base: int, n_rows: int, nnz: int, n_cols: int):
        self.name, self.base, self.n_rows, self.nnz, self.n_cols = name, base, n_rows, nnz, n_cols


class Csr4Writer(DataSourceArrowWriter):
    """One matrix file for each partition of rows in order of r, and a manifest. A task
    writes its elements as they come and keeps the number of elements of each of its rows."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.n_rows, self.n_cols = int(options["rows"]), int(options["columns"])
        self.scanner = json.loads(options["scanner"])
        self.sym = [x in str(options.get("symmetric", "")) for x in "xyz"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, own = _system(self.path)
        fs.create_dir(own, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        first, last, counts, nnz = None, -1, [], 0
        body = f"{own}/_{name}.body"
        with fs.open_output_stream(body) as out:
            for batch in batches:
                r = batch.column("r").to_numpy(zero_copy_only=False)
                c, v = batch.column("c"), batch.column("v")
                if not len(r):
                    continue
                if c.null_count or v.null_count or r.min() < 0 or r.max() >= self.n_rows:
                    raise FormatError("elements lie outside the matrix or have no value")
                c = c.to_numpy()
                if c.min() < 0 or c.max() >= self.n_cols:
                    raise FormatError("elements lie outside the matrix or have no value")
                if (np.diff(r) < 0).any() or r[0] < last:
                    raise FormatError("a partition's elements are in order of r")
                first = int(r[0]) if first is None else first
                last = int(r[-1])
                counts.append(np.unique(r, return_counts=True))
                pairs = np.empty(len(r), ELEMENT)
                pairs["c"], pairs["v"] = c, v.to_numpy().astype("<f4")
                out.write(pairs.tobytes())
                nnz += len(r)
        rows = 0 if first is None else last - first + 1
        if rows:
            own_rows = np.zeros(rows, np.int64)
            for ids, n in counts:
                own_rows[ids.astype(np.int64) - first] += n
            described = scanner_bytes(self.scanner)
            with fs.open_output_stream(f"{own}/{name}") as out:
                out.write(HEADER.pack(MAGIC, VERSION, sum(b for b, s in zip((1, 2, 4), self.sym, strict=True) if s), 0, rows, self.n_cols, nnz, len(described)) + described)
                out.write(np.cumsum(own_rows).astype("<u8").tobytes())
                with fs.open_input_stream(body) as f:
                    while block := f.read(1 << 24):
                        out.write(block)
        fs.delete_file(body)
        return Part(name, first or 0, rows, nnz, self.n_cols)

    def commit(self, messages: list[Part | None]) -> None:
        fs, own = _system(self.path)
        fs.create_dir(own, recursive=True)
        kept = sorted((m for m in messages if m and m.n_rows), key=lambda m: m.base)
        manifest = {"n_rows": self.n_rows, "n_cols": self.n_cols, "nnz": sum(m.nnz for m in kept), "sym": self.sym, "scanner": self.scanner, "parts": [{"name": m.name, "base": m.base, "n_rows": m.n_rows, "nnz": m.nnz} for m in kept]}
        with fs.open_output_stream(f"{own}/_{MANIFEST}") as out:
            out.write(json.dumps(manifest).encode())
        fs.move(f"{own}/_{MANIFEST}", f"{own}/{MANIFEST}")
        # files of tries that did not count, or of a matrix that this one replaces
        self._sweep({m.name for m in kept} | {MANIFEST})

    def abort(self, messages: list[Part | None]) -> None:
        self._sweep({MANIFEST} | self._old())

    def _old(self) -> set[str]:
        """Files of a complete matrix that was there before."""
        try:
            return {f["path"].rpartition("/")[2] for f in files_of(self.path)[0]}
        except FormatError:
            return set()

    def _sweep(self, keep: set[str]) -> None:
        fs, own = _system(self.path)
        for info in fs.get_file_info(FileSelector(own, allow_not_found=True)):
            if info.base_name not in keep:
                fs.delete_file(info.path)


class Csr4(DataSource):
    """Options to read: path, partitions, from, to (half-open row range), slices (true: by
    elements). To write: path, rows, columns, scanner (JSON), symmetric (of x, y, z)."""

    @classmethod
    def name(cls) -> str:
        return "csr4"

    def schema(self) -> str:
        return "r long, c long, v float"

    def reader(self, schema) -> DataSourceReader:
        return Csr4Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Csr4Writer(self.options, overwrite)


class Csr4Index(DataSource):
    """Options: path (a file), partitions, from, to (half-open row range)."""

    @classmethod
    def name(cls) -> str:
        return "csr4index"

    def schema(self) -> str:
        return "r long, begin long, cnt long"

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dtype, self.parts = options["path"], np.dtype(options.get("dtype", "float32")).newbyteorder("<"), int(options.get("partitions", 8))

    def partitions(self) -> list[InputPartition]:
        f, size = _open(self.path)
        f.close()
        if size % self.dtype.itemsize:
            raise FormatError("the length is not a multiple of the value's size")
        bounds = np.linspace(0, size // self.dtype.itemsize, self.parts + 1).astype(int)
        return [RowRange(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]

    def read(self, partition: RowRange | None, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        f, _ = _open(self.path)
        with f:
            for at in range(partition.start, partition.end, rows):
                to = min(partition.end, at + rows)
                values = np.frombuffer(f.read_at(self.dtype.itemsize * (to - at), self.dtype.itemsize * at), self.dtype)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, to), pa.int64()), pa.array(values.astype(self.dtype.newbyteorder("=")))], ["i", "x"])


class RawVector(DataSource):
    """Options: path, dtype (int32, float32, int64, float64), partitions."""

    @classmethod
    def name(cls) -> str:
        return "rawvec"

    def schema(self) -> str:
        return f"i long, x {KINDS[self.options.get('dtype', 'float32')]}"

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known, and let Spark hand filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Csr4, Csr4Index, RawVector):
        spark.dataSource.register(source)


def _commit(parts: DataFrame, path: str, heads: list[bytes]) -> None:
    """Join written parts (order, name) to one file: under another name, then renamed."""
    fs, own = _system(path)
    with fs.open_output_stream(f"{own}.tmp") as out:
        for head in heads:
            out.write(head)
        for row in parts.orderBy("order").toLocalIterator():  # names of files, one at a time
            with fs.open_input_stream(f"{own}.parts/{row['name']}") as part:
                while block := part.read(1 << 24):
                    out.write(block)
    fs.move(f"{own}.tmp", own)
    fs.delete_dir(f"{own}.parts")


def _write_parts(df: DataFrame, path: str, to_bytes) -> DataFrame:
    """One file for each partition of ``df``, whose batches ``to_bytes`` turns to bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, own = _system(path)
        fs.create_dir(f"{own}.parts", recursive=True)
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{own}.parts/{name}") as out:
            for batch in batches:
                out.write(to_bytes(batch))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name])], ["order", "name"])

    done = df.mapInArrow(run, "order long, name string").persist()
    done.count()
    return done


def save_csr4(a: DataFrame, path: str, n_rows: int, n_cols: int, scanner: dict, sym: str = "", parts: int = 8, mode: str = "overwrite") -> None:
    """(r, c, v) as a folder of matrix files, by tasks alone. Elements of a row are in order
    of columns; a row with many elements may be parted among files."""
    rows = a.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("float").alias("v"))
    rows = rows.repartitionByRange(parts, "r", "c").sortWithinPartitions("r", "c", "v")
    rows.write.format("csr4").mode(mode).option("path", path).option("rows", n_rows).option("columns", n_cols).option("scanner", json.dumps(scanner)).option("symmetric", sym).save()


def write_vector(df: DataFrame, path: str, dtype: str = "float32", parts: int = 8) -> None:
    """(i, x), a row for each i from 0 on, as a raw file in order of i."""
    n, distinct, least, most = df.agg(F.count(F.lit(1)), F.count_distinct("i"), F.min("i"), F.max("i")).first()
    if n and not (n == distinct == most + 1 and least == 0):
        raise FormatError("a vector has one value for each place from 0 on")
    kind = np.dtype(dtype).newbyteorder("<")
    rows = df.select(F.col("i").cast("long").alias("i"), "x").repartitionByRange(parts, "i").sortWithinPartitions("i")
    written = _write_parts(rows, path, lambda b: b.column("x").to_numpy(zero_copy_only=False).astype(kind).tobytes())
    _commit(written, path, [])
    written.unpersist()


def write_csr4(a: DataFrame, path: str, n_rows: int, n_cols: int, scanner: dict, sym: tuple[bool, bool, bool] = (False, False, False), parts: int = 8) -> None:
    """(r, c, v) as a matrix file; elements of a row in order of columns. Row ends are a
    raw vector of their own first, so neither they nor the elements meet in one place."""
    from emrecon.operators.partitioning import row_lengths, running

    inside = F.col("r").between(0, n_rows - 1) & F.col("c").between(0, n_cols - 1) & F.col("v").isNotNull()
    nnz, good = a.agg(F.count(F.lit(1)), F.count(F.when(inside, 1))).first()
    if nnz != good:
        raise FormatError(f"{nnz - good} elements lie outside the matrix or have no value")
    domain = a.sparkSession.range(n_rows).select(F.col("id").alias("r"))
    ends = running(row_lengths(a, domain), "r", "cnt", out="x").select(F.col("r").alias("i"), "x")
    ends = ends.repartitionByRange(parts, "i").sortWithinPartitions("i")
    ends_path, body_path = f"{path}.ends", f"{path}.body"
    _commit(_write_parts(ends, ends_path, lambda b: b.column("x").to_numpy().astype("<u8").tobytes()), ends_path, [])
    rows = a.select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("float").alias("v")).repartitionByRange(parts, "r").sortWithinPartitions("r", "c", "v")

    def pairs(b: pa.RecordBatch) -> bytes:
        out = np.empty(b.num_rows, ELEMENT)
        out["c"], out["v"] = b.column("c").to_numpy(), b.column("v").to_numpy()
        return out.tobytes()

    _commit(_write_parts(rows, body_path, pairs), body_path, [])
    described = scanner_bytes(scanner)
    head = HEADER.pack(MAGIC, VERSION, sum(b for b, s in zip((1, 2, 4), sym, strict=True) if s), 0, n_rows, n_cols, nnz, len(described))
    fs, own = _system(path)
    with fs.open_output_stream(f"{own}.tmp") as out:
        out.write(head + described)
        for part in (f"{own}.ends", f"{own}.body"):
            with fs.open_input_stream(part) as f:
                while block := f.read(1 << 24):
                    out.write(block)
            fs.delete_file(part)
    fs.move(f"{own}.tmp", own)
