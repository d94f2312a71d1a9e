import struct

import numpy as np
import pytest

from pyspark.sql import functions as F

from emrecon.sources import csr4

SCANNER = {"layers": [(1, 1, 1, 1, 1)], "nblocks": 1, "block_gaps": [], "ring_gaps": [], "voxel_size": (1, 1, 1), "grid_dim": (2, 2, 1)}
CELLS = [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 2.0), (3, 0, 1.0), (3, 2, 4.0)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    csr4.register(spark)
    path = str(tmp_path_factory.mktemp("m") / "a.csr4")
    csr4.write_csr4(spark.createDataFrame(CELLS, "r long, c long, v float"), path, 4, 4, SCANNER, (True, False, True))
    return path


def test_layout(written, spark):
    raw = open(written, "rb").read()
    assert len(raw) == 28 + 60 + 4 * 8 + 5 * 8
    assert np.frombuffer(raw[88:120], "<u8").tolist() == [2, 3, 3, 5]
    meta = csr4.metadata(spark, written).first()
    assert (meta.n_rows, meta.n_cols, meta.nnz, tuple(meta.sym)) == (4, 4, 5, (True, False, True))
    assert meta.grid_dim.x == 2 and meta.layers[0].width == 1


@pytest.mark.parametrize("parts", [1, 2, 4, 9])
def test_reads_by_row_ranges(written, spark, parts):
    read = spark.read.format("csr4").option("path", written).option("partitions", parts)
    assert sorted(map(tuple, read.load().collect())) == CELLS
    some = read.option("from", 1).option("to", 3).load()
    assert sorted(map(tuple, some.collect())) == [(1, 1, 2.0)]


def test_small_slices(written):
    reader = csr4.Csr4Reader({"path": written})
    got = [t for b in reader.read(csr4.FileRows(written, 0, 0, 4), rows=1, elements=1) for t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == CELLS


@pytest.mark.parametrize("change", [lambda b: b[:20], lambda b: b"XCSR" + b[4:], lambda b: b[:4] + b"\5" + b[5:], lambda b: b[:-1], lambda b: b[:24] + struct.pack("<I", 59) + b[28:], lambda b: b[:24] + struct.pack("<I", 64) + b[28:] + b"\0" * 4])
def test_damaged_files(written, tmp_path, change):
    p = tmp_path / "bad.csr4"
    p.write_bytes(change(open(written, "rb").read()))
    with pytest.raises(csr4.FormatError):
        csr4.read_header(str(p))


def test_missing_file_and_ragged_vector(tmp_path):
    with pytest.raises(csr4.FormatError):
        csr4.read_header(str(tmp_path / "none"))
    (tmp_path / "v").write_bytes(b"12345")
    with pytest.raises(csr4.FormatError):
        csr4.RawReader({"path": str(tmp_path / "v"), "dtype": "int32"}).partitions()


def test_vector(spark, tmp_path):
    csr4.register(spark)
    path = str(tmp_path / "x.raw")
    csr4.write_vector(spark.range(1000).selectExpr("id AS i", "cast(id * 0.5 AS float) AS x"), path, "float32", 3)
    assert np.array_equal(np.fromfile(path, "<f4"), np.arange(1000, dtype="f4") / 2)
    got = spark.read.format("rawvec").option("path", path).load().orderBy("i").collect()
    assert [r["x"] for r in got] == [i / 2 for i in range(1000)]


def test_ranges_of_like_weight(tmp_path):
    lengths = [1] * 900 + [100] * 100
    described = csr4.scanner_bytes(SCANNER)
    head = csr4.HEADER.pack(csr4.MAGIC, csr4.VERSION, 0, 0, 1000, 8, sum(lengths), len(described))
    path = tmp_path / "skewed.csr4"
    path.write_bytes(head + described + np.cumsum(lengths).astype("<u8").tobytes() + bytes(8 * sum(lengths)))
    ranges = [(p.start, p.end) for p in csr4.Csr4Reader({"path": str(path)}).partitions()]
    assert ranges[0][0] == 0 and ranges[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert max(b - a + sum(lengths[a:b]) for a, b in ranges) <= (1000 + sum(lengths)) / 8 + 101  # a share and a row
    some = csr4.Csr4Reader({"path": str(path), "from": 10, "to": 950}).partitions()
    assert (some[0].start, some[-1].end) == (10, 950)
    assert csr4.Csr4Reader({"path": str(path), "from": 2000}).partitions() == []


@pytest.mark.parametrize("cell", [(-1, 0, 1.0), (4, 0, 1.0), (0, 4, 1.0), (0, -1, 1.0), (None, 0, 1.0), (0, 0, None)])
def test_elements_outside_are_errors(spark, tmp_path, cell):
    with pytest.raises(csr4.FormatError):
        csr4.write_csr4(spark.createDataFrame([*CELLS, cell], "r long, c long, v float"), str(tmp_path / "x"), 4, 4, SCANNER)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("places", [[0, 5], [1, 2], [0, 0], [0, None], [-1, 0]])
def test_gaps_in_vectors_are_errors(spark, tmp_path, places):
    with pytest.raises(csr4.FormatError):
        csr4.write_vector(spark.createDataFrame([(i, 1.0) for i in places], "i long, x float"), str(tmp_path / "x"))


@pytest.mark.parametrize("where, rows", [("r = 1", {1}), ("r > 0 AND r <= 2", {1}), ("r >= 1 AND c = 0", {3}), ("r < 0", set()), ("r > 9", set()), ("r IN (0, 3)", {0, 3}), ("r > 1.5", {3}), ("r IS NULL", set()), ("v > 1 AND r < 3", {1})])
def test_filters_on_rows(written, spark, where, rows):
    got = spark.read.format("csr4").option("path", written).load().where(where).collect()
    frame = spark.createDataFrame(CELLS, "r long, c long, v float").where(where).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, frame)) and {r["r"] for r in got} == rows


def test_filters_prune_ranges(written, spark):
    read = spark.read.format("csr4").option("path", written).option("partitions", 4)
    assert read.load().rdd.getNumPartitions() > 1 and read.load().where("r = 1").rdd.getNumPartitions() == 1


@pytest.fixture(scope="module")
def one_row(spark, tmp_path_factory):
    """All elements of 5 rows lie in row 2."""
    csr4.register(spark)
    path = str(tmp_path_factory.mktemp("one") / "a.csr4")
    csr4.write_csr4(spark.range(4000).selectExpr("2L AS r", "id AS c", "cast(id AS float) AS v"), path, 5, 4000, SCANNER)
    return path


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_slices_cut_rows(spark, one_row, written, parts):
    got = spark.read.format("csr4").option("path", one_row).option("slices", True).option("partitions", parts).load()
    assert got.groupBy("r").agg(F.sum("v"), F.count("v")).collect() == [(2, 4000 * 3999 / 2, 4000)]
    assert got.select(F.spark_partition_id()).distinct().count() == parts  # each task reads its share of the one row
    read = spark.read.format("csr4").option("path", written).option("slices", True).option("partitions", parts)
    assert sorted(map(tuple, read.load().collect())) == CELLS
    assert sorted(map(tuple, read.load().where("r >= 1 AND r < 3").collect())) == [(1, 1, 2.0)]


def test_slices_begin_in_any_row(written):
    reader = csr4.Csr4Reader({"path": written})
    for lo in range(5):
        for hi in range(lo + 1, 6):
            got = [t for b in reader.read(csr4.Slice(written, 0, lo, hi), rows=1, elements=1) for t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            assert got == CELLS[lo:hi]


class Counted:
    """A file that counts the bytes read from places on."""

    def __init__(self, file, limit):
        self.file, self.limit, self.below, self.above = file, limit, 0, 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read_at(self, n, at):
        self.below, self.above = self.below + n * (at < self.limit), self.above + n * (at >= self.limit)
        return self.file.read_at(n, at)


def test_the_index_reads_no_elements(spark, one_row, written, monkeypatch):
    limit, opened, own = csr4.read_header(one_row)["elements_at"], [], csr4._open

    def counted(path):
        f, size = own(path)
        opened.append(Counted(f, limit))
        return opened[-1], size

    monkeypatch.setattr(csr4, "_open", counted)
    reader = csr4.IndexReader({"path": one_row, "partitions": 2})
    rows = [t for p in reader.partitions() for b in reader.read(p, rows=2) for t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert rows == [(0, 0, 0), (1, 0, 0), (2, 0, 4000), (3, 4000, 0), (4, 4000, 0)]
    assert sum(f.above for f in opened) == 0 < sum(f.below for f in opened)
    # planning slices reads a few row ends alone
    opened.clear()
    assert len(csr4.Csr4Reader({"path": one_row, "slices": "true"}).partitions()) == 8
    assert sum(f.above for f in opened) == 0
    got = spark.read.format("csr4index").option("path", written).option("from", 1).load()
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1), (2, 3, 0), (3, 3, 2)]


@pytest.mark.parametrize("parts", [1, 4])
def test_folder_of_files(spark, tmp_path, parts):
    csr4.register(spark)
    path = str(tmp_path / "m.csr4")
    a = spark.createDataFrame(CELLS, "r long, c long, v float")
    csr4.save_csr4(a, path, 4, 4, SCANNER, "xz", parts)
    read = spark.read.format("csr4").option("path", path)
    assert sorted(map(tuple, read.load().collect())) == CELLS
    assert sorted(map(tuple, read.option("slices", True).load().collect())) == CELLS
    assert sorted(map(tuple, read.load().where("r = 3").collect())) == CELLS[3:]
    meta = csr4.metadata(spark, path).first()
    assert (meta.n_rows, meta.n_cols, meta.nnz, tuple(meta.sym)) == (4, 4, 5, (True, False, True))
    # a second write replaces the first, and leaves none of its files
    csr4.save_csr4(a.where("r = 1"), path, 4, 4, SCANNER, parts=parts)
    assert [tuple(r) for r in spark.read.format("csr4").option("path", path).load().collect()] == [(1, 1, 2.0)]
    assert len([f for f in (tmp_path / "m.csr4").iterdir() if not f.name.endswith(".crc")]) == 2
    csr4.save_csr4(a.where("r < 0"), path, 4, 4, SCANNER)
    assert spark.read.format("csr4").option("path", path).load().count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    csr4.register(spark)
    path = tmp_path / "m.csr4"
    bad = spark.createDataFrame([*CELLS, (9, 0, 1.0)], "r long, c long, v float")
    with pytest.raises(Exception, match="outside the matrix"):
        csr4.save_csr4(bad, str(path), 4, 4, SCANNER, parts=3)
    assert not path.exists() or not [*path.iterdir()]
    with pytest.raises(csr4.FormatError):
        csr4.files_of(str(path)) if path.exists() else csr4.read_header(str(path))
    # nor does it harm the matrix that was there
    csr4.save_csr4(bad.where("r < 4"), str(path), 4, 4, SCANNER, parts=3)
    with pytest.raises(Exception, match="outside the matrix"):
        csr4.save_csr4(bad, str(path), 4, 4, SCANNER, parts=3)
    assert sorted(map(tuple, spark.read.format("csr4").option("path", str(path)).load().collect())) == CELLS
