import numpy as np
import pytest

from emrecon.jobs import run
from emrecon.sources import csr4
from tests.test_csr4 import CELLS, SCANNER


@pytest.mark.parametrize("options", [[], ["--strategy", "fused"], ["--strategy", "by_column"], ["--states", "S", "--every", "1"]])
def test_files_in_and_out(spark, tmp_path, options):
    csr4.register(spark)
    csr4.write_csr4(spark.createDataFrame(CELLS, "r long, c long, v float"), f"{tmp_path}/a.csr4", 4, 4, SCANNER)
    np.array([3, 4, 7, 10], "<i4").tofile(tmp_path / "y.raw")
    run.main([f"{tmp_path}/a.csr4", f"{tmp_path}/y.raw", "1", f"{tmp_path}/x.raw", "--partitions", "2", *(f"{tmp_path}/s" if o == "S" else o for o in options)])
    assert np.fromfile(tmp_path / "x.raw", "<f4") == pytest.approx([1.75, 11 / 6, 2.0, 0])


def test_metrics_as_csv_and_counts_checked(spark, tmp_path):
    csr4.register(spark)
    csr4.write_csr4(spark.createDataFrame(CELLS, "r long, c long, v float"), f"{tmp_path}/a.csr4", 4, 4, SCANNER)
    np.array([3, 4, 7, 10], "<i4").tofile(tmp_path / "y.raw")
    np.array([3, 4, 7], "<i4").tofile(tmp_path / "short.raw")
    run.main([f"{tmp_path}/a.csr4", f"{tmp_path}/y.raw", "3", f"{tmp_path}/x", "--states", f"{tmp_path}/s", "--metrics", f"{tmp_path}/m"])
    got = spark.read.option("header", True).csv(f"{tmp_path}/m").collect()
    assert sorted(r["iter"] for r in got) == ["1", "2", "3"] and got[0].asDict().keys() >= {"elapsed", "image_sum"}
    with pytest.raises(ValueError):
        run.main([f"{tmp_path}/a.csr4", f"{tmp_path}/short.raw", "1", f"{tmp_path}/x2"])
