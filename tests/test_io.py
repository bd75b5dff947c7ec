import pytest

from lodestream.operators.table import KernelError
from lodestream.sources import io


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k long, v string, part string")
    io.write(df, f"{tmp_path}/out", format, partition_by=("part",))
    got = io.read(spark, f"{tmp_path}/out", format, "k long, v string, part string")
    assert sorted(map(tuple, got.select("k", "v", "part").collect())) == [(1, "a", "x"), (2, None, "y")]


def test_formats_are_explicit(spark, tmp_path):
    with pytest.raises(KernelError):
        io.read(spark, str(tmp_path), "xls")
    with pytest.raises(KernelError):
        io.read(spark, str(tmp_path), "csv")


def test_convert(spark, tmp_path):
    io.write(spark.range(5), f"{tmp_path}/a", "json")
    io.convert(spark, f"{tmp_path}/a", "json", f"{tmp_path}/b", "parquet", "id long")
    assert io.read(spark, f"{tmp_path}/b", "parquet").count() == 5
