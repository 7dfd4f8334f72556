"""A folder that is replaced: the old one stays until the new one is whole, also if it is what is written."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import sinks


def test_replaced_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda: sorted(r.x for r in spark.read.parquet(path).collect())
    put = lambda df: sinks._swapped(df, path, lambda d, p: d.write.parquet(p))
    put(spark.createDataFrame([(1,), (2,)], "x int"))
    assert rows() == [1, 2]
    put(spark.read.parquet(path).withColumn("x", F.col("x") + 10))  # reads what it replaces
    assert rows() == [11, 12]
    with pytest.raises(Exception, match="broken"):
        put(spark.read.parquet(path).withColumn("x", F.when(F.col("x") > 11, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("x"))))
    assert rows() == [11, 12]
    assert sorted(n for n in os.listdir(tmp_path) if ".old-" in n or n == "t") == ["t"]
