import pytest

from groundwork.llm import common

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("setting, want", [("16m", 16 << 20), ("-1", -1), ("8388608b", 8388608), ("64", 64), ("2 GB", 2 << 30), ("1kib", 1024)])
def test_size_settings(setting, want):
    assert common.in_bytes(setting) == want


@pytest.mark.parametrize("setting, want", [("16m", "8388608b"), ("4m", "4m")])
def test_batches_are_bounded_whatever_the_unit(spark, setting, want):
    before = spark.conf.get(BYTES)
    try:
        spark.conf.set(BYTES, setting)
        common.bound_batches(spark)
        assert spark.conf.get(BYTES) == want
    finally:
        spark.conf.set(BYTES, before)
