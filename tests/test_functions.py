import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import arrays, nucleotide
from helixframe.functions.numeric import bf16, finite_or_zero, scale_clamp


def reference_bf16(x):
    bits = np.frombuffer(np.float32(x).tobytes(), np.uint32)[0].astype(np.uint64)
    return np.frombuffer(np.uint32((bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000).tobytes(), np.float32)[0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-(2.0**100), 2.0**100, width=32, allow_subnormal=False), min_size=50, max_size=200))
def test_bf16_rounds_to_even(spark, xs):
    xs = [x for x in xs if x == 0 or abs(x) > 1e-37]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(bf16(F.col("x"))).collect()]
    assert got == [float(reference_bf16(x)) for x in xs]


def test_special_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (-3.0,), (5.0,)], "x float")
    assert [r[0] for r in rows.select(scale_clamp(F.col("x"), 2.0, 4.0)).collect()] == [0.0, 4.0, -6.0, 4.0]
    assert [r[0] for r in rows.select(finite_or_zero(F.col("x"))).collect()] == [0.0, 0.0, -3.0, 5.0]


def test_arrays(spark):
    rows = spark.createDataFrame([([float(i) for i in range(1, 7)],), ([float(i) for i in range(7, 13)],)], "v array<float>")
    assert [r[0] for r in rows.select(arrays.rebin("v", 2)).collect()] == [[1.5, 3.5, 5.5], [7.5, 9.5, 11.5]]
    assert rows.select(arrays.split("v", 3)).first()[0] == [[1, 2, 3], [4, 5, 6]]
    assert rows.select(arrays.trim("v", 3, 6)).first()[0] == [2, 3, 4]
    pad = rows.select(arrays.slice_pad("v", F.lit(-2), F.lit(3), F.lit(0.0).cast("float")), arrays.slice_pad("v", F.lit(4), F.lit(9), F.lit(0.0).cast("float")), arrays.slice_pad("v", F.lit(-5), F.lit(-2), F.lit(9.0).cast("float"))).first()
    assert list(pad) == [[0, 0, 1, 2, 3], [5, 6, 0, 0, 0], [9, 9, 9]]
    with pytest.raises(Exception, match="multiple"):
        rows.select(arrays.rebin("v", 4)).collect()


def test_nucleotides(spark):
    rows = spark.createDataFrame([("ACgtN",)], "s string")
    assert rows.select(nucleotide.encode("s")).first()[0] == "01234"
    assert rows.select(nucleotide.decode(nucleotide.encode("s"))).first()[0] == "ACGTN"
    assert rows.select(nucleotide.code_array(nucleotide.encode("s"))).first()[0] == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="not a nucleotide"):
        spark.createDataFrame([("ACR",)], "s string").select(nucleotide.encode("s")).collect()


def test_nan_is_zero_whatever_the_clamp(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,)], "x float")
    assert [r[0] for r in rows.select(scale_clamp(F.col("x"), 2.0, -4.0)).collect()] == [0.0, -4.0]
