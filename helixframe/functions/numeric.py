"""Value transforms: bf16 rounding, cleaning, scaling.  All are plain expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^45 + 1: subtracting in double leaves the 8 leading bits of a number, rounded to nearest even.
SPLIT = float(2**45 + 1)
#: Largest bf16.
LARGEST = 3.3895313892515355e38


def bf16(x: Column) -> Column:
    """``x`` rounded to bf16, as FLOAT.  NaN and infinities stay; what is beyond the largest bf16 becomes infinite."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), d).when(F.abs(d) >= LARGEST * (1 + 2.0**-9), F.signum(d) * float("inf")).otherwise(d * SPLIT - (d * SPLIT - d)).cast("float")


def nan_to_zero(x: Column) -> Column:
    """NaN as 0; infinities stay."""
    return F.when(F.isnan(x), F.lit(0.0).cast("float")).otherwise(x)


def finite_or_zero(x: Column) -> Column:
    """NaN and infinities as 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def scale_clamp(x: Column, scale: float | None = None, clamp_max: float | None = None) -> Column:
    """NaN as 0; others times ``scale``, then at most ``clamp_max``, all in bf16.  There is no lower clamp."""
    y = x
    if scale is not None:
        y = bf16(y.cast("double") * bf16(F.lit(scale)).cast("double"))
    if clamp_max is not None:
        y = F.least(y, bf16(F.lit(clamp_max)))
    return F.when(F.isnan(x), F.lit(0.0).cast("float")).otherwise(y)


def log1p(x: Column) -> Column:
    return F.ln(x.cast("double") + 1)
