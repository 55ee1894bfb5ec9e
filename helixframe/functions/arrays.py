"""Array operators on bins of one window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.numeric import bf16, scale_clamp


def bound(x: Column, body) -> Column:
    """``body`` of ``x``, which is computed once and not again wherever ``body`` names it.

    A lambda's body is evaluated for every element, so an expression written inside one
    that stands for a whole window would be made anew for every bin.
    """
    return F.element_at(F.transform(F.array(x), body), 1)


def rebin(values: Column | str, factor: int) -> Column:
    """Means of ``factor`` consecutive bins, in double, rounded to bf16.  The length has to be a multiple."""
    values = F.col(values) if isinstance(values, str) else values
    if factor == 1:
        return values

    def means(v: Column) -> Column:
        n = F.size(v)
        mean = lambda i: bf16(F.aggregate(F.slice(v, i * factor + 1, factor), F.lit(0.0), lambda a, x: a + x.cast("double")) / factor)
        return F.when(n % factor != 0, F.raise_error(F.lit(f"length is not a multiple of {factor}")).cast("array<float>")).otherwise(F.transform(_indices(F.floor(n / factor)), mean))

    return bound(values, means)


def _indices(n: Column) -> Column:
    """0 .. n-1; empty where n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def split(values: Column | str, size: int) -> Column:
    """Consecutive pieces of ``size`` bins.  The length has to be a multiple."""
    values = F.col(values) if isinstance(values, str) else values
    if size <= 0:
        raise ValueError("size must be positive")

    def pieces(v: Column) -> Column:
        n = F.size(v)
        return F.when(n % size != 0, F.raise_error(F.lit(f"length is not a multiple of {size}")).cast("array<array<float>>")).otherwise(F.transform(_indices(F.floor(n / size)), lambda i: F.slice(v, i * size + 1, size)))

    return bound(values, pieces)


def trim(values: Column | str, target: int, length: int) -> Column:
    """The middle ``target`` of ``length`` bins; an odd rest leans left."""
    return F.slice(values, (length - target) // 2 + 1, target)


def slice_pad(values: Column | str, start: Column, end: Column, pad: Column) -> Column:
    """values[start:end] where positions outside are ``pad``."""
    return bound(F.col(values) if isinstance(values, str) else values, lambda v: _padded(v, start, end, pad))


def _padded(v: Column, start: Column, end: Column, pad: Column) -> Column:
    n = F.size(v)
    left = F.greatest(F.least(-start, end - start), F.lit(0)).cast("int")
    right = F.greatest(F.least(end - n, end - start), F.lit(0)).cast("int")
    middle = F.greatest(end - start - left - right, F.lit(0)).cast("int")
    return F.concat(F.array_repeat(pad, left), F.slice(v, F.greatest(start, F.lit(0)).cast("int") + 1, middle), F.array_repeat(pad, right))


def transform_values(values: Column | str, scale: float | None = None, clamp_max: float | None = None) -> Column:
    """NaN to 0, scale and clamp of every bin."""
    return F.transform(values, lambda x: scale_clamp(x, scale, clamp_max))


def stack_tracks(track_idx: str, values: str) -> Column:
    """Aggregate: the value arrays of one window in track order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(track_idx, values))), lambda s: s[values])


def read_window(values: Column | str, window: int, padding: int, resolution: int, read_resolution: int, shift: Column | None = None) -> Column:
    """The window out of a padded one, moved by ``shift`` base pairs, at ``read_resolution``."""
    at = F.lit(padding) if shift is None else F.lit(padding) + shift
    return rebin(F.slice(values, F.floor(at / resolution).cast("int") + 1, window // resolution), read_resolution // resolution)


def scatter(places: Column, length: int, place: str, value: str) -> Column:
    """An array of ``length`` with the values of structs at their places (each once), 0 elsewhere, in time linear in it."""
    zero = F.lit(0.0).cast("float")

    def fill(s: Column) -> Column:
        gap = lambda x, i: x[place] - F.when(i == 0, F.lit(-1)).otherwise(F.get(s, i - 1)[place]) - 1
        parts = F.flatten(F.transform(s, lambda x, i: F.concat(F.array_repeat(zero, gap(x, i).cast("int")), F.array(x[value]))))
        return F.concat(parts, F.array_repeat(zero, (F.lit(length - 1) - F.element_at(s, -1)[place]).cast("int")))

    return bound(F.sort_array(places), fill)
