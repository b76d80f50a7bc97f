"""Series as array columns: normalising, cutting, interleaved features, the lambda form of the transform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convseries.functions.prng import let

EPSILON = 2.0**-52


def array_sum(values: Column) -> Column:
    """Sum in array order."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def normalize_series(values: Column) -> Column:
    """Zero mean and unit population deviation. A series whose deviation is within its own rounding noise is only centred."""

    def scaled(x: Column) -> Column:
        moments = F.struct(array_mean(x).alias("mean"), F.greatest(F.abs(F.array_max(x)), F.abs(F.array_min(x))).alias("top"))
        return let(moments, lambda m: let(F.sqrt(array_mean(F.transform(x, lambda v: (v - m["mean"]) * (v - m["mean"])))), lambda sd: F.transform(x, lambda v: (v - m["mean"]) / _divisor(m, sd))))

    return let(values.cast("array<double>"), scaled)


def _divisor(m: Column, sd: Column) -> Column:
    scale = F.greatest(F.abs(m["mean"]), m["top"])
    floor = F.lit(8 * EPSILON) * F.when(scale > 0, scale).otherwise(1.0)
    return F.when(sd > floor, sd).otherwise(1.0)


def normalize_channels(channels: Column) -> Column:
    """normalize_series for every channel."""
    return F.transform(channels, normalize_series)


def truncate_series(values: Column, n: int) -> Column:
    """The first n points."""
    return F.slice(values, 1, n)


def output_length(n: Column, padding: Column, length: Column, dilation: Column) -> Column:
    """Positions of a dilated convolution; none is an error."""
    out = n + 2 * padding - (length - 1) * dilation
    return F.when(out > 0, out).otherwise(F.raise_error(F.lit("the kernel does not fit into the series")).cast("long"))


def conv_max(conv: Column) -> Column:
    return F.array_max(conv)


def ppv(conv: Column) -> Column:
    """Share of strictly positive values."""
    return F.size(F.filter(conv, lambda x: x > 0)) / F.size(conv)


def maxes(features: Column) -> Column:
    """The maxima of an interleaved feature list."""
    return F.transform(F.sequence(F.lit(0), (F.size(features) / 2).cast("int") - 1), lambda i: F.get(features, 2 * i))


def ppvs(features: Column) -> Column:
    """The positive shares of an interleaved feature list."""
    return F.transform(F.sequence(F.lit(0), (F.size(features) / 2).cast("int") - 1), lambda i: F.get(features, 2 * i + 1))


def slice_group(features: Column, g: Column | int, width: int) -> Column:
    """Group g of a long feature list, `width` features each."""
    return F.slice(features, (F.lit(g) if isinstance(g, int) else g) * width + 1, width)


def convolve(values: Column, weights: Column, bias: Column, dilation: Column, padding: Column) -> Column:
    """The dilated convolution of one series with one kernel: bias first, then tap by tap; taps outside the series count as zero."""
    length = F.size(weights)
    places = F.sequence(F.lit(0).cast("long"), output_length(F.size(values), padding, length, dilation).cast("long") - 1)
    taps = F.sequence(F.lit(0), length - 1)

    def at(k: Column) -> Column:
        def tap(acc: Column, j: Column) -> Column:
            place = (k + j * dilation - padding).cast("int")
            x = F.when(place < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(values, place), F.lit(0.0)))
            return acc + F.get(weights, j) * x

        return F.aggregate(taps, bias, tap)

    return F.transform(places, at)


def finite_or_zero(col: Column) -> Column:
    """0.0 for NaN and infinities; null stays."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), 0.0).otherwise(col)


def is_nonfinite(col: Column) -> Column:
    return F.coalesce(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(False))
