"""The kernel transform: 2 features per kernel (maximum and share of positive values), in three forms.

`conv_features` runs NumPy over Arrow batches with the whole bank in each worker. `conv_features_relational` joins
positions and taps as rows, and `conv_features_hof` uses array lambdas without a shuffle; both are checks of the first.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convseries.functions.series import conv_max, convolve, ppv
from convseries.operators.kernels import LONGEST, check_bank, draw_kernels

#: Doubles that one block of convolutions holds at most; a block stays in a core's cache.
BLOCK = 1 << 17
#: Points of the series that are transformed together.
SERIES_BLOCK = 1 << 14
#: Features of an Arrow batch that leaves a worker (8 MB).
FEATURES = 1 << 20
#: Kernels and positions are filled up to a multiple of these with zeros.
TILE, WIDTH = 8, 64


class DilationGroup:
    """The kernels of one dilation as a matrix: a row for each, with its weights for every channel and tap around its middle, and its bias last. Rows that read the same positions stand together."""

    def __init__(self, dilation: int, kernels: list[tuple[int, tuple]], n: int, channels: int) -> None:
        reach = {k: (kernel[1] - 1) // 2 * dilation for k, kernel in kernels}
        # middles of a kernel: all points where it is padded, else those where it lies in the series
        ordered = sorted(kernels, key=lambda x: (0 if x[1][5] else reach[x[0]], x[0]))
        self.dilation, self.half = dilation, LONGEST // 2
        self.at = np.array([k for k, _ in ordered])
        taps = 2 * self.half + 1
        # rows of zeros fill the last tile of the product, so that a kernel's sums are made in the same way in any bank
        self.weights = np.zeros((-(-len(ordered) // TILE) * TILE, channels * taps + 1))
        margins = []
        for row, (k, (_, length, weights, bias, _, padding, own)) in zip(self.weights, ordered):
            for c, w in zip(own, weights):
                first = c * taps + self.half - (length - 1) // 2
                row[first : first + length] = w
            row[-1] = bias
            margins.append(0 if padding else reach[k])
        if 2 * margins[-1] >= n:
            raise ValueError("the kernel does not fit into the series")
        self.margins = np.array(margins)

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """A row for each channel and tap: the series (series, channels, points), one after another, moved by the tap, zeros outside; the last row is ones. Filled up with zeros to a multiple of WIDTH."""
        n_series, channels, n = x.shape
        taps = 2 * self.half + 1
        width = -(-n_series * n // WIDTH) * WIDTH
        wide = np.zeros((channels * taps + 1, width))
        out = wide[:, : n_series * n].reshape(-1, n_series, n)
        for j in range(taps):
            shift = (j - self.half) * self.dilation
            lo, hi = max(0, -shift), min(n, n - shift)
            if lo < hi:
                for c in range(channels):
                    out[c * taps + j, :, lo:hi] = x[:, c, lo + shift : hi + shift]
        out[-1] = 1.0
        return wide

    def features(self, x: np.ndarray, out: np.ndarray) -> None:
        """Sets the two columns of each kernel in out (series, 2 * kernels): one matrix product, then the largest value and the share of positive ones over each row's positions."""
        n_series, _, n = x.shape
        series = self.shifted(x)
        step = max(1, BLOCK // series.shape[1] // TILE) * TILE
        for a in range(0, len(self.at), step):
            conv = (self.weights[a : a + step] @ series)[:, : n_series * n].reshape(-1, n_series, n)
            margins = self.margins[a : a + step]
            for margin in np.unique(margins):
                lo, hi = np.searchsorted(margins, margin, "left"), np.searchsorted(margins, margin, "right")
                own = conv[lo:hi, :, margin : n - margin]
                at = 2 * self.at[a + lo : a + hi]
                out[:, at] = own.max(axis=2).T
                out[:, at + 1] = (np.count_nonzero(own > 0, axis=2) / (n - 2 * margin)).T


def dilation_groups(kernels: list[tuple], n: int, channels: int = 1) -> list[DilationGroup]:
    """A bank cut by dilation, for series of n points."""
    by_dilation: dict[int, list[tuple[int, tuple]]] = {}
    for k, kernel in enumerate(kernels):
        by_dilation.setdefault(kernel[4], []).append((k, kernel))
    return [DilationGroup(d, own, n, channels) for d, own in by_dilation.items()]


def transform_block(x: np.ndarray, groups: list[DilationGroup]) -> np.ndarray:
    """Interleaved features of series of equal length: x is (series, channels, points)."""
    out = np.empty((len(x), 2 * sum(len(g.at) for g in groups)))
    for group in groups:
        group.features(x, out)
    return out


def _checked(values, n_reference: int | None) -> np.ndarray:
    """A series as (channels, points), or the reason why not."""
    x = np.asarray([np.asarray(c, float) for c in values] if isinstance(values[0], (list, np.ndarray)) else [np.asarray(values, float)])
    n = x.shape[1]
    if n < LONGEST:
        raise ValueError(f"a series of {n} points is shorter than the longest kernel")
    if n_reference is not None and n < n_reference:
        raise ValueError(f"a series of {n} points against n_reference {n_reference} is rejected rather than padded")
    if not np.isfinite(x).all():
        raise ValueError("a series contains NULL values or is not finite")
    return x


def normalized(x: np.ndarray) -> np.ndarray:
    """Zero mean and unit deviation along the last axis; what lies within rounding noise of constant is only centred."""
    mean, sd = x.mean(axis=-1, keepdims=True), x.std(axis=-1, keepdims=True)
    scale = np.maximum(np.abs(mean), np.abs(x).max(axis=-1, keepdims=True))
    return (x - mean) / np.where(sd > 8 * np.finfo(float).eps * np.where(scale > 0, scale, 1.0), sd, 1.0)


@lru_cache(maxsize=4)
def drawn_bank(k: int, seed: int, first: int, n_reference: int, channels: int) -> list[tuple]:
    """The bank of a reference length; a worker draws it once."""
    check_bank(k, n_reference, first, channels)
    return draw_kernels(seed, np.arange(first, first + k), n_reference, channels)


@lru_cache(maxsize=64)
def drawn_groups(k: int, seed: int, first: int, n_reference: int, n: int, channels: int) -> list[DilationGroup]:
    """The bank of a reference length for series of n points."""
    return dilation_groups(drawn_bank(k, seed, first, n_reference, channels), n, channels)


class Transformer:
    """Features of lists of series."""

    def __init__(self, k: int, seed: int, first: int = 0, n_reference: int | None = None, normalize: bool = False):
        self.k, self.seed, self.first, self.n_reference, self.normalize = k, seed, first, n_reference, normalize

    def __call__(self, series) -> list:
        """A feature list for each series, null for null. Series of one shape are one matrix."""
        out: list = [None] * len(series)
        by_shape: dict[tuple, list] = {}
        for i, values in enumerate(series):
            if values is not None:
                x = _checked(values, self.n_reference)
                by_shape.setdefault(x.shape, []).append((i, normalized(x) if self.normalize else x))
        for (channels, n), rows in by_shape.items():
            groups = drawn_groups(self.k, self.seed, self.first, self.n_reference or n, n, channels)
            step = max(1, SERIES_BLOCK // (n * channels))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for (i, _), f in zip(part, transform_block(np.stack([x for _, x in part]), groups)):
                    out[i] = f
        return out


def conv_features(df: DataFrame, values: str, k: int, seed: int = 0, first: int = 0, n_reference: int | None = None, name: str = "features", normalize: bool = False) -> DataFrame:
    """df with the interleaved features of kernels first .. first + k - 1; the column may hold arrays or arrays of channels.

    Without n_reference each row's own length draws the bank, which suits tables of one length only. Null series give
    null; series with nulls, of unequal channels, too short for the kernels or below n_reference are errors. A column of
    df called `name` is replaced. The workers get df's rows, so select what is needed first; what the series column is
    computed from does not matter, nor what becomes of the features, for no expression is moved across the workers. A bank
    takes about 100 bytes per kernel and channel and is drawn once in each task. normalize brings each channel to zero
    mean and unit deviation first.
    """
    check_bank(k, n_reference or LONGEST, first)
    many = dict(df.dtypes)[values].startswith("array<array")
    fields = [f for f in df.schema.fields if f.name != name]
    others = [f.name for f in fields]
    own = Transformer(k, seed, first, n_reference, normalize)
    step = max(1, FEATURES // (2 * k))

    def features(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            found = own(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            known = [f for f in found if f is not None]
            ends = np.cumsum([0 if f is None else len(f) for f in found], dtype=np.int32)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32(), mask=np.array([f is None for f in found] + [False]))
            column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(known) if known else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*others, name])

    series = F.col(f"`{values}`").cast("array<array<double>>" if many else "array<double>")
    rows = df.select(*[F.col(f"`{c}`") for c in others], series.alias("_series"))
    return rows.mapInArrow(features, T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def _sql_function(spark, name: str) -> None:  # noqa: ANN001
    import pandas as pd

    def features(series: pd.Series, k: pd.Series, seed: pd.Series, first: pd.Series, *rest: pd.Series) -> pd.Series:
        out: list = [None] * len(series)
        n_ref = rest[0] if rest else pd.Series([None] * len(series))
        groups: dict[tuple, list[int]] = {}
        for i, args in enumerate(zip(k, seed, first, n_ref)):
            if series.iloc[i] is None or any(pd.isna(a) for a in args[:3]):
                continue
            groups.setdefault((int(args[0]), int(args[1]), int(args[2]), None if pd.isna(args[3]) else int(args[3])), []).append(i)
        for args, rows in groups.items():
            for i, f in zip(rows, Transformer(*args)([series.iloc[i] for i in rows])):
                out[i] = f
        return pd.Series(out)

    features.__annotations__ = {"series": pd.Series, "k": pd.Series, "seed": pd.Series, "first": pd.Series, "rest": pd.Series, "return": pd.Series}
    spark.udf.register(name, F.pandas_udf(features, "array<double>"))


@F.udtf(returnType="kernel_id bigint, length int, bias double, dilation bigint, padding bigint, channel int, j int, weight double")
class KernelBank:
    """A row for each tap of the kernels first .. first + k - 1."""

    def eval(self, seed: int, n_ref: int, k: int, first: int):  # noqa: ANN201
        if None in (seed, n_ref, k, first):
            return
        check_bank(k, n_ref, first)
        for kernel, length, weights, bias, dilation, padding, channels in draw_kernels(seed, np.arange(first, first + k), n_ref):
            for channel, own in zip(channels, weights):
                for j, weight in enumerate(own):
                    yield kernel, length, bias, dilation, padding, channel, j, weight


def register(spark) -> None:  # noqa: ANN001
    """SQL functions conv_features and conv_features_mv: (series, kernels, seed, first[, n_reference]) -> array<double>, and the table function kernel_bank(seed, n_reference, kernels, first), which may be called laterally. One function takes series of one channel and of several, so both names stand for it."""
    for name in ("conv_features", "conv_features_mv"):
        _sql_function(spark, name)
    spark.udtf.register("kernel_bank", KernelBank)


def conv_features_relational(series: DataFrame, bank: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, kernel_id, max, ppv) by joins: series is (id, t, value) with t from 0, bank (kernel_id, j, weight, length, bias, dilation, padding).

    Every kernel meets every series, as the transform demands: there is a row for each position, kernel and series, and a
    column for each of the LONGEST taps. Points are shuffled once, by series; the rows of the product stay where their
    series is. For checks, not for scale.
    """
    points = series.select(F.col(id_col).alias("_id"), F.col("t").cast("int").alias("t"), "value").repartition(F.col("_id")).groupBy("_id", "t").agg(F.sum("value").alias("value"))
    points = points.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("v"))
    n = F.element_at("v", -1)["t"] + 1
    # a point that is missing is null, like one outside
    whole = F.when(F.size("v") == n, F.col("v.value")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.element_at(F.map_from_entries("v"), t)))
    points = points.select("_id", n.alias("n"), whole.alias("x"))
    taps = [F.max(F.when(F.col("j") == j, F.col("weight"))).alias(f"w{j}") for j in range(LONGEST)]
    kernels = bank.groupBy("kernel_id", "length", "bias", "dilation", "padding").agg(*taps)
    last = (F.col("n") + 2 * F.col("padding") - (F.col("length") - 1) * F.col("dilation") - 1).cast("int")
    places = points.crossJoin(F.broadcast(kernels)).withColumn("o", F.explode(F.sequence(-F.col("padding").cast("int"), last - F.col("padding").cast("int"))))
    terms = [F.col(f"w{j}") * F.get("x", F.col("o") + (j * F.col("dilation")).cast("int")) for j in range(LONGEST)]
    conv = F.col("bias") + sum((F.coalesce(term, F.lit(0.0)) for term in terms), F.lit(0.0))
    conv = F.when(F.coalesce(*terms).isNotNull(), conv)  # a position without any point has no value
    conv = places.select("_id", "kernel_id", conv.alias("conv")).where(F.col("conv").isNotNull())
    return conv.groupBy("_id", "kernel_id").agg(F.max("conv").alias("max"), (F.count_if(F.col("conv") > 0) / F.count("*")).alias("ppv")).withColumnRenamed("_id", id_col)


def conv_features_hof(df: DataFrame, bank: DataFrame, values: str = "values", id_col: str = "id") -> DataFrame:
    """(id, kernel_id, max, ppv) by array lambdas: each row meets the broadcast bank (BANK_SCHEMA, one channel) without a shuffle of the series."""
    rows = df.select(id_col, F.col(values).cast("array<double>").alias("_x")).crossJoin(F.broadcast(bank))
    rows = rows.withColumn("_conv", convolve(F.col("_x"), F.get("weights", F.lit(0)), F.col("bias"), F.col("dilation"), F.col("padding")))
    return rows.select(id_col, "kernel_id", conv_max(F.col("_conv")).alias("max"), ppv(F.col("_conv")).alias("ppv"))


def reference_length(df: DataFrame, values: str = "values") -> DataFrame:
    """One row: the shortest series, n_ref."""
    kind = dict(df.dtypes)[values]
    n = F.size(F.get(values, F.lit(0))) if kind.startswith("array<array") else F.size(values)
    return df.agg(F.min(n).cast("long").alias("n_ref"))


def length_bias(features: DataFrame, values: str = "values", feature_col: str = "features") -> DataFrame:
    """Mean maximum and mean positive share by series length."""
    rows = features.select(F.size(values).alias("n"), F.posexplode(feature_col).alias("at", "f"))
    return rows.groupBy("n").agg(F.avg(F.when(F.col("at") % 2 == 0, F.col("f"))).alias("mean_max"), F.avg(F.when(F.col("at") % 2 == 1, F.col("f"))).alias("mean_ppv"))


def validate_series(df: DataFrame, values: str = "values", n_reference: int | None = None) -> DataFrame:
    """df, failing at run time on series with nulls or NaN, too short for the kernels, or below n_reference."""
    x, n = F.col(values), F.size(values)
    bad = F.when(F.exists(x, lambda v: v.isNull() | F.isnan(v)), F.lit("a series contains NULL values or is not finite")).when(n < LONGEST, F.concat(F.lit("a series of "), n, F.lit(" points is shorter than the longest kernel")))
    if n_reference is not None:
        if n_reference < LONGEST:
            raise ValueError(f"n_reference {n_reference} is shorter than the longest kernel")
        bad = bad.when(n < n_reference, F.lit(f"a series below n_reference {n_reference} is rejected rather than padded"))
    return df.withColumn(values, F.when(bad.isNull(), x).otherwise(F.raise_error(bad)))


def series_problem(values, n_reference: int = LONGEST):  # noqa: ANN001, ANN201
    """What validate_series would say, as a column: null for a good series."""
    n = F.size(values)
    return F.when(F.exists(values, lambda v: v.isNull() | F.isnan(v)), F.lit("null inside")).when(n < LONGEST, F.lit("shorter than the longest kernel")).when(n < n_reference, F.lit("below n_reference"))
