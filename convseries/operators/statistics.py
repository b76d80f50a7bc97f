"""Per-series statistics, feature families and their selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convseries.functions.prng import let
from convseries.functions.series import array_mean, array_sum, finite_or_zero, is_nonfinite
from convseries.functions.stats import binom_sf
from convseries.operators.evaluate import benjamini_hochberg
from convseries.operators.ranking import small, with_median

#: What series_statistics makes.
STATISTICS = ("fft_coefficient_1_abs", "fft_coefficient_5_abs", "fft_coefficient_6_abs", "number_peaks", "permutation_entropy", "binned_entropy", "sample_entropy", "longest_strike_above_mean", "quantile_q10", "quantile_q50", "quantile_q90")


def _indices(x: Column) -> Column:
    return F.sequence(F.lit(0), F.size(x) - 1)


def fft_abs(x: Column, k: int) -> Column:
    """Magnitude of Fourier coefficient k; null where the series is too short to have it."""
    angle = lambda i: F.lit(-2 * math.pi * k) * i / F.size(x)
    re = array_sum(F.transform(x, lambda v, i: v * F.cos(angle(i))))
    im = array_sum(F.transform(x, lambda v, i: v * F.sin(angle(i))))
    return F.when(F.floor(F.size(x) / 2) + 1 > k, F.sqrt(re * re + im * im))


def number_peaks(x: Column, support: int = 1) -> Column:
    """Points that are larger than their `support` neighbours on both sides."""
    def is_peak(i: Column) -> Column:
        ok = (i >= support) & (i < F.size(x) - support)
        for d in range(1, support + 1):
            ok = ok & (F.get(x, i) > F.get(x, i - d)) & (F.get(x, i) > F.get(x, i + d))
        return F.coalesce(ok, F.lit(False))

    return F.size(F.filter(_indices(x), is_peak))


def longest_strike_above_mean(x: Column) -> Column:
    """The longest run of points above the series' mean."""
    def runs(args: Column) -> Column:
        zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(acc: Column, v: Column) -> Column:
            run = F.when(v > args["m"], acc["run"] + 1).otherwise(0)
            return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        return F.aggregate(args["x"], zero, step, lambda acc: acc["best"])

    return let(F.struct(x.alias("x"), array_mean(x).alias("m")), runs)


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between the sorted points."""
    def at(s: Column) -> Column:
        place = F.lit(q) * (F.size(s) - 1)
        lo = F.floor(place).cast("int")
        a, b = F.get(s, lo), F.coalesce(F.get(s, lo + 1), F.get(s, lo))
        return a + (b - a) * (place - lo)

    return let(F.sort_array(x), at)


def _entropy(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, (c / total) * F.log(c / total)).otherwise(0.0))


def binned_entropy(x: Column, bins: int = 10) -> Column:
    """Entropy of the histogram with equally wide bins from minimum to maximum."""
    def counted(s: Column) -> Column:
        width = (s["hi"] - s["lo"]) / bins
        cell = F.transform(s["x"], lambda v: F.when(width > 0, F.least(F.lit(bins - 1), F.floor((v - s["lo"]) / width).cast("int"))).otherwise(0))
        return let(cell, lambda c: _entropy(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(c, lambda v: v == b)))))

    return let(F.struct(x.alias("x"), F.array_min(x).alias("lo"), F.array_max(x).alias("hi")), counted)


def permutation_entropy(x: Column) -> Column:
    """Entropy of the order patterns of three neighbours (ties keep their order)."""
    at = lambda i, d: F.get(x, i + d)
    code = lambda i: (at(i, 0) > at(i, 1)).cast("int") * 4 + (at(i, 0) > at(i, 2)).cast("int") * 2 + (at(i, 1) > at(i, 2)).cast("int")
    codes = F.when(F.size(x) >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 3, F.lit(0))), code))
    return let(codes, lambda c: _entropy(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter(c, lambda v: v == b)))))


#: Points of a leaf of the counting tree, and boxes that are looked at a time.
LEAF, FRONTIER = 8, 1 << 18


def near_pairs(t: np.ndarray, tol: float) -> tuple[int, int]:
    """Pairs of rows of t whose coordinates all differ by at most tol, and how many boxes and rows were looked at for that.

    Rows are halved by the median of one coordinate after the other; a box of rows that lies within tol of a row as a whole is
    counted, one that is farther in some coordinate is left out, others are opened. With k coordinates about n^(2 - 1/k)
    boxes are opened, not n^2 / 2 pairs compared."""
    n, k = t.shape
    depth = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    rows = np.full((LEAF << depth, k), np.inf)
    rows[:n] = t
    for level in range(depth):
        parts = rows.reshape(1 << level, -1, k)
        rows = np.take_along_axis(parts, np.argsort(parts[:, :, level % k], axis=1, kind="stable")[:, :, None], axis=1)
    leaves = rows.reshape(-1, LEAF, k)
    filled = np.isfinite(leaves[:, :, 0])
    low, high, size = [leaves.min(axis=1)], [np.where(np.isfinite(leaves), leaves, -np.inf).max(axis=1)], [filled.sum(axis=1)]
    for _ in range(depth):
        low, high, size = [np.minimum(low[0][::2], low[0][1::2]), *low], [np.maximum(high[0][::2], high[0][1::2]), *high], [size[0][::2] + size[0][1::2], *size]
    total = looked = 0
    waiting = [(0, part, np.zeros(len(part), np.int64)) for part in np.array_split(np.arange(n), max(1, n >> 12))]
    while waiting:
        level, row, box = waiting.pop()
        if len(row) > FRONTIER:
            waiting += [(level, r, b) for r, b in zip(np.array_split(row, 2), np.array_split(box, 2))]
            continue
        looked += len(row)
        with np.errstate(invalid="ignore"):
            below, above = low[level][box] - t[row], t[row] - high[level][box]
            meets = (size[level][box] > 0) & (below <= tol).all(axis=1) & (above <= tol).all(axis=1)
            inside = meets & (np.abs(below) <= tol).all(axis=1) & (np.abs(above) <= tol).all(axis=1)
        total += int(size[level][box[inside]].sum())
        row, box = row[meets & ~inside], box[meets & ~inside]
        if level < depth:
            if len(row):
                waiting.append((level + 1, np.concatenate([row, row]), np.concatenate([2 * box, 2 * box + 1])))
            continue
        looked += LEAF * len(row)
        total += int((np.abs(leaves[box] - t[row][:, None, :]) <= tol).all(axis=2).sum())
    return (total - n) // 2, looked


def sample_entropy_of(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-log of the share of matching templates of m points that still match with one more; infinite or NaN where none do, NaN for series that are not finite."""
    x = np.asarray(x, float)
    n, tol = len(x), r * x.std()
    if n <= m + 1 or not np.isfinite(x).all():
        return float("nan")
    b, a = (near_pairs(np.lib.stride_tricks.sliding_window_view(x, k)[: n - m], tol)[0] for k in (m, m + 1))
    return float("nan") if b == 0 else float("inf") if a == 0 else -math.log(a / b)


def series_statistics(df: DataFrame, values: str = "values") -> DataFrame:
    """df plus the columns STATISTICS; not-finite values are kept, see finite_guard."""
    x = F.col(values).cast("array<double>")

    @F.pandas_udf("double")
    def sample_entropy(column):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if v is None else sample_entropy_of(v) for v in column], dtype="float64")

    found = {f"fft_coefficient_{k}_abs": fft_abs(x, k) for k in (1, 5, 6)}
    found |= {"number_peaks": number_peaks(x).cast("double"), "permutation_entropy": permutation_entropy(x), "binned_entropy": binned_entropy(x), "longest_strike_above_mean": longest_strike_above_mean(x).cast("double")}
    found |= {f"quantile_q{round(100 * q)}": quantile(x, q) for q in (0.1, 0.5, 0.9)}
    return df.withColumns(found).withColumn("sample_entropy", sample_entropy(x))


def finite_guard(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with 0.0 for what is not finite in the columns, plus nonfinite, how many there were in the row."""
    bad = F.lit(0)
    for c in columns:
        bad = bad + is_nonfinite(F.col(c)).cast("int")
    return df.withColumn("nonfinite", bad).withColumns({c: F.coalesce(finite_or_zero(F.col(c)), F.lit(0.0)) for c in columns})


def nonfinite_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: not-finite values of all columns."""
    return df.agg(F.sum(sum((is_nonfinite(F.col(c)).cast("long") for c in columns), F.lit(0))).alias("nonfinite"))


def combine_features(df: DataFrame, columns: list[str], features: str = "features") -> DataFrame:
    """df whose feature list is followed by the statistics columns, made finite."""
    extra = F.array(*[F.coalesce(finite_or_zero(F.col(c)), F.lit(0.0)) for c in columns])
    return df.withColumn(features, F.concat(features, extra))


#: Feature families: from kernels, from statistics, or both.
FAMILIES = ("kernels", "statistics", "both")


def check_family(family: str, n_groups: int, n_channels: int) -> str:
    """Rules of the families: statistics have no groups and one channel."""
    if family not in FAMILIES:
        raise ValueError(f"unknown feature family {family}")
    if family == "statistics" and n_groups != 1:
        raise ValueError("a family without a group axis needs n_groups = 1")
    if family != "kernels" and n_channels > 1:
        raise ValueError("statistics are defined for one channel")
    return family


def family_problem(family: Column, n_groups: Column, n_channels: Column) -> Column:
    """What check_family would say of each row; null for good ones."""
    return (
        F.when(~family.isin(*FAMILIES), F.concat(F.lit("unknown feature family "), family))
        .when((family == "statistics") & (n_groups != 1), F.lit("a family without a group axis needs n_groups = 1"))
        .when((family != "kernels") & (n_channels > 1), F.lit("statistics are defined for one channel"))
    )


def standardize(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """df with the columns at zero mean and unit population deviation of the training split; constant columns become 0."""
    by = by or []
    train = F.col("split") == "train"
    fit = df.groupBy(*by).agg(*[F.avg(F.when(train, F.col(c))).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(F.when(train, F.col(c))).alias(f"_s_{c}") for c in columns])
    joined = df.join(small(fit), by) if by else df.crossJoin(F.broadcast(fit))  # one row (for each group)
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return joined.withColumns(scaled).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def block_scale(df: DataFrame, second: list[str], n_first: int, weight: float | None = None) -> DataFrame:
    """df with the second block's standardised columns times a weight: sqrt(n_first / n_second) unless given."""
    w = math.sqrt(n_first / len(second)) if weight is None else weight
    return df.withColumns({c: F.col(c) * w for c in second})


def stack_heads(decisions: DataFrame, a: float) -> DataFrame:
    """decisions (id, cls, split, d1, d2) plus d = (1 - a) z(d1) + a z(d2), scaled by class."""
    scaled = standardize(decisions.withColumns({"_z1": F.col("d1"), "_z2": F.col("d2")}), ["_z1", "_z2"], ["cls"])
    return scaled.withColumn("d", (1 - a) * F.col("_z1") + a * F.col("_z2")).drop("_z1", "_z2")


def topk_counts(importances: DataFrame, k: int) -> DataFrame:
    """(name, n_top, n_datasets, n_features): how often each feature is among the k largest of a dataset; ties by name. importances is (dataset, name, value)."""
    ranked = importances.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("value"), "name")))
    size = importances.agg(F.countDistinct("dataset").alias("n_datasets"), F.countDistinct("name").alias("n_features"))  # one row
    return ranked.groupBy("name").agg(F.count_if(F.col("_r") <= k).alias("n_top")).crossJoin(F.broadcast(size))


def select_features(importances: DataFrame, k: int, fdr: float) -> DataFrame:
    """(name, n_top, p_value, survives): counts against Binomial(datasets, k / features), Benjamini-Hochberg at fdr."""
    counted = topk_counts(importances, k)
    tested = counted.withColumn("p_value", binom_sf(F.col("n_top"), F.col("n_datasets"), F.lit(float(k)) / F.col("n_features")))
    return benjamini_hochberg(tested, fdr).select("name", "n_top", "p_value", "survives")


def family_summary(records: DataFrame, base: str) -> DataFrame:
    """(arm, n, wins, ties, losses, mean_delta, median_delta, best, worst) against the base arm; records are (dataset, arm, accuracy)."""
    own = records.where(F.col("arm") == base).select("dataset", F.col("accuracy").alias("_base"))
    d = F.col("accuracy") - F.col("_base")
    rows = records.where(F.col("arm") != base).join(own, "dataset")
    sums = rows.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.avg(d).alias("mean_delta"), F.max(d).alias("best"), F.min(d).alias("worst"))
    return with_median(sums, rows, ["arm"], d, "median_delta")


def oracle_arm(records: DataFrame) -> DataFrame:
    """(dataset, arm, accuracy): the best arm of each dataset, ties to the first."""
    return records.groupBy("dataset").agg(F.min_by("arm", F.struct(-F.col("accuracy"), F.col("arm"))).alias("arm"), F.max("accuracy").alias("accuracy"))


def accuracy_bands(records: DataFrame, base: str, edges: tuple[float, ...] = (0.6, 0.8, 0.95)) -> DataFrame:
    """(band, arm, n, mean_delta): deltas by the band of the base arm's accuracy."""
    own = records.where(F.col("arm") == base).select("dataset", F.col("accuracy").alias("_base"))
    band = sum(((F.col("_base") >= e).cast("int") for e in edges), F.lit(0))
    return records.where(F.col("arm") != base).join(own, "dataset").groupBy(band.alias("band"), "arm").agg(F.count("*").alias("n"), F.avg(F.col("accuracy") - F.col("_base")).alias("mean_delta"))
