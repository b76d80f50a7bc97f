"""Banks of random convolution kernels, addressable by (seed, index), as tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convseries.functions.prng import Streams, draw, stable_normals, substream_seed, to_uniform

LENGTHS = (7, 9, 11)
LONGEST = max(LENGTHS)
FEATURES_PER_KERNEL = 2

BANK_SCHEMA = T.StructType([
    T.StructField("kernel_id", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("bias", T.DoubleType()),
    T.StructField("dilation", T.LongType()), T.StructField("padding", T.LongType()), T.StructField("channels", T.ArrayType(T.IntegerType())),
])


def check_bank(k: int, n_ref: int, first: int = 0, channels: int = 1) -> None:
    """Parameters of a bank, with the messages that callers rely on."""
    if k <= 0:
        raise ValueError("kernels_per_group must be positive")
    if first < 0:
        raise ValueError("first_kernel must be non-negative")
    if n_ref < LONGEST:
        raise ValueError(f"n_reference {n_ref} is shorter than the longest kernel")
    if channels < 1:
        raise ValueError("a series needs at least one channel")


def draw_kernels(seed: int, ids: np.ndarray, n_ref: int, channels: int = 1) -> list[tuple]:
    """Kernels `ids` as rows of BANK_SCHEMA: length, channels (only if there are several), weights channel by channel, bias, dilation, padding, in this order of draws."""
    ids = np.asarray(ids, np.int64)
    rng = Streams(seed, ids)
    length = np.array(LENGTHS)[(rng.uniform() * len(LENGTHS)).astype(np.int64)]
    chosen = [[0]] * len(ids)
    if channels > 1:
        top = math.log2(channels + 1)
        n_sel = np.array([max(1, min(channels, math.floor(2.0 ** (u * top)))) for u in rng.uniform()])
        orders = [list(range(channels)) for _ in ids]
        for k in range(int(n_sel.max(initial=0))):
            live = n_sel > k
            offset = (rng.uniform(live) * (channels - k)).astype(np.int64)
            for i in np.flatnonzero(live):
                j = k + int(offset[i])
                orders[i][k], orders[i][j] = orders[i][j], orders[i][k]
        chosen = [sorted(o[:n]) for o, n in zip(orders, n_sel)]
    n_chosen = np.array([len(c) for c in chosen])
    weights: list[list[list[float]]] = [[] for _ in ids]
    for c in range(int(n_chosen.max(initial=0))):
        raw = np.zeros((LONGEST, len(ids)))
        for j in range(LONGEST):
            raw[j] = rng.normal((n_chosen > c) & (length > j))
        for i in np.flatnonzero(n_chosen > c):
            own = raw[: length[i], i].tolist()
            mean = sum(own) / len(own)
            weights[i].append([w - mean for w in own])
    bias = -1.0 + 2.0 * rng.uniform()
    dilation = [math.floor(2.0 ** (u * math.log2((n_ref - 1) / (n - 1)))) for u, n in zip(rng.uniform(), length)]
    padded = (rng.uniform() * 2).astype(np.int64) == 1
    return [(int(i), int(n), w, float(b), int(d), int((n - 1) * d // 2) if p else 0, list(c)) for i, n, w, b, d, p, c in zip(ids, length, weights, bias, dilation, padded, chosen)]


def kernel_bank(spark: SparkSession, seed: int, n_ref: int, k: int, first: int = 0, channels: int = 1) -> DataFrame:
    """Kernels first .. first + k - 1, drawn in parallel."""
    check_bank(k, n_ref, first, channels)

    def rows(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame(draw_kernels(seed, batch["id"].to_numpy(), n_ref, channels), columns=BANK_SCHEMA.names)

    return spark.range(first, first + k).mapInPandas(rows, BANK_SCHEMA)


def bank_group(bank: DataFrame, g: int, k: int) -> DataFrame:
    """Group g of k kernels."""
    return bank.where(F.col("kernel_id").between(g * k, (g + 1) * k - 1))


def with_group(bank: DataFrame, k: int) -> DataFrame:
    """bank plus grp, the group of each kernel."""
    return bank.withColumn("grp", F.floor(F.col("kernel_id") / k).cast("long"))


def kernel_params(kernels: DataFrame, seed: int, n_ref: int, id_col: str = "kernel_id", pairs: int = 80) -> DataFrame:
    """The relational twin for one channel: (id, length, cursor, bias, dilation, padding) of the kernels named in a table.

    Length is draw 1; candidate pair p takes draws 2 + 2p and 3 + 2p; bias, dilation and padding follow the pair of the
    last weight. Its logarithm is Spark's, so a dilation that falls on a whole number can differ from `draw_kernels`.
    """
    base = kernels.select(F.col(id_col).alias("kernel_id")).withColumn("_s", substream_seed(seed, F.col("kernel_id")))
    pick = F.floor(to_uniform(draw(F.col("_s"), F.lit(1).cast("long"))) * len(LENGTHS)).cast("int")
    base = base.withColumn("length", F.get(F.array(*map(F.lit, LENGTHS)), pick))
    taps = stable_normals(base.select("kernel_id", "length"), seed, "kernel_id", F.col("length"), pairs, 2)
    cursor = taps.where("k = length").select("kernel_id", (F.col("step") + 1).alias("cursor"))
    rows = base.join(cursor, "kernel_id")
    u = {n: to_uniform(draw(F.col("_s"), F.col("cursor") + k)) for k, n in ((1, "u_bias"), (2, "u_dilation"), (3, "u_padding"))}
    rows = rows.withColumns(u)
    top = F.log2((F.lit(n_ref) - 1) / (F.col("length") - 1))
    rows = rows.withColumn("dilation", F.floor(F.pow(F.lit(2.0), F.col("u_dilation") * top)).cast("long"))
    padding = F.when(F.floor(F.col("u_padding") * 2) == 1, F.floor((F.col("length") - 1) * F.col("dilation") / 2)).otherwise(0).cast("long")
    return rows.select("kernel_id", "length", "cursor", (F.lit(-1.0) + F.lit(2.0) * F.col("u_bias")).alias("bias"), "dilation", padding.alias("padding"))


def kernel_weights(kernels: DataFrame, seed: int, id_col: str = "kernel_id", pairs: int = 80) -> DataFrame:
    """The relational twin of the weights for one channel: (kernel_id, j, weight), centred by a window average."""
    base = kernels.select(F.col(id_col).alias("kernel_id"))
    pick = F.floor(to_uniform(draw(substream_seed(seed, F.col("kernel_id")), F.lit(1).cast("long"))) * len(LENGTHS)).cast("int")
    base = base.withColumn("length", F.get(F.array(*map(F.lit, LENGTHS)), pick))
    taps = stable_normals(base, seed, "kernel_id", F.col("length"), pairs, 2)
    centred = F.col("normal") - F.avg("normal").over(Window.partitionBy("kernel_id"))
    return taps.select("kernel_id", (F.col("k") - 1).alias("j"), centred.alias("weight"))


def bank_long(kernels: DataFrame, seed: int, n_ref: int, id_col: str = "kernel_id") -> DataFrame:
    """(kernel_id, j, weight, length, bias, dilation, padding)."""
    params = kernel_params(kernels, seed, n_ref, id_col).drop("cursor")
    return kernel_weights(kernels, seed, id_col).join(params, "kernel_id")


def bank_table(bank: DataFrame) -> DataFrame:
    """For export: one row per feature, with its kernel's parameters; feature 2i is the maximum of kernel i and 2i + 1 its share of positive values."""
    both = F.posexplode(F.array(F.lit("max"), F.lit("ppv"))).alias("_at", "kind")
    return bank.select("*", both).withColumn("feature_id", 2 * F.col("kernel_id") + F.col("_at")).drop("_at")


@dataclass(frozen=True)
class EnsembleConfig:
    """Sizes of a group ensemble; validate() says what does not fit together."""

    n_kernels: int = 10_000
    n_groups: int = 40
    estimators: int = 1
    seed: int = 0
    most_features: int = 2000
    features_per_estimator: int = 500

    @property
    def kernels_per_group(self) -> int:
        return self.n_kernels // self.n_groups

    @property
    def features_per_group(self) -> int:
        return self.kernels_per_group * FEATURES_PER_KERNEL

    def validate(self) -> EnsembleConfig:
        if min(self.n_kernels, self.n_groups, self.estimators) <= 0:
            raise ValueError("n_kernels, n_groups and estimators must be positive")
        if self.n_kernels % self.n_groups:
            raise ValueError(f"n_kernels {self.n_kernels} is not divisible by n_groups {self.n_groups}")
        if self.features_per_group > self.most_features:
            raise ValueError(f"{self.features_per_group} features per group exceed {self.most_features}")
        if self.features_per_group > self.features_per_estimator * self.estimators:
            raise ValueError(f"{self.estimators} estimator(s) of {self.features_per_estimator} features do not cover {self.features_per_group}")
        return self


def config_problem(n_kernels: Column, n_groups: Column, estimators: Column, config: EnsembleConfig = EnsembleConfig()) -> Column:
    """What EnsembleConfig.validate would say of the sizes in each row, with the limits of config; null for good ones."""
    good = (n_kernels > 0) & (n_groups > 0) & (estimators > 0)
    features = F.when(n_groups > 0, F.call_function("div", n_kernels, n_groups) * FEATURES_PER_KERNEL)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (
        F.when(~good, F.lit("n_kernels, n_groups and estimators must be positive"))
        .when(n_kernels % n_groups != 0, text("n_kernels ", n_kernels, " is not divisible by n_groups ", n_groups))
        .when(features > config.most_features, text(features, f" features per group exceed {config.most_features}"))
        .when(features > config.features_per_estimator * estimators, text(estimators, f" estimator(s) of {config.features_per_estimator} features do not cover ", features))
    )


def bank_fingerprints(features: DataFrame, feature_col: str = "features") -> DataFrame:
    """(grp, fingerprint) of group feature lists: the sum of all their values. Equal fingerprints mean that groups share a bank."""
    total = F.aggregate(F.col(feature_col), F.lit(0.0), lambda a, x: a + x)
    return features.groupBy("grp").agg(F.sum(total).alias("fingerprint"))


def distinct_banks(fingerprints: DataFrame) -> DataFrame:
    """Whether every group has its own fingerprint: (n_groups, n_distinct)."""
    return fingerprints.agg(F.count("*").alias("n_groups"), F.countDistinct("fingerprint").alias("n_distinct"))
