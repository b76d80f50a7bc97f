"""Reading, assembling and reshaping series and prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """A labelled series table (id, split, label, values) from Parquet."""
    return spark.read.parquet(path)


def label_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both splits in one table with a split column and string labels; ids must be unique over both."""
    tag = lambda df, name: df.withColumns({"split": F.lit(name), "label": F.col("label").cast("string")})
    return tag(train, "train").unionByName(tag(test, "test"))


def assemble_series(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "values") -> DataFrame:
    """Long rows to one array per key, ordered by `order`. A key's points meet in one task, so a series must fit there."""
    points = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_value"))))
    return df.groupBy(*keys).agg(points.alias("_points")).select(*keys, F.transform("_points", lambda p: p["_value"]).alias(name))


def explode_series(df: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """Arrays to long rows (keys, t, value), t from 0."""
    return df.select(*keys, F.posexplode(values).alias("t", "value"))


def assemble_channels(df: DataFrame, keys: list[str], order: list[str], channels: list[str], name: str = "values") -> DataFrame:
    """Long rows with a column per channel to one array of channels per key."""
    points = F.sort_array(F.collect_list(F.struct(*order, *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(channels)])))
    rows = df.groupBy(*keys).agg(points.alias("_points"))

    def channel(k: int) -> Column:
        return F.transform("_points", lambda p: p[f"_c{k}"])

    arrays = [channel(k) for k in range(len(channels))]
    return rows.select(*keys, F.array(*arrays).alias(name))


def check_channels(df: DataFrame, values: str = "values") -> DataFrame:
    """df, failing at run time on series without channels, with a null channel, or with channels of different length."""
    sizes = F.transform(F.col(values), lambda c: F.size(c))
    bad = (
        F.when(F.size(values) == 0, F.lit("a series needs at least one channel"))
        .when(F.exists(values, lambda c: c.isNull()), F.lit("a channel is NULL"))
        .when(F.array_min(sizes) != F.array_max(sizes), F.lit("every channel must be the same length"))
    )
    return df.withColumn(values, F.when(bad.isNull(), F.col(values)).otherwise(F.raise_error(bad)))


def features_to_wide(df: DataFrame, n: int, features: str = "features", prefix: str = "f") -> DataFrame:
    """The first n features as columns f0, f1, ..., for export."""
    others = [c for c in df.columns if c != features]
    return df.select(*others, *[F.get(features, F.lit(k)).alias(f"{prefix}{k}") for k in range(n)])


def group_features(df: DataFrame, n_groups: int, width: int, features: str = "features") -> DataFrame:
    """One row per series and group (grp, features); test rows lose their label."""
    from convseries.functions.series import slice_group

    rows = df.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    label = F.when(F.col("split") == "train", F.col("label"))
    return rows.withColumns({features: slice_group(F.col(features), F.col("grp"), width), "label": label})


def write_group_features(groups: DataFrame, path: str) -> None:
    """A folder for each group and split."""
    groups.write.mode("overwrite").partitionBy("grp", "split").parquet(path)


def read_group_features(spark: SparkSession, path: str, groups: list[int] | None = None, split: str | None = None) -> DataFrame:
    """What write_group_features wrote, of some groups or one split only: their folders alone are read."""
    rows = spark.read.parquet(path)
    if groups is not None:
        rows = rows.where(F.col("grp").isin(groups))
    return rows if split is None else rows.where(F.col("split") == split)


def attach_features(df: DataFrame, other: DataFrame, on: str = "id") -> DataFrame:
    """df with another family's columns by id, failing at run time where an id has none or several."""
    counted = other.withColumn("_n", F.count("*").over(Window.partitionBy(on)))
    joined = df.join(counted, on, "left")
    return joined.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a row has no or several feature rows")).cast("boolean"))).drop("_n")


def union_groups(*frames: DataFrame) -> DataFrame:
    """The rows of several runs, by column name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, failing now if a name is missing; case does not matter."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df


def missing_columns(have: Column, names: list[str]) -> Column:
    """Those of names that a list of column names lacks; case does not matter."""
    lower = F.transform(have, lambda c: F.lower(c))
    return F.filter(F.array(*map(F.lit, names)), lambda n: ~F.array_contains(lower, F.lower(n)))


def explode_proba(df: DataFrame, proba: str = "proba") -> DataFrame:
    """(..., cls, p) from a map of class probabilities."""
    return df.select(*[c for c in df.columns if c != proba], F.explode(proba).alias("cls", "p"))


def collect_proba(df: DataFrame, keys: list[str], name: str = "proba") -> DataFrame:
    """One map of class probabilities per key, in class order."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cls", "p")))).alias(name))


def proba_vector(df: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """One dense vector per key in the order of classes, 0.0 where a class is missing."""
    wide = df.groupBy(*keys).pivot("cls", classes).agg(F.first("p"))
    return wide.select(*keys, F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in classes]).alias("proba"))


def describe_dataset(df: DataFrame, values: str = "values", by: list[str] | None = None) -> DataFrame:
    """n_train, n_test, n_timepoints (shortest), n_channels, n_classes."""
    kind = dict(df.dtypes)[values]
    n_channels = F.max(F.size(values)) if kind.startswith("array<array") else F.max(F.lit(1))
    points = F.min(F.size(F.get(values, F.lit(0)))) if kind.startswith("array<array") else F.min(F.size(values))
    return df.groupBy(*(by or [])).agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"), points.cast("long").alias("n_timepoints"),
        n_channels.cast("long").alias("n_channels"), F.countDistinct("label").alias("n_classes"),
    )


def eligible(described: DataFrame, most_classes: int = 10) -> DataFrame:
    """Datasets with few enough classes, smallest test split first."""
    return described.where(F.col("n_classes") <= most_classes).orderBy("n_test")


def run_records(runs: DataFrame, config: list[str], shape: list[str], result: list[str], alignment: list[str], failures: Column) -> DataFrame:
    """(config, shape, result, alignment, failures): a record for each row of runs, to be appended to a table of runs. The named columns become maps by name; failures is a list of messages, none for a clean run."""
    entries = lambda names, kind: F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`").cast(kind))])
    return runs.select(entries(config, "string").alias("config"), entries(shape, "string").alias("shape"), entries(result, "double").alias("result"), entries(alignment, "string").alias("alignment"), F.array_compact(failures).alias("failures"))


def write_run(df: DataFrame, path: str) -> None:
    """Predictions, soft labels, cubes, timings or assertions as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runs from JSON lines, without failed ones."""
    return clean_runs(spark.read.schema(schema).json(path))


def clean_runs(runs: DataFrame) -> DataFrame:
    """Runs without failures."""
    return runs.where(F.size(F.coalesce(F.col("failures"), F.array().cast("array<string>"))) == 0)


def preferred_runs(runs: DataFrame, keys: list[str], preference: Column) -> DataFrame:
    """One run per key: the one with the smallest preference. A model without a run is absent, so that no ensemble silently shrinks."""
    return runs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(preference))).where("_r = 1").drop("_r")
