"""Row numbers over large tables without one task that sorts everything."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or a temporary one where a local session has none. A cluster must name it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="convseries-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own beside the checkpoints; not created."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most rows of a table that is broadcast.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """df, computed once, to be broadcast if it has at most BROADCAST_ROWS rows; else a join shuffles it."""
    found = kept(df)
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


#: Bits of an ordered double that one pass over the values settles.
DIGIT_BITS = 16


def ordered_bits(x: Column) -> Column:
    """A long for each double, ordered as unsigned numbers like the doubles: negative ones with all bits turned, others with the sign bit set. -0.0 is 0.0; NaN comes last."""

    @F.pandas_udf("long")
    def turned(column):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        x = column.to_numpy(np.float64) + 0.0
        x[np.isnan(x)] = np.nan  # one bit pattern
        bits = x.view(np.int64)
        return pd.Series(np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))))

    return turned(x.cast("double"))


def doubles(bits: Column) -> Column:
    """The doubles of ordered_bits."""

    @F.pandas_udf("double")
    def turned(column):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        bits = column.to_numpy(np.int64)
        return pd.Series(np.where(bits < 0, bits ^ np.int64(-(2**63)), ~bits).view(np.float64))

    return turned(bits)


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """(by, q, quantile): interpolated quantiles within `by` (nulls are one group), without a sort.

    The two order statistics around each quantile are selected by nested histograms: a pass over the values counts the
    next 16 bits of those that share the prefix found so far, and the bits at which the count passes the wanted rank go
    on the prefix; four passes give all 64 bits. A pass shuffles at most 2**16 counts for each open prefix and task. Null
    values are left out; a group without values has no row.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    rows = kept(df.where(F.col(value).isNotNull()).select(*[F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)], ordered_bits(F.col(f"`{value}`")).alias("_bits")))
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_n")).where("_n > 0")
    wanted = sizes.withColumn("_q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_place", F.col("_q") * (F.col("_n") - 1))
    open_ = kept(wanted.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place"))))).withColumn("_prefix", F.lit(0).cast("long")))
    sent = F.broadcast if open_.count() <= BROADCAST_ROWS else lambda df: df  # as many rows at every level
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        prefix = F.shiftrightunsigned("_bits", shift + DIGIT_BITS) if shift + DIGIT_BITS < 64 else F.lit(0).cast("long")
        keys = [*groups, "_prefix"]
        prefixes = sent(open_.select(*[F.col(k).alias(f"{k}_r") for k in keys]).distinct())
        inside = rows.withColumn("_prefix", prefix).join(prefixes, _same(keys, "_r"), "left_semi")
        cells = inside.groupBy(*keys, F.shiftrightunsigned("_bits", shift).bitwiseAND((1 << DIGIT_BITS) - 1).alias("_digit")).agg(F.count("*").alias("_count"))
        upto = F.sum("_count").over(Window.partitionBy(*keys).orderBy("_digit"))
        cells = cells.select(*[F.col(k).alias(f"{k}_r") for k in keys], "_digit", "_count", upto.alias("_upto"))
        found = cells.join(sent(open_), _same(keys, "_r") & (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_count")))
        digit = F.shiftleft("_prefix", DIGIT_BITS).bitwiseOR(F.col("_digit"))
        open_ = kept(found.select(*groups, "_q", "_place", (F.col("_rank") - F.col("_upto") + F.col("_count")).alias("_rank"), digit.alias("_prefix"), (F.col("_at") if "_at" in open_.columns else F.col("_rank")).alias("_at")))
    found = open_.withColumn("_value", doubles(F.col("_prefix"))).groupBy(*groups, "_q", "_place").agg(F.min_by("_value", "_at").alias("_lo"), F.max_by("_value", "_at").alias("_hi"))
    between = F.col("_lo") + F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col("_hi") - F.col("_lo")) * (F.col("_place") - F.floor("_place")))
    return found.select(*[F.col(g).alias(c) for c, g in zip(by, groups)], F.col("_q").alias("q"), between.alias("quantile"))


def _same(keys: list[str], ending: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}{ending}"))
    return same


def exact_quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row: the q-quantile of a column, interpolated between its two order statistics; null for no values."""
    return exact_quantiles(df, [], value, [q]).agg(F.first("quantile").alias(name))


def with_median(sums: DataFrame, rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """sums, a row per group of `by`, plus the exact median of value over the rows of each group."""
    medians = exact_quantiles(rows.select(*[F.col(f"`{c}`") for c in by], value.alias("_value")), by, "_value", [0.5])
    medians = small(medians.select(*[F.col(f"`{c}`").alias(f"{c}_of") for c in by], F.col("quantile").alias(name)))
    return sums.join(medians, _same(by, "_of"), "left").drop(*[f"{c}_of" for c in by])


def uniform_rank(df: DataFrame, by: list[str], uniform: Column, ties: list[str], name: str = "rank") -> DataFrame:
    """df with row numbers from 1 within `by`, in the order of a uniform [0, 1) column, then `ties`.

    The uniform values are cut into as many cells as there are shuffle partitions; a row's number is the rows of lower
    cells plus its number in its cell. So even one group with all rows is numbered in parallel.
    """
    cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_u", uniform).withColumn("_cell", F.floor(F.col("_u") * cells).cast("int"))
    sizes = rows.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_cell").alias("_c"), before.alias("_base"))
    same = F.col("_cell") == F.col("_c")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_u", *ties))
    out = rows.withColumn("_own", own).join(bases, same)
    return out.withColumn(name, F.col("_base") + F.col("_own")).drop("_u", "_cell", "_own", "_base", "_c", *[f"_k{i}" for i in range(len(by))])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with row numbers from 1 over the whole table, by one exchange: rows are range-partitioned, sorted and numbered in their part as they are written; the rows of the parts before come from a table of one row per part.

    Rows that tie in `order` are numbered in any order, and need not meet in one task.
    """
    spark = df.sparkSession
    order = [*order, F.col("_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of the part stands above 33 bits, the place in it below
    rows = kept(rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    bases, before = [], 0
    for found in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # as many as there are parts
        bases.append((found.part, before + 1))
        before += found.n
    table = spark.createDataFrame(bases, "_part long, _base long")
    return rows.join(F.broadcast(table), part == F.col("_part")).withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")
