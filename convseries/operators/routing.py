"""Confidence and routing: which rows a cheap student keeps and which go to the ensemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convseries.functions.prng import stable_uniform
from convseries.functions.stats import sign_test_p
from convseries.operators.ensemble import argmax_label
from convseries.operators.ranking import exact_quantile, global_rank, uniform_rank


def proba_margin(proba: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """(keys, margin): largest minus second largest probability; with one class the largest itself."""
    ordered = F.sort_array(F.collect_list(p), asc=False)
    return proba.groupBy(*keys).agg(ordered.alias("_o")).select(*keys, (F.get("_o", F.lit(0)) - F.coalesce(F.get("_o", F.lit(1)), F.lit(0.0))).alias("margin"))


def decision_margin(decision: Column) -> Column:
    """|d| of a single decision value, else largest minus second largest."""
    ordered = F.sort_array(decision, asc=False)
    return F.when(F.size(decision) == 1, F.abs(F.get(decision, F.lit(0)))).otherwise(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))


def label_conf(soft: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, yhat, confidence) with renormalised confidence for every id of ids; one that soft lacks fails at run time."""
    total = F.sum("p").over(Window.partitionBy("id"))
    labels = argmax_label(soft.withColumn("p", F.col("p") / F.when(total > 0, total).otherwise(1.0)), ["id"], "p")
    found = ids.select("id").join(labels, "id", "left")
    return found.withColumn("yhat", F.when(F.col("yhat").isNotNull(), F.col("yhat")).otherwise(F.raise_error(F.lit("a row has no probabilities"))))


def ranked_by_margin(rows: DataFrame) -> DataFrame:
    """rows (id, margin, ...) plus rank, least margin first, ties by id, and n, the number of rows."""
    ranked = global_rank(rows, [F.col("margin"), F.col("id")])
    return ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n"))))  # one row


def route_fraction(rows: DataFrame, fraction: float) -> DataFrame:
    """(id, escalated, yhat) for rows (id, margin, student, alternate): the round(fraction * n) least sure rows take the alternate, halves rounded to even."""
    ranked = ranked_by_margin(rows)
    escalated = F.col("rank") <= F.bround(F.lit(fraction) * F.col("n"))
    return ranked.select("id", escalated.alias("escalated"), F.when(escalated, F.col("alternate")).otherwise(F.col("student")).alias("yhat"))


def fractions(spark, steps: int = 20) -> DataFrame:  # noqa: ANN001
    """The steps + 1 fractions from 0 to 1."""
    return spark.range(steps + 1).select((F.col("id") / steps).alias("fraction"))


def _curve(ranked: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """(keys, fraction, accuracy): right answers of the alternate up to a rank and of the student beyond it.

    Ranks are folded to the fraction at which they switch, so that the curve needs steps + 1 sums, not a row for each
    row and fraction."""
    s = (F.col("student") == F.col("y")).cast("long")
    t = (F.col("alternate") == F.col("y")).cast("long")
    grid = fractions(ranked.sparkSession, steps)
    at = F.array(*[F.bround(F.lit(k / steps) * F.col("n")) for k in range(steps + 1)])
    cell = F.size(F.filter(at, lambda x: x < F.col("rank")))  # the first fraction that escalates this rank
    cells = ranked.groupBy(*keys, cell.alias("cell")).agg(F.sum(t - s).alias("gain"), F.sum(s).alias("base"), F.count("*").alias("rows"))
    joined = grid.withColumn("k", F.round(F.col("fraction") * steps).cast("int")).crossJoin(F.broadcast(cells))  # (steps + 1) squared rows at most for each key
    sums = joined.groupBy(*keys, "fraction").agg(F.sum(F.when(F.col("cell") <= F.col("k"), F.col("gain")).otherwise(0)).alias("gain"), F.sum("base").alias("base"), F.sum("rows").alias("rows"))
    return sums.select(*keys, "fraction", ((F.col("base") + F.col("gain")) / F.col("rows")).alias("accuracy"))


def route_curve(rows: DataFrame, steps: int = 20) -> DataFrame:
    """(fraction, accuracy) for rows (id, margin, student, alternate, y)."""
    return _curve(ranked_by_margin(rows), [], steps)


def route_random(rows: DataFrame, seed: int = 0, draws: int = 5, steps: int = 20) -> DataFrame:
    """(fraction, accuracy): escalating random rows, averaged over draws.

    Every row has a uniform margin for each draw. All draws are ranked at once, by cells of the uniform range, so that the
    rows are read once, and neither sorted as a whole nor written."""
    own = rows.select("id", "student", "alternate", "y").withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    ranked = uniform_rank(own, ["_draw"], stable_uniform(seed, F.col("id"), F.col("_draw") + 1), ["id"])
    n = F.broadcast(rows.agg(F.count("*").alias("n")))  # one row
    return _curve(ranked.crossJoin(n), ["_draw"], steps).groupBy("fraction").agg(F.avg("accuracy").alias("accuracy"))


def route_signal(routed: DataFrame, random: DataFrame, keys: list[str]) -> DataFrame:
    """(fraction, signal, wins, losses, p): routed minus random accuracy over datasets `keys`, with a sign test."""
    both = routed.join(random.withColumnRenamed("accuracy", "control"), [*keys, "fraction"])
    d = F.col("accuracy") - F.col("control")
    sums = both.groupBy("fraction").agg(F.avg(d).alias("signal"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    return sums.withColumn("p", sign_test_p(F.col("wins"), F.col("losses")))


def calibrate_threshold(margins: DataFrame, target: float) -> DataFrame:
    """One row: the exact quantile of the margins, interpolated."""
    return exact_quantile(margins, "margin", target, "threshold")


def route_threshold(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, escalated, yhat) row by row: below the threshold the alternate answers. Works on streams."""
    escalated = F.col("margin") < F.lit(threshold)
    return rows.select("id", escalated.alias("escalated"), F.when(escalated, F.col("alternate")).otherwise(F.col("student")).alias("yhat"))


def threshold_report(rows: DataFrame, calibration: DataFrame, target: float) -> DataFrame:
    """One row: threshold, realised rate, accuracy, accuracy of the sorted rule at the same target, gap. rows are (id, margin, student, alternate, y), calibration (margin)."""
    thr = F.broadcast(calibrate_threshold(calibration, target))
    by_row = rows.crossJoin(thr).withColumn("esc", F.col("margin") < F.col("threshold"))  # one row on the right
    own = by_row.agg(F.first("threshold").alias("threshold"), F.avg(F.col("esc").cast("double")).alias("rate"), F.avg((F.when(F.col("esc"), F.col("alternate")).otherwise(F.col("student")) == F.col("y")).cast("double")).alias("accuracy"))
    ranked = ranked_by_margin(rows)
    taken = F.col("rank") <= F.bround(F.lit(target) * F.col("n"))
    by_sort = ranked.agg(F.avg((F.when(taken, F.col("alternate")).otherwise(F.col("student")) == F.col("y")).cast("double")).alias("sorted_accuracy"))
    return own.crossJoin(by_sort).withColumn("gap", F.col("accuracy") - F.col("sorted_accuracy"))


def fit_call_cost(timings: DataFrame) -> DataFrame:
    """One row (fixed, marginal) from two arms (calls, rows, seconds) per group: seconds = fixed * calls + marginal * rows. Null where the arms do not separate the two or a part comes out non-positive."""
    small, big = F.min_by(F.struct("calls", "rows", "seconds"), F.col("rows")), F.max_by(F.struct("calls", "rows", "seconds"), F.col("rows"))
    two = timings.agg(small.alias("s"), big.alias("b"))
    den = F.col("s.calls") * F.col("b.rows") - F.col("b.calls") * F.col("s.rows")
    fixed = F.try_divide(F.col("s.seconds") * F.col("b.rows") - F.col("b.seconds") * F.col("s.rows"), F.nullif(den, F.lit(0)))
    both = two.select(fixed.alias("fixed"), "s").withColumn("marginal", F.try_divide(F.col("s.seconds") - F.col("s.calls") * F.col("fixed"), F.col("s.rows")))
    good = (F.col("fixed") > 0) & (F.col("marginal") > 0)
    return both.select(F.when(good, F.col("fixed")).alias("fixed"), F.when(good, F.col("marginal")).alias("marginal"))
