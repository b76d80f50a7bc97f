"""Evaluation, integrity checks and statistics over prediction tables and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convseries.functions.stats import binom_sf, sign_test_p
from convseries.operators.ranking import exact_quantile, global_rank, kept, with_median


def _share(cond) -> F.Column:  # noqa: ANN001
    return F.avg(cond.cast("double"))


def accuracy(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, accuracy) of rows (id, yhat, y)."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), _share(F.col("yhat") == F.col("y")).alias("accuracy"))


def mean_accuracies(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """One row: accuracy averaged over datasets, and over rows."""
    per = accuracy(rows, [dataset])
    return per.agg(F.avg("accuracy").alias("by_dataset"), (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("by_row"))


def alignment(groups: DataFrame, n_rows: int, n_groups: int) -> DataFrame:
    """One row of counts and `aligned`: every row predicted by every group exactly once. groups is (grp, id, ...) with a row per class or one."""
    pairs = groups.select("grp", "id").distinct()
    per_id = pairs.groupBy("id").agg(F.count("*").alias("k"))
    out = per_id.agg(F.count("*").alias("distinct_ids"), F.sum("k").alias("group_rows"), F.min("k").alias("min_groups"), F.max("k").alias("max_groups"))
    ok = (F.col("distinct_ids") == n_rows) & (F.col("group_rows") == n_rows * n_groups) & (F.col("min_groups") == n_groups) & (F.col("max_groups") == n_groups)
    return out.withColumn("aligned", ok)


def duplicate_series(df: DataFrame, values: str = "values") -> DataFrame:
    """One row: series, distinct series, and those that repeat another. Whole series are compared, grouped before the count."""
    per = df.groupBy(F.col(values).alias("v")).agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("series"), F.count("*").alias("distinct_series"), (F.sum("k") - F.count("*")).alias("duplicates"))


def compare_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ids only in a, only in b, in both, labels that differ, duplicate ids. a and b are (id, yhat)."""
    one = a.groupBy("id").agg(F.first("yhat").alias("ya"), F.count("*").alias("na"))
    two = b.groupBy("id").agg(F.first("yhat").alias("yb"), F.count("*").alias("nb"))
    both = one.join(two, "id", "full_outer")
    return both.agg(
        F.count_if(F.col("nb").isNull()).alias("only_a"), F.count_if(F.col("na").isNull()).alias("only_b"), F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("in_both"),
        F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull() & ~F.col("ya").eqNullSafe(F.col("yb"))).alias("differ"), F.count_if((F.coalesce("na", F.lit(1)) > 1) | (F.coalesce("nb", F.lit(1)) > 1)).alias("duplicated"),
    )


def conformance(expected: DataFrame, got: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row: values, max_abs, max_rel, beyond (more than tolerance apart), ppv_differ (odd places that are not equal). Both hold interleaved `features`."""
    pairs = expected.select(*keys, F.col("features").alias("e")).join(got.select(*keys, F.col("features").alias("g")), keys)
    rows = pairs.select(F.posexplode(F.arrays_zip("e", "g")).alias("at", "v")).select("at", F.col("v.e").alias("e"), F.col("v.g").alias("g"))
    diff = F.abs(F.col("e") - F.col("g"))
    return rows.agg(
        F.count("*").alias("n_values"), F.max(diff).alias("max_abs"), F.max(F.try_divide(diff, F.abs(F.col("e")))).alias("max_rel"), F.count_if(diff > tolerance).alias("beyond"),
        F.count_if((F.col("at") % 2 == 1) & (F.col("e") != F.col("g"))).alias("ppv_differ"),
    )


def summarise(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, sd (null for one value), min, max."""
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def paired_summary(a: DataFrame, b: DataFrame, keys: list[str], value: str = "accuracy", by: list[str] | None = None) -> DataFrame:
    """Wins, ties, losses, mean, median and detectable effect of a - b over shared keys."""
    both = a.join(b.withColumnRenamed(value, "_other"), keys).withColumn("_d", F.col(value) - F.col("_other"))
    return delta_summary(both, "_d", by)


def delta_summary(rows: DataFrame, delta: str, by: list[str] | None = None) -> DataFrame:
    """n, wins, ties, losses, mean, median, detectable (2.8 standard errors), p (sign test) of paired deltas."""
    d = F.col(delta)
    by = by or []
    out = rows.groupBy(*by).agg(
        F.count(d).alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.avg(d).alias("mean_delta"),
        (2.8 * F.stddev_samp(d) / F.sqrt(F.count(d))).alias("detectable"),
    )
    out = with_median(out, rows, by, d, "median_delta")
    return out.withColumn("p", sign_test_p(F.col("wins"), F.col("losses")))


def sign_test(rows: DataFrame, delta: str, by: list[str] | None = None) -> DataFrame:
    """(by, wins, losses, p), ties dropped."""
    d = F.col(delta)
    out = rows.groupBy(*(by or [])).agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    return out.withColumn("p", sign_test_p(F.col("wins"), F.col("losses")))


def binomial_tails(rows: DataFrame, k: str, n: str, p: str | float) -> DataFrame:
    """rows plus p_value = P(X >= k)."""
    return rows.withColumn("p_value", binom_sf(F.col(k), F.col(n), F.col(p) if isinstance(p, str) else p))


def benjamini_hochberg(rows: DataFrame, fdr: float, p: str = "p_value", key: str = "name", by: list[str] | None = None) -> DataFrame:
    """rows plus rank, threshold and survives. One family of all rows is ranked over range partitions; families (by) are ranked in a window each."""
    by = by or []
    if not by:
        ranked = kept(global_rank(rows, [F.col(p), F.col(key)]))
        m = F.broadcast(ranked.agg(F.count("*").alias("_m")))  # one row, as is the next
        cut = ranked.crossJoin(m).where(F.col(p) <= F.lit(fdr) * F.col("rank") / F.col("_m")).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_cut"), F.coalesce(F.max_by(p, "rank"), F.lit(0.0)).alias("threshold"))
        return ranked.crossJoin(F.broadcast(cut)).withColumn("survives", F.col("rank") <= F.col("_cut")).drop("_cut")
    ranked = rows.withColumns({"rank": F.row_number().over(Window.partitionBy(*by).orderBy(p, key)), "_m": F.count("*").over(Window.partitionBy(*by))})
    below = F.when(F.col(p) <= F.lit(fdr) * F.col("rank") / F.col("_m"), F.col("rank"))
    cut = F.coalesce(F.max(below).over(Window.partitionBy(*by)), F.lit(0))
    ranked = ranked.withColumn("_cut", cut)
    threshold = F.coalesce(F.max(F.when(F.col("rank") == F.col("_cut"), F.col(p))).over(Window.partitionBy(*by)), F.lit(0.0))
    return ranked.withColumn("threshold", threshold).withColumn("survives", F.col("rank") <= F.col("_cut")).drop("_m", "_cut")


def error_overlap(preds: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, joint, independent, ratio, disagreement) for each pair of models; ratio is null where independence expects none. preds is (model, id, yhat).

    An id's predictions become one pattern: for each model, in order, the place of the first one with the same answer, and
    whether it is wrong. Equal patterns are counted before pairs of models are formed, so what is multiplied by pairs is
    the number of patterns, not of rows. Null answers agree and disagree with nothing and are neither right nor wrong."""
    by = by or []
    rows = preds.join(truth, [*by, "id"]).select(*by, "id", F.struct("model", "yhat", (F.col("yhat") != F.col("y")).cast("int").alias("wrong")).alias("x"))
    own = rows.groupBy(*by, "id").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # a row for each model
    answers = own.select(*by, "xs", F.transform("xs", lambda x: x["yhat"]).alias("ys"))
    pattern = F.transform("xs", lambda x: F.struct(x["model"].alias("model"), F.array_position("ys", x["yhat"]).alias("same"), x["wrong"].alias("wrong")))
    counted = answers.groupBy(*by, pattern.alias("p")).agg(F.count("*").alias("n"))
    pairs = counted.select(*by, "n", "p", F.explode("p").alias("a")).select(*by, "n", "a", F.explode("p").alias("b")).where("a.model < b.model")
    mean = lambda value: F.sum(value * F.col("n")) / F.sum(F.when(value.isNotNull(), F.col("n")))
    wa, wb, differ = F.col("a.wrong").cast("double"), F.col("b.wrong").cast("double"), (F.col("a.same") != F.col("b.same")).cast("double")
    out = pairs.groupBy(*by, F.col("a.model").alias("a"), F.col("b.model").alias("b")).agg(mean(wa * wb).alias("joint"), (mean(wa) * mean(wb)).alias("independent"), mean(differ).alias("disagreement"))
    return out.withColumn("ratio", F.try_divide("joint", "independent"))


def overlap_report(overlaps: DataFrame) -> DataFrame:
    """(a, b, n_datasets, mean_ratio, mean_joint, mean_disagreement) over datasets."""
    return overlaps.groupBy("a", "b").agg(F.count("*").alias("n_datasets"), F.avg("ratio").alias("mean_ratio"), F.avg("joint").alias("mean_joint"), F.avg("disagreement").alias("mean_disagreement"))


def compatible_runs(runs: DataFrame, fields: list[str], base_model: str) -> DataFrame:
    """Runs whose fields equal the base model's of the same dataset, nulls being equal to nulls."""
    base = runs.where(F.col("model") == base_model).select("dataset", *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return runs.join(base, "dataset").where(same).drop(*[f"_{f}" for f in fields])


def paired_deltas(runs: DataFrame) -> DataFrame:
    """(dataset, resample, delta): arm B minus arm A where both finished."""
    arms = runs.where(F.col("accuracy").isNotNull()).groupBy("dataset", "resample").agg(F.max(F.when(F.col("arm") == "A", F.col("accuracy"))).alias("_a"), F.max(F.when(F.col("arm") == "B", F.col("accuracy"))).alias("_b"))
    return arms.where("_a IS NOT NULL AND _b IS NOT NULL").select("dataset", "resample", (F.col("_b") - F.col("_a")).alias("delta"))


def variance_split(runs: DataFrame) -> DataFrame:
    """One row: datasets, mean_resamples, grand_mean, var_within, var_of_means, var_between_raw, var_between.

    The spread of the datasets' means holds var_within / R, which is taken off; the raw rest may be negative. With fewer
    than two datasets, or one resample everywhere, the parts are null: they cannot be told apart, which is not zero."""
    per = paired_deltas(runs).groupBy("dataset").agg(F.avg("delta").alias("m"), F.var_samp("delta").alias("v"), F.count("*").alias("r"))
    out = per.agg(F.count("*").alias("datasets"), F.avg("r").alias("mean_resamples"), F.avg("m").alias("grand_mean"), F.avg("v").alias("var_within"), F.var_samp("m").alias("var_of_means"))
    raw = F.when(F.col("datasets") >= 2, F.col("var_of_means") - F.col("var_within") / F.col("mean_resamples"))
    return out.withColumn("var_between_raw", raw).withColumn("var_between", F.greatest(F.col("var_between_raw"), F.when(F.col("var_between_raw").isNotNull(), 0.0)))


def power_plan(var: DataFrame, target: float, sizes: tuple[int, ...] = (24, 28, 40, 60, 100), most: int = 200) -> DataFrame:
    """(datasets, resamples_needed, runs): the fewest resamples with a standard error of at most target / 2.8; null if not even `most` do."""
    plans = var.select("var_between", "var_within", F.explode(F.array(*map(F.lit, sizes))).alias("plan_datasets")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(most))))
    se = F.sqrt(F.col("var_between") / F.col("plan_datasets") + F.col("var_within") / (F.col("plan_datasets") * F.col("r")))
    out = plans.groupBy(F.col("plan_datasets").alias("datasets")).agg(F.min(F.when(se <= target / 2.8, F.col("r"))).alias("resamples_needed"))
    return out.withColumn("runs", 2 * F.col("datasets") * F.col("resamples_needed"))


def _segments(curve: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("e")
    return curve.select(*by, F.lag("e").over(w).alias("e0"), F.lag("d").over(w).alias("d0"), F.col("e").alias("e1"), F.col("d").alias("d1"), F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_k")).where("e0 IS NOT NULL")


def break_even(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, break_even): where a gain curve (e, d) first falls through zero, interpolated; null if it does not."""
    s = _segments(curve, by)
    at = F.col("e0") + (F.col("e1") - F.col("e0")) * F.col("d0") / (F.col("d0") - F.col("d1"))
    return s.groupBy(*by).agg(F.min(F.when((F.col("d0") > 0) & (F.col("d1") <= 0), at)).alias("break_even"))


def curve_at(curve: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """points (by, x) plus value and extrapolated: the curve (e, d) at x, the first segment that holds it, or the last segment carried on."""
    s = _segments(curve, by)
    inside = (F.col("e0") <= F.col("x")) & (F.col("x") <= F.col("e1"))
    slope = F.coalesce(F.try_divide(F.col("d1") - F.col("d0"), F.col("e1") - F.col("e0")), F.lit(0.0))
    hits = points.join(s, by)
    value = F.when(inside, F.col("d0") + slope * (F.col("x") - F.col("e0"))).otherwise(F.col("d1") + slope * (F.col("x") - F.col("e1")))
    rank = F.when(inside, F.col("_i")).when(F.col("_i") == F.col("_k"), F.lit(1_000_000))
    chosen = hits.where(rank.isNotNull()).groupBy(*by, "x").agg(F.min_by(F.struct(value.alias("value"), (~inside).alias("extrapolated")), rank).alias("_v"))
    return chosen.select(*by, "x", "_v.value", "_v.extrapolated")


def structured_gap(curve: DataFrame, teacher: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, gain, random_gain, gap): a labeller's gain at its own error rate x against random noise of that rate; teacher is (by, x, gain)."""
    at = curve_at(curve, teacher.select(*by, "x"), by)
    return teacher.join(at, [*by, "x"]).select(*by, "x", "gain", F.col("value").alias("random_gain"), (F.col("gain") - F.col("value")).alias("gap"), "extrapolated")


def edge_strata(rows: DataFrame, edge: str, value: str) -> DataFrame:
    """(stratum, n, mean): ahead and behind, by the sign of the edge (no edge counts as behind)."""
    return rows.groupBy(F.when(F.col(edge) > 0, "ahead").otherwise("behind").alias("stratum")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def labeller_table(preds: DataFrame, truth: DataFrame, models: list[str], combined: DataFrame | None = None) -> DataFrame:
    """(dataset, one column per model, best_single, ensemble): accuracies side by side; preds is (dataset, model, id, yhat), combined the ensemble's (dataset, id, yhat), if there is one."""
    if combined is not None:
        own = combined.join(truth, ["dataset", "id"]).groupBy("dataset").agg(_share(F.col("yhat") == F.col("y")).alias("ensemble"))
        return labeller_table(preds, truth, models).join(own, "dataset", "left")
    rows = preds.join(truth, ["dataset", "id"]).withColumn("ok", (F.col("yhat") == F.col("y")).cast("double"))
    wide = rows.groupBy("dataset").pivot("model", models).agg(F.avg("ok"))
    return wide.withColumn("best_single", F.greatest(*[F.col(f"`{m}`") for m in models]) if len(models) > 1 else F.col(f"`{models[0]}`"))


def time_split(marks: DataFrame) -> DataFrame:
    """(grp, transform_seconds, classify_seconds) from marks (grp, phase in start, transformed, classified, ts)."""
    at = lambda phase: F.max(F.when(F.col("phase") == phase, F.unix_micros(F.col("ts").cast("timestamp"))))
    out = marks.groupBy("grp").agg(at("start").alias("a"), at("transformed").alias("b"), at("classified").alias("c"))
    return out.select("grp", ((F.col("b") - F.col("a")) / 1e6).alias("transform_seconds"), ((F.col("c") - F.col("b")) / 1e6).alias("classify_seconds"))


def time_summary(times: DataFrame) -> DataFrame:
    """One row: totals, classify share, median and max-to-median of the classify times."""
    total = F.sum("transform_seconds") + F.sum("classify_seconds")
    sums = times.agg(F.sum("transform_seconds").alias("transform"), F.sum("classify_seconds").alias("classify"), F.try_divide(F.sum("classify_seconds"), total).alias("classify_share"), F.max("classify_seconds").alias("_most"))
    both = sums.crossJoin(exact_quantile(times, "classify_seconds", 0.5, "median"))  # a row each
    return both.withColumn("max_over_median", F.try_divide("_most", "median")).drop("_most")


def steadiness(times: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, spread, warm_up, excursion): the first group is warm-up and apart, the slowest other one is set aside; spread is the deviation of the rest over its mean. Null with fewer than two left."""
    by = by or []
    # a run's groups are few: they are what one run recorded
    rows = times.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("grp")))
    rest = rows.where("_i > 1").withColumn("_slow", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("classify_seconds"), "grp")))
    first = rows.where("_i = 1").select(*by, F.col("classify_seconds").alias("_first"))
    x = F.col("classify_seconds")
    kept = F.when(F.col("_slow") > 1, x)
    out = rest.groupBy(*by).agg(F.when(F.count(kept) >= 2, F.try_divide(F.stddev_pop(kept), F.avg(kept))).alias("spread"), F.avg(x).alias("_mean"), F.max(x).alias("_worst"))
    joined = out.join(first, by) if by else out.crossJoin(first)
    return joined.select(*by, "spread", F.try_divide("_first", "_mean").alias("warm_up"), F.try_divide("_worst", "_mean").alias("excursion"))


def sweep_table(rows: DataFrame, axis: str, value: str) -> DataFrame:
    """(axis, n, mean, vs_largest, wins, losses, p, complete): each setting against the largest, paired by dataset; complete tells whether it covers all of the largest's datasets."""
    top = rows.crossJoin(F.broadcast(rows.agg(F.max(axis).alias("_top"))))  # one row
    base = top.where(F.col(axis) == F.col("_top")).select("dataset", F.col(value).alias("_base"))
    n_all = F.broadcast(base.agg(F.count("*").alias("_all")))
    d = F.col(value) - F.col("_base")
    out = rows.join(base, "dataset").groupBy(axis).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(d).alias("vs_largest"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    return out.crossJoin(n_all).withColumn("complete", F.col("n") == F.col("_all")).withColumn("p", sign_test_p(F.col("wins"), F.col("losses"))).drop("_all")


def context_table(rows: DataFrame) -> DataFrame:
    """(frac, n, mean_delta, worst_delta, not_worse, mean_speedup): smaller contexts against the full one, paired by dataset; rows are (dataset, frac, accuracy, classify_seconds)."""
    full = rows.where("frac >= 1").select("dataset", F.col("accuracy").alias("_a"), F.col("classify_seconds").alias("_s"))
    d = F.col("accuracy") - F.col("_a")
    return rows.where("frac < 1").join(full, "dataset").groupBy("frac").agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.min(d).alias("worst_delta"), F.count_if(d >= 0).alias("not_worse"), F.avg(F.try_divide("_s", "classify_seconds")).alias("mean_speedup"))


def gate_table(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(learner, n, wins, mean_delta, median_delta, p, verdict): teacher minus student by learner; rows are (dataset, learner, teacher, student)."""
    out = delta_summary(rows.withColumn("_d", F.col("teacher") - F.col("student")), "_d", ["learner"])
    verdict = F.when((F.col("mean_delta") > 0) & (F.col("p") < alpha), "go").when(F.col("mean_delta") > 0, "underpowered").otherwise("stop")
    return out.select("learner", "n", "wins", "mean_delta", "median_delta", "p", verdict.alias("verdict"))


def route_report(rows: DataFrame) -> DataFrame:
    """(alternate, budget, stratum, n, mean_accuracy, mean_delta, wins, losses, p): routing against the primary alone; rows are (dataset, alternate, budget, accuracy, primary_accuracy, n_classes), strata all, binary, multiclass. See family_averages for alternates of the primary's own model against others."""
    d = F.col("accuracy") - F.col("primary_accuracy")
    strata = F.array(F.lit("all"), F.when(F.col("n_classes") == 2, "binary").otherwise("multiclass"))
    out = rows.withColumn("stratum", F.explode(strata)).groupBy("alternate", "budget", "stratum").agg(F.count("*").alias("n"), F.avg("accuracy").alias("mean_accuracy"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    return out.withColumn("p", sign_test_p(F.col("wins"), F.col("losses")))


def family_averages(rows: DataFrame, own: list[str]) -> DataFrame:
    """(budget, same_model, n, mean_delta): the gains of route_report's rows, averaged over alternates that are the primary's own model in another form (own) and over other models."""
    same = F.col("alternate").isin(own)
    return rows.groupBy("budget", same.alias("same_model")).agg(F.count("*").alias("n"), F.avg(F.col("accuracy") - F.col("primary_accuracy")).alias("mean_delta"))


def noise_floor(runs: DataFrame) -> DataFrame:
    """(dataset, n_seeds, mean_accuracy, sd, mean_gain) over seeds."""
    return runs.groupBy("dataset").agg(F.count("*").alias("n_seeds"), F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("sd"), F.avg("gain").alias("mean_gain"))
