"""Queries of evaluation, integrity and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from convseries.operators import ensemble, evaluate
from convseries.operators.ranking import new_folder
from convseries.plans.base import CUBE, MODELS, PREDS, RECORDS, SERIES, group_cube, predictions, query, r6, series, soft, supplier_records, table, truth
from convseries.plans.series_queries import binom_sf_sql, p_sql
from convseries.sources import series as src


def six(df, *cols):
    """df with doubles rounded."""
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(*[r6(c).alias(c) if c in doubles else F.col(c) for c in (cols or df.columns)])


@query("E1_accuracy", f"WITH {PREDS} SELECT model, count(*) AS n, round(avg((yhat = y)::INTEGER), 6) AS accuracy FROM preds JOIN truth USING (id) GROUP BY model")
def accuracy(spark, sf_dir):
    return six(evaluate.accuracy(predictions(spark, sf_dir).join(truth(spark, sf_dir), "id"), ["model"]))


@query("E1_mean_accuracies", f"WITH {PREDS}, d AS (SELECT id % 7 AS dataset, count(*) AS n, avg((yhat = y)::INTEGER) AS a FROM preds JOIN truth USING (id) GROUP BY 1) SELECT round(avg(a), 6) AS by_dataset, round(sum(a * n) / sum(n), 6) AS by_row FROM d")
def mean_accuracies(spark, sf_dir):
    rows = predictions(spark, sf_dir).join(truth(spark, sf_dir), "id").withColumn("dataset", F.col("id") % 7)
    return six(evaluate.mean_accuracies(rows))


@query("E2_alignment", f"WITH {CUBE}, q AS (SELECT DISTINCT grp, id FROM cube), i AS (SELECT id, count(*) AS k FROM q GROUP BY id), n AS (SELECT count(*) AS n FROM series) SELECT count(*) AS distinct_ids, sum(k)::BIGINT AS group_rows, min(k) AS min_groups, max(k) AS max_groups, count(*) = any_value(n) AND sum(k) = any_value(n) * 8 AND min(k) = 8 AND max(k) = 8 AS aligned FROM i, n")
def alignment(spark, sf_dir):
    return evaluate.alignment(group_cube(spark, sf_dir), series(spark, sf_dir).count(), 8)


@query("E3_duplicate_series", f"WITH {SERIES} SELECT count(*) AS series, count(DISTINCT vals) AS distinct_series, count(*) - count(DISTINCT vals) AS duplicates FROM series")
def duplicate_series(spark, sf_dir):
    return evaluate.duplicate_series(series(spark, sf_dir))


@query("E4_compare_predictions", f"WITH {PREDS}, a AS (SELECT id, yhat FROM preds WHERE model = 'm0'), b AS (SELECT id, yhat FROM preds WHERE model = 'm1'), j AS (SELECT a.id AS ia, b.id AS ib, a.yhat AS ya, b.yhat AS yb FROM a FULL JOIN b ON a.id = b.id) SELECT count_if(ib IS NULL)::BIGINT AS only_a, count_if(ia IS NULL)::BIGINT AS only_b, count_if(ia IS NOT NULL AND ib IS NOT NULL)::BIGINT AS in_both, count_if(ia IS NOT NULL AND ib IS NOT NULL AND ya <> yb)::BIGINT AS differ, 0::BIGINT AS duplicated FROM j")
def compare_predictions(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return evaluate.compare_predictions(p.where("model = 'm0'"), p.where("model = 'm1'"))


@query("E4_compare_labels", "WITH l AS (SELECT doc_id AS id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b, count(*) AS in_both, count_if(q <> t)::BIGINT AS differ, 0::BIGINT AS duplicated FROM l")
def compare_labels(spark, sf_dir):
    one = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return evaluate.compare_predictions(one.select("id", F.col("q").alias("yhat")), one.select("id", F.col("t").alias("yhat")))


@query("E5_conformance", f"WITH {SERIES}, v AS (SELECT (unnest(range(len(vals)))) AS k, unnest(vals) AS e FROM series), w AS (SELECT k, e, CASE WHEN k % 8 = 0 THEN e + 0.5 ELSE e END AS g FROM v) SELECT count(*) AS n_values, round(max(abs(e - g)), 6) AS max_abs, round(max(abs(e - g) / abs(nullif(e, 0))), 3) AS max_rel, count_if(abs(e - g) > 1e-6)::BIGINT AS beyond, count_if(k % 2 = 1 AND e <> g)::BIGINT AS ppv_differ FROM w")
def conformance(spark, sf_dir):
    s = series(spark, sf_dir).select("id", F.col("values").alias("features"))
    moved = s.withColumn("features", F.transform("features", lambda v, i: F.when(i % 8 == 0, v + 0.5).otherwise(v)))
    return six(evaluate.conformance(s, moved, ["id"], 1e-6).withColumn("max_rel", F.round("max_rel", 3)))


@query("E6_summarise", "SELECT l_suppkey, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY l_suppkey")
def summarise(spark, sf_dir):
    return six(evaluate.summarise(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_suppkey"]))


DELTAS = f"{RECORDS}, deltas AS (SELECT dataset, flag, setting, round(one - two, 6) AS d FROM records)"


@query("E7_paired_summary", f"WITH {RECORDS}, deltas AS (SELECT flag, one - two AS d FROM records), s AS (SELECT flag, count(*) AS n, count_if(d > 0)::BIGINT AS wins, count_if(d = 0)::BIGINT AS ties, count_if(d < 0)::BIGINT AS losses, avg(d) AS m, quantile_cont(d, 0.5) AS q, 2.8 * stddev_samp(d) / sqrt(count(*)) AS det FROM deltas GROUP BY flag) SELECT flag, n, wins, ties, losses, round(m, 6) AS mean_delta, round(q, 6) AS median_delta, round(det, 6) AS detectable, round({p_sql("wins", "losses")}, 6) AS p FROM s")
def paired_summary(spark, sf_dir):
    r = supplier_records(spark, sf_dir)
    keys = ["dataset", "flag", "setting"]
    return six(evaluate.paired_summary(r.select(*keys, F.col("one").alias("accuracy")), r.select(*keys, F.col("two").alias("accuracy")), keys, by=["flag"]))


@query("E8_sign_test", f"WITH {DELTAS}, s AS (SELECT dataset, count_if(d > 0)::BIGINT AS wins, count_if(d < 0)::BIGINT AS losses FROM deltas GROUP BY dataset) SELECT dataset, wins, losses, round({p_sql('wins', 'losses')}, 6) AS p FROM s")
def sign_test(spark, sf_dir):
    d = supplier_records(spark, sf_dir).withColumn("d", r6(F.col("one") - F.col("two")))
    return six(evaluate.sign_test(d, "d", ["dataset"]))


TAILS = "w AS (SELECT p.p_partkey AS name, count_if(l_returnflag = 'R')::BIGINT AS k, count(*) AS n FROM lineitem JOIN part p ON p.p_partkey = l_partkey GROUP BY 1)"


def _tails(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name")), F.col("l_partkey") == F.col("name"))
    return evaluate.binomial_tails(l.groupBy("name").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count("*").alias("n")), "k", "n", 0.3)


@query("E9_binom_sf", f"WITH {TAILS} SELECT name, k, n, round({binom_sf_sql('k', 'n', '0.3')}, 6) AS p_value FROM w")
def binom_tails(spark, sf_dir):
    return six(_tails(spark, sf_dir))


@query("E10_benjamini_hochberg", f"WITH {TAILS}, p AS (SELECT name, k, n, round({binom_sf_sql('k', 'n', '0.3')}, 9) AS p_value FROM w), r AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS rank, count(*) OVER () AS m FROM p), c AS (SELECT *, max(CASE WHEN p_value <= 0.3 * rank / m THEN rank ELSE 0 END) OVER () AS cut FROM r) SELECT name, k, n, round(p_value, 6) AS p_value, rank, round(coalesce(max(CASE WHEN rank = cut THEN p_value END) OVER (), 0.0), 6) AS threshold, rank <= cut AS survives FROM c")
def benjamini_hochberg(spark, sf_dir):
    rows = _tails(spark, sf_dir).withColumn("p_value", F.round("p_value", 9))
    return six(evaluate.benjamini_hochberg(rows, 0.3))


OVERLAP = "wrong AS (SELECT id % 5 AS dataset, id, model, yhat, (yhat <> y)::INTEGER::DOUBLE AS w FROM preds JOIN truth USING (id)), ov AS (SELECT a.dataset, a.model AS a, b.model AS b, avg(a.w * b.w) AS joint, avg(a.w) * avg(b.w) AS independent, avg((a.yhat <> b.yhat)::INTEGER) AS disagreement FROM wrong a JOIN wrong b ON a.id = b.id AND a.model < b.model GROUP BY ALL)"


def _overlap(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("dataset", F.col("id") % 5)
    t = truth(spark, sf_dir).withColumn("dataset", F.col("id") % 5)
    return evaluate.error_overlap(p, t, ["dataset"])


@query("E11_error_overlap", f"WITH {PREDS}, {OVERLAP} SELECT dataset, a, b, round(joint, 6) AS joint, round(independent, 6) AS independent, round(disagreement, 6) AS disagreement, round(joint / nullif(independent, 0), 6) AS ratio FROM ov")
def error_overlap(spark, sf_dir):
    return six(_overlap(spark, sf_dir))


@query("E12_overlap_report", f"WITH {PREDS}, {OVERLAP} SELECT a, b, count(*) AS n_datasets, round(avg(joint / nullif(independent, 0)), 6) AS mean_ratio, round(avg(joint), 6) AS mean_joint, round(avg(disagreement), 6) AS mean_disagreement FROM ov GROUP BY a, b")
def overlap_report(spark, sf_dir):
    return six(evaluate.overlap_report(_overlap(spark, sf_dir)))


@query("E13_compatible_runs", f"WITH {RECORDS}, r AS (SELECT dataset || '/' || setting AS dataset, flag AS model, CASE WHEN size > 100 THEN NULL ELSE floor(size)::BIGINT % 2 END AS cfg FROM records) SELECT r.dataset, r.model FROM r JOIN r b ON r.dataset = b.dataset AND b.model = 'A' AND r.cfg IS NOT DISTINCT FROM b.cfg")
def compatible_runs(spark, sf_dir):
    name = F.concat_ws("/", "dataset", F.col("setting").cast("string")).alias("dataset")
    runs = supplier_records(spark, sf_dir).select(name, F.col("flag").alias("model"), F.when(F.col("size") > 100, F.lit(None)).otherwise(F.floor("size") % 2).alias("cfg"))
    return evaluate.compatible_runs(runs, ["cfg"], "A").select("dataset", "model")


RUNS = f"{RECORDS}, runs AS (SELECT dataset, setting AS resample, round(avg(one) - avg(two), 6) AS delta FROM records GROUP BY ALL), per AS (SELECT dataset, avg(delta) AS m, var_samp(delta) AS v, count(*) AS r FROM runs GROUP BY dataset), split AS (SELECT count(*) AS datasets, avg(r) AS mean_resamples, avg(m) AS grand_mean, avg(v) AS var_within, var_samp(m) AS var_of_means FROM per), vs AS (SELECT *, CASE WHEN datasets >= 2 THEN var_of_means - var_within / mean_resamples END AS raw FROM split)"


def _campaign(spark, sf_dir):
    """(dataset, resample, arm, accuracy): arm A is 0 so that a pair's delta is B's rounded mean difference."""
    r = supplier_records(spark, sf_dir).groupBy("dataset", F.col("setting").alias("resample")).agg(r6(F.avg("one") - F.avg("two")).alias("b"))
    return r.select("dataset", "resample", F.explode(F.map_from_arrays(F.array(F.lit("A"), F.lit("B")), F.array(F.lit(0.0), F.col("b")))).alias("arm", "accuracy"))


@query("E14_variance_split", f"WITH {RUNS} SELECT datasets, round(mean_resamples, 6) AS mean_resamples, round(grand_mean, 6) AS grand_mean, round(var_within, 6) AS var_within, round(var_of_means, 6) AS var_of_means, round(raw, 6) AS var_between_raw, round(greatest(raw, 0.0), 6) AS var_between FROM vs")
def variance_split(spark, sf_dir):
    return six(evaluate.variance_split(_campaign(spark, sf_dir)))


@query("E15_power_plan", f"WITH {RUNS}, g AS (SELECT unnest([24, 28, 40, 60, 100])::INTEGER AS d, var_within AS w, greatest(raw, 0.0) AS b FROM vs), h AS (SELECT d, w, b, unnest(range(1, 201)) AS r FROM g) SELECT d AS datasets, min(CASE WHEN sqrt(b / d + w / (d * r)) <= 0.05 / 2.8 THEN r END)::INTEGER AS resamples_needed, (2 * d * min(CASE WHEN sqrt(b / d + w / (d * r)) <= 0.05 / 2.8 THEN r END))::INTEGER AS runs FROM h GROUP BY d")
def power_plan(spark, sf_dir):
    return evaluate.power_plan(evaluate.variance_split(_campaign(spark, sf_dir)), 0.05)


CURVES = f"{RECORDS}, curve AS (SELECT dataset, setting / 10.0 AS e, round(avg(one) - 0.5, 6) AS d FROM records GROUP BY ALL), seg AS (SELECT dataset, lag(e) OVER w AS e0, lag(d) OVER w AS d0, e AS e1, d AS d1, row_number() OVER w AS i, count(*) OVER (PARTITION BY dataset) AS k FROM curve WINDOW w AS (PARTITION BY dataset ORDER BY e)), s2 AS (SELECT * FROM seg WHERE e0 IS NOT NULL)"


def _curve(spark, sf_dir):
    return supplier_records(spark, sf_dir).groupBy("dataset", (F.col("setting") / 10).alias("e")).agg(r6(F.avg("one") - 0.5).alias("d"))


def _points(spark, sf_dir):
    """One point per supplier between 0 and 1, with a gain."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dataset")).agg(r6(0.1 + F.avg("l_quantity") / 60).alias("x"), r6(F.avg("l_tax")).alias("gain"))


POINTS = "points AS (SELECT 's' || l_suppkey::VARCHAR AS dataset, round(0.1 + avg(l_quantity) / 60, 6) AS x, round(avg(l_tax), 6) AS gain FROM lineitem GROUP BY 1)"


@query("E16_break_even", f"WITH {CURVES} SELECT dataset, round(min(CASE WHEN d0 > 0 AND d1 <= 0 THEN e0 + (e1 - e0) * d0 / (d0 - d1) END), 6) AS break_even FROM s2 GROUP BY dataset")
def break_even(spark, sf_dir):
    return six(evaluate.break_even(_curve(spark, sf_dir), ["dataset"]))


AT = "hit AS (SELECT p.dataset, p.x, p.gain, s.*, e0 <= x AND x <= e1 AS inside FROM points p JOIN s2 s ON s.dataset = p.dataset), best AS (SELECT dataset, x, gain, CASE WHEN inside THEN d0 + (d1 - d0) / (e1 - e0) * (x - e0) ELSE d1 + (d1 - d0) / (e1 - e0) * (x - e1) END AS value, NOT inside AS extrapolated FROM hit WHERE inside OR i = k QUALIFY row_number() OVER (PARTITION BY dataset, x ORDER BY CASE WHEN inside THEN i ELSE 1000000 END) = 1)"


@query("E17_curve_at", f"WITH {CURVES}, {POINTS}, {AT} SELECT dataset, x, round(value, 6) AS value, extrapolated FROM best")
def curve_at(spark, sf_dir):
    return six(evaluate.curve_at(_curve(spark, sf_dir), _points(spark, sf_dir).drop("gain"), ["dataset"]))


@query("E18_structured_gap", f"WITH {CURVES}, {POINTS}, {AT} SELECT dataset, x, gain, round(value, 6) AS random_gain, round(gain - value, 6) AS gap, extrapolated FROM best")
def structured_gap(spark, sf_dir):
    return six(evaluate.structured_gap(_curve(spark, sf_dir), _points(spark, sf_dir), ["dataset"]))


@query("E19_edge_strata", f"WITH {RECORDS} SELECT CASE WHEN round(one - two, 6) > 0 THEN 'ahead' ELSE 'behind' END AS stratum, count(*) AS n, round(avg(size), 6) AS mean FROM records GROUP BY 1")
def edge_strata(spark, sf_dir):
    return six(evaluate.edge_strata(supplier_records(spark, sf_dir).withColumn("edge", r6(F.col("one") - F.col("two"))), "edge", "size"))


@query("E20_labeller_table", f"WITH {PREDS}, sn AS (SELECT model, id, cls, p / sum(p) OVER (PARTITION BY model, id) AS p FROM soft), en AS (SELECT id, cls AS yhat FROM (SELECT id, cls, sum(p) AS s FROM sn GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s / 3, 12) DESC, cls) = 1), ea AS (SELECT id % 5 AS dataset, avg((yhat = y)::INTEGER) AS e FROM en JOIN truth USING (id) GROUP BY 1), a AS (SELECT id % 5 AS dataset, avg(CASE WHEN model = 'm0' THEN (yhat = y)::INTEGER END) AS m0, avg(CASE WHEN model = 'm1' THEN (yhat = y)::INTEGER END) AS m1, avg(CASE WHEN model = 'm2' THEN (yhat = y)::INTEGER END) AS m2 FROM preds JOIN truth USING (id) GROUP BY 1) SELECT dataset, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round(greatest(m0, m1, m2), 6) AS best_single, round(e, 6) AS ensemble FROM a JOIN ea USING (dataset)")
def labeller_table(spark, sf_dir):
    by5 = lambda df: df.withColumn("dataset", F.col("id") % 5)
    mean = ensemble.ensemble_models(soft(spark, sf_dir), MODELS).withColumn("mean_p", F.round("mean_p", 12))
    return six(evaluate.labeller_table(by5(predictions(spark, sf_dir)), by5(truth(spark, sf_dir)), MODELS, by5(ensemble.argmax_label(mean, ["id"]))))


MARKS = "marks AS (SELECT o_custkey AS grp, CASE o_orderkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'transformed' ELSE 'classified' END AS phase, o_orderdate AS ts FROM orders), times AS (SELECT grp, (max(CASE WHEN phase = 'transformed' THEN epoch_us(ts) END) - max(CASE WHEN phase = 'start' THEN epoch_us(ts) END)) / 1e6 AS t, (max(CASE WHEN phase = 'classified' THEN epoch_us(ts) END) - max(CASE WHEN phase = 'transformed' THEN epoch_us(ts) END)) / 1e6 AS c FROM marks GROUP BY grp)"


def _times(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    phase = F.when(F.col("o_orderkey") % 3 == 0, "start").when(F.col("o_orderkey") % 3 == 1, "transformed").otherwise("classified")
    return evaluate.time_split(o.select(F.col("o_custkey").alias("grp"), phase.alias("phase"), F.col("o_orderdate").alias("ts")))


@query("E21_time_split", f"WITH {MARKS} SELECT grp, round(t, 6) AS transform_seconds, round(c, 6) AS classify_seconds FROM times")
def time_split(spark, sf_dir):
    return six(_times(spark, sf_dir))


@query("E21_time_summary", f"WITH {MARKS} SELECT round(sum(t), 3) AS transform, round(sum(c), 3) AS classify, round(sum(c) / (sum(t) + sum(c)), 6) AS classify_share, round(quantile_cont(c, 0.5), 3) AS median, round(max(c) / quantile_cont(c, 0.5), 6) AS max_over_median FROM times")
def time_summary(spark, sf_dir):
    return evaluate.time_summary(_times(spark, sf_dir)).select(*[F.round(c, 3).alias(c) for c in ("transform", "classify", "median")], *[r6(c).alias(c) for c in ("classify_share", "max_over_median")])


STEADY = f"{RECORDS}, t AS (SELECT dataset, setting AS grp, round(sum(size), 6) AS c FROM records GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY grp) AS i FROM t), rest AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, grp) AS slow FROM i WHERE i > 1), o AS (SELECT dataset, CASE WHEN count(CASE WHEN slow > 1 THEN c END) >= 2 THEN stddev_pop(CASE WHEN slow > 1 THEN c END) / avg(CASE WHEN slow > 1 THEN c END) END AS spread, avg(c) AS m, max(c) AS w FROM rest GROUP BY dataset)"


@query("E22_steadiness", f"WITH {STEADY} SELECT o.dataset, round(spread, 6) AS spread, round(i.c / m, 6) AS warm_up, round(w / m, 6) AS excursion FROM o JOIN i ON i.dataset = o.dataset AND i.i = 1")
def steadiness(spark, sf_dir):
    t = supplier_records(spark, sf_dir).groupBy("dataset", F.col("setting").alias("grp")).agg(r6(F.sum("size")).alias("classify_seconds"))
    return six(evaluate.steadiness(t, ["dataset"]))


SETTINGS = f"{RECORDS}, rows0 AS (SELECT dataset, setting, round(avg(one), 6) AS accuracy, round(sum(size), 6) AS secs FROM records GROUP BY ALL)"


def _settings(spark, sf_dir):
    return supplier_records(spark, sf_dir).groupBy("dataset", "setting").agg(r6(F.avg("one")).alias("accuracy"), r6(F.sum("size")).alias("classify_seconds"))


@query("E23_sweep_table", f"WITH {SETTINGS}, b AS (SELECT dataset, accuracy AS a FROM rows0 WHERE setting = (SELECT max(setting) FROM rows0)), s AS (SELECT setting, count(*) AS n, avg(accuracy) AS m, avg(accuracy - a) AS v, count_if(accuracy > a)::BIGINT AS wins, count_if(accuracy < a)::BIGINT AS losses FROM rows0 JOIN b USING (dataset) GROUP BY setting) SELECT setting, n, round(m, 6) AS mean, round(v, 6) AS vs_largest, wins, losses, n = (SELECT count(*) FROM b) AS complete, round({p_sql('wins', 'losses')}, 6) AS p FROM s")
def sweep_table(spark, sf_dir):
    return six(evaluate.sweep_table(_settings(spark, sf_dir), "setting", "accuracy"))


@query("E24_context_table", f"WITH {SETTINGS}, f AS (SELECT dataset, accuracy AS a, secs AS s FROM rows0 WHERE setting = 7), d AS (SELECT setting / 7.0 AS frac, accuracy - a AS d, s / nullif(secs, 0) AS v FROM rows0 JOIN f USING (dataset) WHERE setting < 7) SELECT round(frac, 6) AS frac, count(*) AS n, round(avg(d), 6) AS mean_delta, round(min(d), 6) AS worst_delta, count_if(d >= 0)::BIGINT AS not_worse, round(avg(v), 6) AS mean_speedup FROM d GROUP BY frac")
def context_table(spark, sf_dir):
    return six(evaluate.context_table(_settings(spark, sf_dir).withColumn("frac", F.col("setting") / 7)))


@query("E25_gate_table", f"WITH {RECORDS}, g AS (SELECT flag AS learner, round(one - two, 6) AS d FROM records), s AS (SELECT learner, count(*) AS n, count_if(d > 0)::BIGINT AS wins, count_if(d < 0)::BIGINT AS losses, avg(d) AS m, quantile_cont(d, 0.5) AS q FROM g GROUP BY learner) SELECT learner, n, wins, round(m, 6) AS mean_delta, round(q, 6) AS median_delta, round({p_sql('wins', 'losses')}, 6) AS p, CASE WHEN m > 0 AND {p_sql('wins', 'losses')} < 0.05 THEN 'go' WHEN m > 0 THEN 'underpowered' ELSE 'stop' END AS verdict FROM s")
def gate_table(spark, sf_dir):
    rows = supplier_records(spark, sf_dir).select(F.concat_ws("/", "dataset", F.col("setting").cast("string")).alias("dataset"), F.col("flag").alias("learner"), r6(F.col("one") - F.col("two")).alias("teacher"), F.lit(0.0).alias("student"))
    return six(evaluate.gate_table(rows))


def _routed_runs(spark, sf_dir):
    return supplier_records(spark, sf_dir).select("dataset", F.col("flag").alias("alternate"), F.col("setting").alias("budget"), F.col("one").alias("accuracy"), F.col("two").alias("primary_accuracy"), F.when(F.col("size") > 100, 2).otherwise(3).alias("n_classes"))


@query("E26_route_report", f"WITH {RECORDS}, r AS (SELECT flag AS alternate, setting, one, two, CASE WHEN size > 100 THEN 'binary' ELSE 'multiclass' END AS s FROM records), x AS (SELECT alternate, setting, one, two, unnest(['all', s]) AS stratum FROM r) SELECT alternate, setting AS budget, stratum, count(*) AS n, round(avg(one), 6) AS mean_accuracy, round(avg(one - two), 6) AS mean_delta, count_if(one > two)::BIGINT AS wins, count_if(one < two)::BIGINT AS losses, round({p_sql('count_if(one > two)::BIGINT', 'count_if(one < two)::BIGINT')}, 6) AS p FROM x GROUP BY ALL")
def route_report(spark, sf_dir):
    return six(evaluate.route_report(_routed_runs(spark, sf_dir)))


@query("E26_family_averages", f"WITH {RECORDS} SELECT setting AS budget, flag IN ('A', 'N') AS same_model, count(*) AS n, round(avg(one - two), 6) AS mean_delta FROM records GROUP BY ALL")
def family_averages(spark, sf_dir):
    return six(evaluate.family_averages(_routed_runs(spark, sf_dir), ["A", "N"]))


@query("E27_noise_floor", f"WITH {RECORDS} SELECT dataset, count(*) AS n_seeds, round(avg(one), 6) AS mean_accuracy, round(stddev_samp(one), 6) AS sd, round(avg(two), 6) AS mean_gain FROM records GROUP BY dataset")
def noise_floor(spark, sf_dir):
    return six(evaluate.noise_floor(supplier_records(spark, sf_dir).withColumnsRenamed({"one": "accuracy", "two": "gain"})))


@query("S11_run_record", f"WITH {PREDS}, a AS (SELECT model, count(*) AS n_rows, round(avg((yhat = y)::INTEGER), 6) AS accuracy FROM preds JOIN truth USING (id) GROUP BY model) , i AS (SELECT id, count(DISTINCT model) AS k FROM preds GROUP BY id), n AS (SELECT count(*) AS n FROM series) SELECT model, n_rows, accuracy, 10000::BIGINT AS kernels, (SELECT count(*) FROM i) = (SELECT n FROM n) AND (SELECT min(k) = 3 AND max(k) = 3 FROM i) AS aligned, 0 AS failures FROM a")
def run_record(spark, sf_dir):
    """One record per model: its configuration, shape, result and the alignment of its predictions."""
    p = predictions(spark, sf_dir)
    whole = evaluate.alignment(p.withColumnRenamed("model", "grp"), series(spark, sf_dir).count(), len(MODELS)).select("aligned")
    runs = evaluate.accuracy(p.join(truth(spark, sf_dir), "id"), ["model"]).crossJoin(F.broadcast(whole))  # a row for each model, and one
    records = src.run_records(runs.withColumnRenamed("n", "n_rows").withColumn("kernels", F.lit(10000)), ["model", "kernels"], ["n_rows"], ["accuracy"], ["aligned"], F.array(F.when(~F.col("aligned"), F.lit("not aligned"))))
    return _records(records)


def _records(records):
    c = lambda column, key: F.col(column)[key]
    return records.select(
        c("config", "model").alias("model"), c("shape", "n_rows").cast("long").alias("n_rows"), r6(c("result", "accuracy")).alias("accuracy"), c("config", "kernels").cast("long").alias("kernels"),
        c("alignment", "aligned").cast("boolean").alias("aligned"), F.size("failures").alias("failures"),
    )


@query("S11_failed_runs", f"WITH {RECORDS}, r AS (SELECT dataset, count(*) AS n_runs, round(avg(one), 6) AS accuracy, count_if(size <= 50) AS small, count_if(two = 0) AS empty FROM records GROUP BY dataset) SELECT dataset, n_runs, accuracy, concat_ws('; ', CASE WHEN small > 0 THEN small::VARCHAR || ' runs are too small' END, CASE WHEN empty > 0 THEN empty::VARCHAR || ' runs have no gain' END) AS failures FROM r")
def failed_runs(spark, sf_dir):
    """A record for each dataset, written as JSON lines and read back, with what is wrong with its runs."""
    runs = supplier_records(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n_runs"), F.avg("one").alias("accuracy"), F.count_if(F.col("size") <= 50).alias("small"), F.count_if(F.col("two") == 0).alias("empty"))
    problem = lambda n, text: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(text)))
    records = src.run_records(runs, ["dataset"], ["n_runs"], ["accuracy"], [], F.array(problem("small", " runs are too small"), problem("empty", " runs have no gain"))).drop("alignment")
    path = new_folder(spark, "records")
    src.write_run(records, path)
    read = spark.read.schema(records.schema).json(path)
    return read.select(F.col("config")["dataset"].alias("dataset"), F.col("shape")["n_runs"].cast("long").alias("n_runs"), r6(F.col("result")["accuracy"]).alias("accuracy"), F.concat_ws("; ", "failures").alias("failures"))


@query("S10_write_run", f"WITH {PREDS} SELECT model, id, yhat FROM preds")
def write_run(spark, sf_dir):
    """Predictions through the JSON sink and back."""
    path = new_folder(spark, "predictions")
    src.write_run(predictions(spark, sf_dir), path)
    return spark.read.schema("model string, id long, yhat string").json(path)
