"""Queries of heads, ensembling, routing, sampling, serving and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from convseries.operators import ensemble, heads, routing, sampling, serving, statistics
from convseries.operators.kernels import EnsembleConfig
from convseries.operators.ranking import kept, new_folder
from convseries.operators.transform import conv_features
from convseries.plans.base import CUBE, LONG, MODELS, PREDS, RECORDS, ROUTED, SERIES, SOFT, group_cube, predictions, query, r6, routed_rows, series, soft, supplier_records, table, truth, uniform_ctes
from convseries.plans.series_queries import p_sql
from convseries.streaming import scoring

SEED = 7


def _groups(spark, sf_dir):
    """(grp, id, split, label, features): the series cut into 8 groups of 8 points, as group features."""
    from convseries.sources.series import group_features

    s = series(spark, sf_dir).withColumnRenamed("values", "features").withColumn("_y", F.col("label"))
    return group_features(s, 8, 8).withColumn("label", F.col("_y")).drop("_y")


# -- C: classification -------------------------------------------------------------------------------------------------


@query("C1_classify_groups")
def classify_groups(spark, sf_dir):
    g = _groups(spark, sf_dir)
    context = sampling.cap_context(series(spark, sf_dir).where("split = 'train'"), 4000, SEED).select("id")
    out = heads.classify_groups(g.where("split = 'train'").join(context, "id", "left_semi"), g.where("split = 'test'").drop("label"))
    return out.select("grp", "id", F.explode("proba").alias("cls", "p")).withColumn("p", r6("p"))


@query("C2_ridge_heads")
def ridge_heads(spark, sf_dir):
    fitted = heads.fit_heads(_groups(spark, sf_dir).where("split = 'train'"))
    return fitted.select("grp", F.size("classes").alias("n_classes"), r6("alpha").alias("alpha"), r6(F.aggregate("intercept", F.lit(0.0), lambda a, v: a + v)).alias("intercepts"))


@query("C3_decision_values")
def decision_values(spark, sf_dir):
    g = _groups(spark, sf_dir)
    fitted = heads.fit_heads(g.where("split = 'train'"))
    out = heads.decision_values(g.where("split = 'test'"), fitted)
    return out.select("grp", "id", heads.argmax_decision(F.col("decision"), F.col("classes")).alias("yhat"), r6(F.array_max("decision")).alias("top"))


@query("C4_soft_target_ridge")
def soft_target_ridge(spark, sf_dir):
    g = _groups(spark, sf_dir)
    classes = [r[0] for r in series(spark, sf_dir).select("label").distinct().orderBy("label").collect()]
    teacher = ensemble.mean_proba(group_cube(spark, sf_dir)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cls", "mean_p"))).alias("proba"))
    rows = g.join(teacher, "id").withColumn("label", F.when(F.col("split") == "train", F.col("label")))
    fitted = heads.soft_target_heads(rows, classes)
    out = heads.decision_values(g.where("split = 'test'"), fitted)
    return out.select("grp", "id", heads.argmax_decision(F.col("decision"), F.col("classes")).alias("yhat"))


VOTE_SQL = f"""WITH {SERIES},
d AS (SELECT a.id, b.id AS other, b.label, list_sum(list_transform(list_zip(a.vals, b.vals), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM series a, series b WHERE a.split = 'test' AND b.split = 'train'),
near AS (SELECT id, label, exp(min(d) OVER (PARTITION BY id) - d) AS w FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) <= 5),
classes AS (SELECT DISTINCT label AS cls FROM series WHERE split = 'train')
SELECT id, cls, round(sum(CASE WHEN label = cls THEN w ELSE 0 END) / sum(w), 6) AS p FROM near CROSS JOIN classes GROUP BY id, cls"""


@query("C5_context_vote", VOTE_SQL)
def context_vote(spark, sf_dir):
    s = series(spark, sf_dir).withColumnRenamed("values", "features")
    out = heads.context_vote(s.where("split = 'train'"), s.where("split = 'test'"), 1.0, 5)
    return out.select("id", F.explode("proba").alias("cls", "p")).withColumn("p", r6("p"))


@query("C6_test_chunks", f"WITH {SERIES} SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 32)::BIGINT AS chunk FROM series WHERE split = 'test'")
def test_chunks(spark, sf_dir):
    return heads.test_chunks(series(spark, sf_dir).where("split = 'test'"), 32).select("id", "chunk")


@query("C7_context_checks", f"WITH {SERIES} SELECT count(*) AS n_rows, count(DISTINCT label) AS n_classes, count(*) > 10000 AS too_many_rows, count(DISTINCT label) > 10 AS too_many_classes FROM series WHERE split = 'train'")
def context_checks(spark, sf_dir):
    return heads.context_checks(series(spark, sf_dir))


@query("C8_score_with_margin")
def score_with_margin(spark, sf_dir):
    g = _groups(spark, sf_dir)
    out = heads.score_with_margin(g.where("split = 'test'"), heads.fit_heads(g.where("split = 'train'")))
    return out.select("grp", "id", "student", r6("margin").alias("margin"))


def _ensemble(spark, sf_dir, kernels: int = 200, n_groups: int = 4):
    s = series(spark, sf_dir)
    return heads.GroupEnsemble(EnsembleConfig(kernels, n_groups, 1, SEED), 4000).fit(s.where("split = 'train'"))


@query("C9_group_ensemble")
def group_ensemble(spark, sf_dir):
    s = series(spark, sf_dir)
    return _ensemble(spark, sf_dir).predict(s.where("split = 'test'")).select("id", "yhat", r6("confidence").alias("confidence"))


@query("C9_production_ensemble")
def production_ensemble(spark, sf_dir):
    """The ensemble at its default size: 40 groups of 250 kernels, 20,000 features a series."""
    s = series(spark, sf_dir)
    model = heads.GroupEnsemble(EnsembleConfig(seed=SEED)).fit(s.where("split = 'train'"))
    return model.predict(s.where("split = 'test'")).select("id", "yhat", r6("confidence").alias("confidence"))


@query("F6_tune_block_weight")
def tune_block_weight(spark, sf_dir):
    wide = [f"f{k}" for k in range(64)]
    s = series(spark, sf_dir).where("split = 'train'")
    flat = statistics.standardize(s.select("id", "split", "label", *[F.get("values", F.lit(k)).alias(c) for k, c in enumerate(wide)]), wide)
    out = heads.tune_block_weight(flat.select("id", "label", F.array(*wide).alias("features")), 8, 3)
    return out.select("weight", r6("accuracy").alias("accuracy"))


@query("F8_coef_magnitude")
def coef_magnitude(spark, sf_dir):
    return heads.coef_magnitude(heads.fit_heads(_groups(spark, sf_dir).where("split = 'train'"))).select("grp", "feature", r6("magnitude").alias("magnitude"))


@query("F9_bootstrap_stability")
def bootstrap_stability(spark, sf_dir):
    s = series(spark, sf_dir).where("split = 'train'").select("id", "label", F.col("values").alias("features"))
    return heads.bootstrap_stability(s, 4, 5, SEED).select("feature", r6("frequency").alias("frequency"))


# -- N: ensembling -----------------------------------------------------------------------------------------------------

MEAN = f"{CUBE}, mean AS (SELECT id, cls, avg(p) AS mean_p, count(*) AS n_groups_seen FROM cube GROUP BY id, cls), labels_e AS (SELECT id, cls AS yhat, mean_p AS confidence FROM mean QUALIFY row_number() OVER (PARTITION BY id ORDER BY mean_p DESC, cls) = 1)"


@query("N1_mean_proba", f"WITH {MEAN} SELECT id, cls, round(mean_p, 6) AS mean_p, n_groups_seen FROM mean")
def mean_proba(spark, sf_dir):
    return ensemble.mean_proba(group_cube(spark, sf_dir)).select("id", "cls", r6("mean_p").alias("mean_p"), "n_groups_seen")


@query("N2_argmax_label", f"WITH {MEAN} SELECT id, yhat, round(confidence, 6) AS confidence FROM labels_e")
def argmax_label(spark, sf_dir):
    return ensemble.argmax_label(ensemble.mean_proba(group_cube(spark, sf_dir)), ["id"]).select("id", "yhat", r6("confidence").alias("confidence"))


@query("N3_dedup_scores", f"WITH {CUBE} SELECT grp::INTEGER AS grp, id, cls, p FROM cube")
def dedup_scores(spark, sf_dir):
    cube = group_cube(spark, sf_dir)
    return ensemble.dedup_scores(cube.unionByName(cube.where("id % 3 = 0")), ["grp", "id", "cls"])


@query("N4_join_on_vector", f"WITH {SERIES} SELECT a.id, b.id AS other FROM series a JOIN series b ON a.vals = b.vals")
def join_on_vector(spark, sf_dir):
    s = series(spark, sf_dir)
    return ensemble.join_on_vector(s.select("id", "values"), s.select(F.col("id").alias("other"), "values"), "values").select("id", "other")


@query("N5_group_accuracy", f"WITH {CUBE}, l AS (SELECT grp, id, cls FROM cube QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY p DESC, cls) = 1) SELECT grp::INTEGER AS grp, round(avg((cls = y)::INTEGER), 6) AS accuracy FROM l JOIN truth USING (id) GROUP BY ALL")
def group_accuracy(spark, sf_dir):
    return ensemble.group_accuracy(group_cube(spark, sf_dir), truth(spark, sf_dir)).select("grp", r6("accuracy").alias("accuracy"))


@query("N5_ensembling_gain", f"WITH {MEAN}, l AS (SELECT grp, id, cls FROM cube QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY p DESC, cls) = 1), g AS (SELECT avg(a) AS m FROM (SELECT avg((cls = y)::INTEGER) AS a FROM l JOIN truth USING (id) GROUP BY grp)), e AS (SELECT avg((yhat = y)::INTEGER) AS a FROM labels_e JOIN truth USING (id)) SELECT round(a, 6) AS ensemble_accuracy, round(m, 6) AS mean_group_accuracy, round(a - m, 6) AS gain FROM e, g")
def ensembling_gain(spark, sf_dir):
    out = ensemble.ensembling_gain(group_cube(spark, sf_dir), truth(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in ("ensemble_accuracy", "mean_group_accuracy", "gain")])


@query("N6_prefix_predictions", f"WITH {CUBE}, pre AS (SELECT grp + 1 AS n_groups, id, cls, avg(p) OVER (PARTITION BY id, cls ORDER BY grp ROWS UNBOUNDED PRECEDING) AS mean_p FROM cube) SELECT n_groups::INTEGER AS n_groups, id, cls AS yhat, round(mean_p, 6) AS confidence FROM pre QUALIFY row_number() OVER (PARTITION BY n_groups, id ORDER BY mean_p DESC, cls) = 1")
def prefix_predictions(spark, sf_dir):
    return ensemble.prefix_predictions(group_cube(spark, sf_dir)).select("n_groups", "id", "yhat", r6("confidence").alias("confidence"))


@query("N7_ensemble_models", f"WITH {SOFT}, s AS (SELECT model, id, cls, p / sum(p) OVER (PARTITION BY model, id) AS p FROM soft) SELECT id, cls, round(sum(p) / 3, 6) AS mean_p FROM s GROUP BY ALL")
def ensemble_models(spark, sf_dir):
    return ensemble.ensemble_models(soft(spark, sf_dir), MODELS).select("id", "cls", r6("mean_p").alias("mean_p"))


@query("N7_check_models", f"WITH {SOFT} SELECT model, count(DISTINCT id) AS n_rows, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM soft GROUP BY model")
def check_models(spark, sf_dir):
    return ensemble.check_models(soft(spark, sf_dir))


@query("N8_align_proba", f"WITH {SOFT}, k AS (SELECT DISTINCT model, id FROM soft), g AS (SELECT model, id, unnest(['c0', 'c1', 'c2', 'other']) AS cls FROM k), f AS (SELECT g.*, coalesce(s.p, 0.0) AS q FROM g LEFT JOIN soft s USING (model, id, cls)) SELECT model, id, cls, round(CASE WHEN sum(q) OVER (PARTITION BY model, id) > 0 THEN q / sum(q) OVER (PARTITION BY model, id) ELSE 0.0 END, 6) AS p FROM f")
def align_proba(spark, sf_dir):
    out = ensemble.align_proba(soft(spark, sf_dir), ["c0", "c1", "c2", "other"], ["model", "id"])
    return out.select("model", "id", "cls", r6("p").alias("p"))


@query("N9_most_confident", f"WITH {PREDS} SELECT id, model, yhat, round(confidence, 6) AS confidence FROM labels_m QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, model) = 1")
def most_confident(spark, sf_dir):
    return ensemble.most_confident(soft(spark, sf_dir)).select("id", "model", "yhat", r6("confidence").alias("confidence"))


@query("N9_pick_shares", f"WITH {PREDS}, b AS (SELECT model FROM labels_m QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, model) = 1) SELECT model, count(*) AS picks, round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) AS share FROM b GROUP BY model")
def pick_shares(spark, sf_dir):
    return ensemble.pick_shares(ensemble.most_confident(soft(spark, sf_dir))).select("model", "picks", r6("share").alias("share"))


@query("N10_max_margin", f"WITH {PREDS}, r AS (SELECT model, id, p, row_number() OVER (PARTITION BY model, id ORDER BY p DESC, cls) AS k FROM soft), m AS (SELECT model, id, max(CASE WHEN k = 1 THEN p END) - max(CASE WHEN k = 2 THEN p END) AS margin FROM r GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(margin, 9) DESC, model) = 1) SELECT b.id, b.model, p.yhat, round(margin, 6) AS margin FROM b JOIN preds p ON p.id = b.id AND p.model = b.model")
def max_margin(spark, sf_dir):
    return ensemble.max_margin(soft(spark, sf_dir)).select("id", "model", "yhat", r6("margin").alias("margin"))


@query("N11_majority_vote", f"WITH {PREDS}, v AS (SELECT id, yhat, count(*) AS votes FROM preds GROUP BY ALL) SELECT id, yhat, votes FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, yhat) = 1")
def majority_vote(spark, sf_dir):
    return ensemble.majority_vote(predictions(spark, sf_dir))


FOLDS = f"{SERIES}, {uniform_ctes('fu', 'series', 'id', SEED)}, folds AS (SELECT id, label AS y, ((row_number() OVER (PARTITION BY label ORDER BY u, id) - 1) % 3)::INTEGER AS fold FROM fu)"


def _folded(spark, sf_dir):
    return sampling.stratified_folds(series(spark, sf_dir).drop("values"), 3, SEED).select("id", F.col("label").alias("y"), "fold")


PREDS_FOLDS = PREDS + ", " + FOLDS.split("FROM embeddings), ", 1)[1]


GRID = """st AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS x), wg AS (SELECT row_number() OVER (ORDER BY a.x, b.x, c.x) - 1 AS w, a.x AS w0, b.x AS w1, c.x AS w2 FROM st a, st b, st c WHERE a.x + b.x + c.x > 0),
wide AS (SELECT id, cls, max(CASE WHEN model = 'm0' THEN p END) AS p0, max(CASE WHEN model = 'm1' THEN p END) AS p1, max(CASE WHEN model = 'm2' THEN p END) AS p2 FROM soft GROUP BY ALL),
wl AS (SELECT w, id, cls AS yhat FROM wide, wg QUALIFY row_number() OVER (PARTITION BY w, id ORDER BY round(w0 * p0 + w1 * p1 + w2 * p2, 12) DESC, cls) = 1),
ws AS (SELECT w, fold, count_if(yhat = y) AS k, count(*) AS n FROM wl JOIN folds USING (id) GROUP BY ALL), wh AS (SELECT DISTINCT fold AS held FROM folds),
wt AS (SELECT held, w, sum(k) / sum(n)::DOUBLE AS acc FROM ws JOIN wh ON fold <> held GROUP BY ALL), wb AS (SELECT * FROM wt QUALIFY row_number() OVER (PARTITION BY held ORDER BY acc DESC, w) = 1)"""


@query("N12_grid_weights", f"WITH {PREDS_FOLDS}, {GRID} SELECT f.fold, b.w, round(b.acc, 6) AS train_accuracy, l.id, l.yhat FROM wl l JOIN folds f USING (id) JOIN wb b ON b.held = f.fold AND b.w = l.w")
def grid_weights(spark, sf_dir):
    out = ensemble.grid_weights(kept(soft(spark, sf_dir)), kept(_folded(spark, sf_dir)), MODELS)
    return out.select("fold", "w", r6("train_accuracy").alias("train_accuracy"), "id", "yhat")


def _stacked(spark, sf_dir):
    classes = [r[0] for r in series(spark, sf_dir).select("label").distinct().orderBy("label").collect()]
    return ensemble.stacked_features(soft(spark, sf_dir), MODELS, classes), kept(_folded(spark, sf_dir))


@query("N13_stack_logistic")
def stack_logistic(spark, sf_dir):
    return ensemble.stack_logistic(*_stacked(spark, sf_dir))


@query("N14_stack_trees")
def stack_trees(spark, sf_dir):
    return ensemble.stack_trees(*_stacked(spark, sf_dir), rounds=3)


@query("N15_best_arm_control", f"WITH {PREDS_FOLDS}, r AS (SELECT p.model, p.id, p.yhat, f.y, f.fold FROM preds p JOIN folds f USING (id)), s AS (SELECT model, fold, count_if(yhat = y) AS k, count(*) AS n FROM r GROUP BY ALL), h AS (SELECT DISTINCT fold AS held FROM folds), t AS (SELECT held, model, sum(k) / sum(n)::DOUBLE AS acc FROM s JOIN h ON fold <> held GROUP BY ALL), b AS (SELECT held, model FROM t QUALIFY row_number() OVER (PARTITION BY held ORDER BY acc DESC, model) = 1) SELECT r.fold, r.model, r.id, r.yhat FROM r JOIN b ON r.fold = b.held AND r.model = b.model")
def best_arm_control(spark, sf_dir):
    return ensemble.best_arm_control(predictions(spark, sf_dir), _folded(spark, sf_dir))


@query("N16_oracle_bounds", f"WITH {PREDS}, r AS (SELECT id, max((yhat = y)::INTEGER) AS a, min((yhat = y)::INTEGER) AS b FROM preds JOIN truth USING (id) GROUP BY id) SELECT round(avg(a), 6) AS any_right, round(avg(1 - a), 6) AS none_right, round(avg(b), 6) AS all_right FROM r")
def oracle_bounds(spark, sf_dir):
    out = ensemble.oracle_bounds(predictions(spark, sf_dir), truth(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in ("any_right", "none_right", "all_right")])


@query("N16_alt_right_hist", f"WITH {PREDS}, r AS (SELECT id, max(CASE WHEN model = 'm0' THEN (yhat = y)::INTEGER END) AS f, sum(CASE WHEN model <> 'm0' THEN (yhat = y)::INTEGER ELSE 0 END)::BIGINT AS n_right FROM preds JOIN truth USING (id) GROUP BY id) SELECT n_right, count(*) AS rows FROM r WHERE f = 0 GROUP BY n_right")
def alt_right_hist(spark, sf_dir):
    return ensemble.alt_right_hist(predictions(spark, sf_dir), truth(spark, sf_dir), "m0")


# -- M: confidence and routing -----------------------------------------------------------------------------------------


@query("M1_proba_margin", f"WITH {SOFT}, r AS (SELECT model, id, p, row_number() OVER (PARTITION BY model, id ORDER BY p DESC, cls) AS k FROM soft) SELECT model, id, round(max(CASE WHEN k = 1 THEN p END) - max(CASE WHEN k = 2 THEN p END), 6) AS margin FROM r GROUP BY ALL")
def proba_margin(spark, sf_dir):
    return routing.proba_margin(soft(spark, sf_dir), ["model", "id"]).select("model", "id", r6("margin").alias("margin"))


@query("M2_decision_margin", f"WITH {SERIES}, s AS (SELECT id, vals, list_reverse_sort(vals) AS o FROM series) SELECT id, round(o[1] - o[2], 6) AS many, round(abs(vals[1]), 6) AS one FROM s")
def decision_margin(spark, sf_dir):
    return series(spark, sf_dir).select("id", r6(routing.decision_margin(F.col("values"))).alias("many"), r6(routing.decision_margin(F.slice("values", 1, 1))).alias("one"))


@query("M3_label_conf", f"WITH {SOFT}, s AS (SELECT id, cls, p / sum(p) OVER (PARTITION BY id) AS p FROM soft WHERE model = 'm0') SELECT id, cls AS yhat, round(p, 9) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, cls) = 1")
def label_conf(spark, sf_dir):
    out = routing.label_conf(soft(spark, sf_dir).where("model = 'm0'"), series(spark, sf_dir))
    return out.select("id", "yhat", F.round("confidence", 9).alias("confidence"))  # p has nine digits: no ties to round


RANKED = f"{ROUTED}, ranked AS (SELECT *, row_number() OVER (ORDER BY margin, id) AS rank, count(*) OVER () AS n FROM routed)"


@query("M4_route_fraction", f"WITH {RANKED} SELECT id, rank <= round_even(0.2 * n, 0) AS escalated, CASE WHEN rank <= round_even(0.2 * n, 0) THEN alternate ELSE student END AS yhat FROM ranked")
def route_fraction(spark, sf_dir):
    return routing.route_fraction(routed_rows(spark, sf_dir), 0.2)


CURVE = "SELECT fraction, round(avg((CASE WHEN rank <= round_even(fraction * n, 0) THEN alternate ELSE student END = y)::INTEGER), 6) AS accuracy FROM ranked, (SELECT unnest(range(21)) / 20.0 AS fraction) GROUP BY fraction"


@query("M5_route_curve", f"WITH {RANKED}, c AS ({CURVE}) SELECT round(fraction, 6) AS fraction, accuracy FROM c")
def route_curve(spark, sf_dir):
    return routing.route_curve(routed_rows(spark, sf_dir)).select(r6("fraction").alias("fraction"), r6("accuracy").alias("accuracy"))


def _random_sql(draws: int) -> str:
    parts = []
    for d in range(draws):
        parts.append(f"{uniform_ctes(f'ru{d}', 'routed', 'id', SEED, step=str(d + 1))}, rr{d} AS (SELECT *, row_number() OVER (ORDER BY u, id) AS rank, count(*) OVER () AS n FROM ru{d}), rc{d} AS ({CURVE.replace('FROM ranked', f'FROM rr{d}').replace('round(avg(', '(avg(').replace(', 6) AS accuracy', ') AS accuracy')})")
    union = " UNION ALL ".join(f"SELECT * FROM rc{d}" for d in range(draws))
    return f"WITH {ROUTED}, {', '.join(parts)} SELECT round(fraction, 6) AS fraction, round(avg(accuracy), 6) AS accuracy FROM ({union}) GROUP BY fraction"


@query("M6_route_random", _random_sql(2))
def route_random(spark, sf_dir):
    out = routing.route_random(kept(routed_rows(spark, sf_dir)), SEED, 2)
    return out.select(r6("fraction").alias("fraction"), r6("accuracy").alias("accuracy"))


@query("M7_route_signal", f"WITH {RECORDS}, c AS (SELECT dataset, setting / 10.0 AS fraction, round(avg(one), 6) AS a, round(avg(two), 6) AS b FROM records GROUP BY ALL) SELECT round(fraction, 6) AS fraction, round(avg(a - b), 6) AS signal, count_if(a > b)::BIGINT AS wins, count_if(a < b)::BIGINT AS losses, round({p_sql("count_if(a > b)::BIGINT", "count_if(a < b)::BIGINT")}, 6) AS p FROM c GROUP BY fraction")
def route_signal(spark, sf_dir):
    rows = supplier_records(spark, sf_dir).groupBy("dataset", (F.col("setting") / 10).alias("fraction")).agg(r6(F.avg("one")).alias("a"), r6(F.avg("two")).alias("b"))
    pick = lambda c: rows.select("dataset", "fraction", F.col(c).alias("accuracy"))
    return routing.route_signal(pick("a"), pick("b"), ["dataset"]).select(r6("fraction").alias("fraction"), r6("signal").alias("signal"), "wins", "losses", r6("p").alias("p"))


@query("M8_oof_margins")
def oof_margins(spark, sf_dir):
    s = sampling.cap_context(series(spark, sf_dir).where("split = 'train'"), 4000, SEED).select("id", "label", F.col("values").alias("features"))
    return heads.oof_margins(s, 5, SEED).select("id", "fold", "student", r6("margin").alias("margin"))


@query("M9_calibrate_threshold", f"WITH {ROUTED} SELECT round(quantile_cont(margin, 0.2), 6) AS threshold FROM routed")
def calibrate_threshold(spark, sf_dir):
    return routing.calibrate_threshold(routed_rows(spark, sf_dir), 0.2).select(r6("threshold").alias("threshold"))


@query("M10_route_threshold", f"WITH {ROUTED} SELECT id, margin < 0.02 AS escalated, CASE WHEN margin < 0.02 THEN alternate ELSE student END AS yhat FROM routed")
def route_threshold(spark, sf_dir):
    return routing.route_threshold(routed_rows(spark, sf_dir), 0.02)


@query("M10_threshold_report", f"WITH {RANKED}, t AS (SELECT quantile_cont(margin, 0.2) AS threshold FROM routed WHERE id % 5 <> 0), r AS (SELECT x.*, threshold, margin < threshold AS esc FROM ranked x, t) SELECT round(any_value(threshold), 6) AS threshold, round(avg(esc::INTEGER), 6) AS rate, round(avg((CASE WHEN esc THEN alternate ELSE student END = y)::INTEGER), 6) AS accuracy, round(avg((CASE WHEN rank <= round_even(0.2 * n, 0) THEN alternate ELSE student END = y)::INTEGER), 6) AS sorted_accuracy FROM r")
def threshold_report(spark, sf_dir):
    rows = kept(routed_rows(spark, sf_dir))
    out = routing.threshold_report(rows, rows.where("id % 5 <> 0"), 0.2)
    return out.select(*[r6(c).alias(c) for c in ("threshold", "rate", "accuracy", "sorted_accuracy")])


@query("M12_serve")
def serve(spark, sf_dir):
    s = series(spark, sf_dir)
    train, test = s.where("split = 'train'").select("id", "label", "values"), s.where("split = 'test'").select("id", "values")
    path = new_folder(spark, "deployed")
    serving.deploy(sampling.cap_context(train, 4000, SEED), path, 100, SEED, 0.2)
    student, meta = serving.load(spark, path)
    return serving.serve(test, student, meta, _ensemble(spark, sf_dir))


@query("M11_deploy")
def deploy(spark, sf_dir):
    train = sampling.cap_context(series(spark, sf_dir).where("split = 'train'"), 4000, SEED).select("id", "label", "values")
    path = new_folder(spark, "deployed")
    serving.deploy(train, path, 100, SEED, 0.2)
    return serving.load(spark, path)[0].select("grp", F.size("classes").alias("n_classes"), F.size("mean").alias("n_features"), r6("alpha").alias("alpha"))


@query("M13_fit_call_cost", "WITH a AS (SELECT o_orderstatus AS arm, count(DISTINCT o_custkey)::BIGINT AS calls, count(*) AS rows, (count(DISTINCT o_custkey) * 2.0 + count(*) * 0.25) AS seconds FROM orders GROUP BY 1), s AS (SELECT * FROM a ORDER BY rows, calls, seconds LIMIT 1), b AS (SELECT * FROM a ORDER BY rows DESC, calls DESC, seconds DESC LIMIT 1), f AS (SELECT s.*, (s.seconds * b.rows - b.seconds * s.rows) / nullif(s.calls * b.rows - b.calls * s.rows, 0) AS fixed FROM s, b) SELECT round(fixed, 4) AS fixed, round((seconds - calls * fixed) / rows, 4) AS marginal FROM f")
def fit_call_cost(spark, sf_dir):
    arms = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("calls"), F.count("*").alias("rows"))
    arms = arms.withColumn("seconds", F.col("calls") * F.lit(2.0) + F.col("rows") * F.lit(0.25))
    return routing.fit_call_cost(arms).select(F.round("fixed", 4).alias("fixed"), F.round("marginal", 4).alias("marginal"))


# -- H: sampling -------------------------------------------------------------------------------------------------------

QUOTA = """c AS (SELECT label, count(*) AS n FROM series GROUP BY label), t AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS classes FROM c),
b AS (SELECT *, least(n, 1 + floor(greatest(0, 103 - classes) * n / total::DOUBLE)::BIGINT) AS base FROM t), l AS (SELECT *, greatest(0, 103 - sum(base) OVER ()) AS spare FROM b),
un AS (SELECT label, n, base, spare, unnest(range(least(n - base, spare)::BIGINT)) AS k FROM l WHERE n > base), top AS (SELECT label FROM un QUALIFY row_number() OVER (ORDER BY n - base - k DESC, label) <= spare),
quota AS (SELECT l.label, CASE WHEN 103 >= total THEN n ELSE base + (SELECT count(*) FROM top WHERE top.label = l.label) END AS quota FROM l)"""


@query("H1_cap_context", f"WITH {SERIES}, {QUOTA}, {uniform_ctes('cu', 'series', 'id', SEED)}, rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY u, id) AS r FROM cu) SELECT id, rk.label FROM rk JOIN quota USING (label) WHERE r <= quota")
def cap_context(spark, sf_dir):
    return sampling.cap_context(series(spark, sf_dir), 103, SEED).select("id", "label")


@query("H2_resample_split", f"WITH {SERIES}, tr AS (SELECT label, count_if(split = 'train') AS k FROM series GROUP BY label), {uniform_ctes('cu', 'series', 'id', 3)}, rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY u, id) AS r FROM cu) SELECT id, label, CASE WHEN r <= k THEN 'train' ELSE 'test' END AS split FROM rk JOIN tr USING (label)")
def resample_split(spark, sf_dir):
    return sampling.resample_split(series(spark, sf_dir), 3).select("id", "label", "split")


@query("H2_split_sizes", f"WITH {SERIES} SELECT label, count_if(split = 'train')::BIGINT AS n_train, count_if(split = 'test')::BIGINT AS n_test FROM series GROUP BY label")
def split_sizes(spark, sf_dir):
    return sampling.split_sizes(sampling.resample_split(series(spark, sf_dir), 5))


@query("H3_stratified_folds", f"WITH {FOLDS} SELECT id, y, fold FROM folds")
def stratified_folds(spark, sf_dir):
    return _folded(spark, sf_dir)


@query("H4_pool_holdout", f"WITH {SERIES}, {uniform_ctes('cu', 'series', 'id', SEED + 2)}, c AS (SELECT label, count(*) AS n FROM series GROUP BY label), z AS (SELECT min(n) < 2 AS one, sum(n) AS everything FROM c), r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY u, id) AS r, row_number() OVER (ORDER BY u, id) AS ra FROM cu) SELECT id, CASE WHEN CASE WHEN one THEN ra <= everything // 2 ELSE r <= n // 2 END THEN 'pool' ELSE 'holdout' END AS part FROM r JOIN c USING (label), z")
def pool_holdout(spark, sf_dir):
    return sampling.pool_holdout(series(spark, sf_dir).drop("values"), SEED, 2).select("id", "part")


NOISE_CLASSES = ["c0", "c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "c9"]
NOISE_SEED = SEED * 1_000_000 + 20


@query("H5_corrupt_labels", f"WITH {SERIES}, {uniform_ctes('cu', 'series', 'id', NOISE_SEED)}, {uniform_ctes('cv', 'cu', 'id', NOISE_SEED, 'u2', '2')} SELECT id, CASE WHEN u < 0.2 THEN list_filter({NOISE_CLASSES}, lambda x: x <> label)[floor(u2 * 9)::BIGINT + 1] ELSE label END AS label FROM cv")
def corrupt_labels(spark, sf_dir):
    return sampling.corrupt_labels(series(spark, sf_dir), 0.2, NOISE_CLASSES, SEED).select("id", "label")


BOOT = f"""base0 AS (SELECT id, label FROM series WHERE split = 'train'), {uniform_ctes('bu', 'base0', 'id', SEED)}, base AS (SELECT id, label, row_number() OVER (ORDER BY u, id) AS r, count(*) OVER () AS n FROM bu),
slots AS (SELECT r, n, unnest(range(30))::BIGINT AS attempt FROM base), slots2 AS (SELECT *, attempt * n + r AS place FROM slots), {uniform_ctes('bs', 'slots2', 'place', SEED + 1, 'v')},
drawn AS (SELECT s.attempt, s.r AS slot, b.id, b.label FROM bs s JOIN base b ON b.r = floor(s.v * s.n)::BIGINT + 1),
good AS (SELECT attempt, row_number() OVER (ORDER BY attempt) AS draw FROM (SELECT attempt FROM drawn GROUP BY attempt HAVING count(DISTINCT label) = (SELECT count(DISTINCT label) FROM base)))"""


@query("H6_bootstrap", f"WITH {SERIES}, {BOOT} SELECT draw::INTEGER AS draw, slot, id, label FROM drawn JOIN good USING (attempt) WHERE draw <= 3")
def bootstrap(spark, sf_dir):
    return sampling.bootstrap(series(spark, sf_dir).where("split = 'train'"), 3, SEED)


ARMS_SQL = """pool AS (SELECT id, label FROM series WHERE split = 'test'), tr AS (SELECT id, label FROM series WHERE split = 'train'), teach AS (SELECT p.id, e.yhat, e.confidence FROM pool p JOIN labels_e e USING (id)),
half AS (SELECT id, yhat FROM teach QUALIFY row_number() OVER (ORDER BY round(confidence, 9) DESC, id) <= greatest(1, (SELECT count(*) FROM teach) // 2))"""


NOISY = f"{uniform_ctes('nu', 'pool', 'id', NOISE_SEED)}, {uniform_ctes('nv', 'nu', 'id', NOISE_SEED, 'u2', '2')}, noisy AS (SELECT id, CASE WHEN u < 0.2 THEN list_filter({NOISE_CLASSES}, lambda x: x <> label)[floor(u2 * 9)::BIGINT + 1] ELSE label END AS label FROM nv)"


@query("H7_label_arms", f"WITH {MEAN}, {ARMS_SQL}, {NOISY}, a AS (SELECT 'A' AS arm, * FROM tr UNION ALL SELECT 'B', * FROM tr UNION ALL SELECT 'B', id, yhat FROM teach UNION ALL SELECT 'C', * FROM tr UNION ALL SELECT 'C', * FROM pool UNION ALL SELECT 'Bc', * FROM tr UNION ALL SELECT 'Bc', * FROM half UNION ALL SELECT 'Bs', * FROM tr UNION ALL SELECT 'Bs', id, NULL FROM pool UNION ALL SELECT 'N20', * FROM tr UNION ALL SELECT 'N20', * FROM noisy) SELECT arm, id, label FROM a")
def label_arms(spark, sf_dir):
    s = series(spark, sf_dir)
    mean = ensemble.mean_proba(group_cube(spark, sf_dir))
    proba = mean.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cls", "mean_p"))).alias("proba"))
    teacher = ensemble.argmax_label(mean, ["id"]).withColumn("confidence", F.round("confidence", 9)).join(proba, "id")
    return sampling.label_arms(s.where("split = 'train'").select("id", "label"), s.where("split = 'test'").select("id", "label"), teacher, (0.2,), NOISE_CLASSES, SEED).select("arm", "id", "label")


@query("H8_confident_half", f"WITH {MEAN}, {ARMS_SQL} SELECT id, yhat FROM half")
def confident_half(spark, sf_dir):
    labels = ensemble.argmax_label(ensemble.mean_proba(group_cube(spark, sf_dir)), ["id"]).withColumn("confidence", F.round("confidence", 9))
    pool = series(spark, sf_dir).where("split = 'test'").select("id").join(labels, "id")
    return sampling.confident_half(pool).select("id", "yhat")


@query("H9_select_hard", f"WITH {RECORDS} SELECT dataset, round(max(one), 6) AS best FROM records GROUP BY dataset HAVING max(one) < 0.9")
def select_hard(spark, sf_dir):
    runs = supplier_records(spark, sf_dir).select("dataset", F.col("flag").alias("student"), F.col("one").alias("accuracy"))
    return sampling.select_hard(runs, 0.9).select("dataset", r6("best").alias("best"))


@query("H10_same_split", f"WITH {RECORDS} SELECT dataset, bool_and(setting = 1) AS same FROM records GROUP BY dataset")
def same_split(spark, sf_dir):
    return sampling.same_split(supplier_records(spark, sf_dir).withColumn("resample", F.col("setting")), 1, ["dataset"])


# -- X: streaming ------------------------------------------------------------------------------------------------------


def _drained(stream, spark, name: str):
    """What an available-now run of a stream writes, as a table in a new folder."""
    folder = new_folder(spark, "deployed")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _stream(spark, sf_dir, name: str):
    """A table as a stream: every file of its folder, or the one file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parque[t]")


@query("X1_score_stream")
def score_stream(spark, sf_dir):
    train = sampling.cap_context(series(spark, sf_dir).where("split = 'train'"), 4000, SEED).select("id", "label", "values")
    path = new_folder(spark, "deployed")
    serving.deploy(train, path, 50, SEED, 0.2)
    student, meta = serving.load(spark, path)
    rows = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))
    return _drained(scoring.score_stream(rows, student, meta).select("id", "student", "escalated"), spark, "scored")


@query("X2_series_from_events", "WITH w AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS start, value FROM events), m AS (SELECT max(ts) AS last FROM events) SELECT user_id, start, count(*) AS n, round(sum(value), 6) AS total FROM w, m WHERE start + INTERVAL '1 day' <= last - INTERVAL '1 hour' GROUP BY user_id, start")
def series_from_events(spark, sf_dir):
    out = _drained(scoring.series_from_events(_stream(spark, sf_dir, "events"), ["user_id"], "ts", "value"), spark, "windows")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return out.select("user_id", "start", F.size("values").cast("long").alias("n"), r6(total).alias("total"))


@query("X3_escalate_batches")
def escalate_batches(spark, sf_dir):
    s = series(spark, sf_dir)
    path = new_folder(spark, "deployed")
    serving.deploy(sampling.cap_context(s.where("split = 'train'"), 4000, SEED).select("id", "label", "values"), path, 50, SEED, 0.2)
    student, meta = serving.load(spark, path)
    rows = _stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))
    scored = scoring.score_stream(rows, student, meta, normalize=False)
    out = f"{path}/answers"
    scoring.escalate_batches(scored, _ensemble(spark, sf_dir, 100, 2), scoring.batch_folders(out), f"{path}/check").awaitTermination()
    return scoring.committed_batches(spark, out, "id long, yhat string, escalated boolean").drop("batch_id")
