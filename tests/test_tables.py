"""Ensembling, routing, sampling and evaluation on small tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from convseries.functions import stats
from convseries.operators import ensemble, evaluate, heads, ranking, routing, sampling, statistics
from convseries.sources import series as src


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def cube(spark):
    data = [(0, 1, "a", 0.9), (0, 1, "b", 0.1), (1, 1, "a", 0.2), (1, 1, "b", 0.8), (2, 1, "a", 0.3), (2, 1, "b", 0.7), (0, 2, "a", 0.5), (0, 2, "b", 0.5), (1, 2, "a", 0.5), (1, 2, "b", 0.5), (2, 2, "a", 0.5), (2, 2, "b", 0.5)]
    return spark.createDataFrame(data, "grp int, id long, cls string, p double")


def test_mean_then_argmax_and_ties(cube):
    mean = ensemble.mean_proba(cube)
    assert {(i, c): round(p, 6) for i, c, p, _ in rows(mean)}[(1, "b")] == round(1.6 / 3, 6)
    assert rows(ensemble.argmax_label(mean, ["id"]), "id", "yhat") == [(1, "b"), (2, "a")]
    assert rows(ensemble.prefix_predictions(cube).where("id = 1"), "n_groups", "yhat") == [(1, "a"), (2, "a"), (3, "b")]


def test_ensemble_needs_all_models(spark):
    soft = spark.createDataFrame([("m", 1, "a", 0.2), ("m", 1, "b", 0.2), ("n", 1, "a", 1.0), ("m", 2, "a", 1.0)], "model string, id long, cls string, p double")
    assert [(i, c, round(p, 6)) for i, c, p in rows(ensemble.ensemble_models(soft, ["m", "n"], check=False))] == [(1, "a", 0.75), (1, "b", 0.25)]
    aligned = ensemble.align_proba(soft.where("model = 'n'"), ["a", "b"], ["model", "id"])
    assert rows(aligned, "cls", "p") == [("a", 1.0), ("b", 0.0)]


def test_votes_margins_and_bounds(spark):
    preds = spark.createDataFrame([(m, i, y) for i, ys in ((1, "aabb"), (2, "abbb")) for m, y in zip("pqrs", ys)], "model string, id long, yhat string")
    assert rows(ensemble.majority_vote(preds), "id", "yhat") == [(1, "a"), (2, "b")]
    truth = spark.createDataFrame([(1, "b"), (2, "b")], "id long, y string")
    assert rows(ensemble.alt_right_hist(preds, truth, "p")) == [(2, 1), (3, 1)]
    assert rows(ensemble.oracle_bounds(preds, truth)) == [(1.0, 0.0, 0.0)]
    d = spark.createDataFrame([([-3.0],), ([1.0, 5.0, 4.0],)], "d array<double>").select(routing.decision_margin(F.col("d")).alias("m"))
    assert rows(d) == [(1.0,), (3.0,)]


def test_routing_rounds_half_to_even_and_breaks_ties_by_id(spark):
    data = spark.createDataFrame([(i, 0.1, "s", "t", "t") for i in range(5)], "id long, margin double, student string, alternate string, y string")
    assert rows(routing.route_fraction(data, 0.5), "id", "escalated") == [(0, True), (1, True), (2, False), (3, False), (4, False)]
    curve = {round(f, 2): a for f, a in rows(routing.route_curve(data))}
    assert len(curve) == 21 and curve[0.0] == 0 and curve[1.0] == 1 and curve[0.5] == 0.4
    margins = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "margin double")
    assert routing.calibrate_threshold(margins, 0.2).first()[0] == pytest.approx(1.6)
    assert rows(routing.route_threshold(data, 0.1), "escalated") == [(False,)] * 5


def test_cost_fit(spark):
    good = spark.createDataFrame([(1, 10, 3.0), (1, 110, 13.0)], "calls long, rows long, seconds double")
    assert rows(routing.fit_call_cost(good)) == [(pytest.approx(2.0), pytest.approx(0.1))]
    assert rows(routing.fit_call_cost(spark.createDataFrame([(1, 10, 3.0), (2, 20, 6.0)], good.schema))) == [(None, None)]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(97).select("id", F.when(F.col("id") < 5, "rare").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))


def test_samples_keep_their_properties(labelled):
    capped = sampling.cap_context(labelled, 12, 1)
    counts = dict(rows(capped.groupBy("label").count()))
    assert sum(counts.values()) == 12 and set(counts) == {"rare", "a", "b"}
    assert sampling.cap_context(labelled, 1000, 1).count() == 97
    again = sampling.resample_split(labelled, 2)
    assert rows(sampling.split_sizes(again)) == rows(sampling.split_sizes(labelled))
    assert rows(again) != rows(labelled.select(again.columns)) and sampling.resample_split(labelled, 0) is labelled
    folds = rows(sampling.stratified_folds(labelled, 4, 3).groupBy("label", "fold").count())
    for name in ("rare", "a", "b"):
        sizes = [n for label, _, n in folds if label == name]
        assert max(sizes) - min(sizes) <= 1
    halves = dict(((a, b), n) for a, b, n in rows(sampling.pool_holdout(labelled, 1, 0).groupBy("label", "part").count()))
    assert halves[("rare", "pool")] == 2 and halves[("rare", "holdout")] == 3


def test_noise_bootstrap_and_half(labelled, spark):
    noisy = sampling.corrupt_labels(labelled, 0.3, ["rare", "a", "b"], 5).select("id", F.col("label").alias("new")).join(labelled, "id")
    flipped = noisy.where("new <> label").count()
    assert 12 < flipped < 48 and noisy.where("new IS NULL").count() == 0
    assert sampling.corrupt_labels(labelled, 0.0, ["a"], 5).exceptAll(labelled).count() == 0
    boots = sampling.bootstrap(labelled, 3, 1)
    per = rows(boots.groupBy("draw").agg(F.count("*"), F.countDistinct("label")))
    assert [(n, k) for _, n, k in per] == [(97, 3)] * 3
    pool = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "id long, confidence double")
    assert rows(sampling.confident_half(pool), "id") == [(2,)]


def test_ranks(spark):
    df = spark.range(200).withColumn("v", (F.col("id") * 37 % 50).cast("double"))
    want = {r.id: k + 1 for k, r in enumerate(sorted(df.collect(), key=lambda r: (r.v, r.id)))}
    assert {r.id: r["rank"] for r in ranking.global_rank(df, [F.col("v"), F.col("id")]).collect()} == want
    u = df.withColumn("u", F.col("v") / 50)
    assert {r.id: r["rank"] for r in ranking.uniform_rank(u, [], F.col("u"), ["id"]).collect()} == want


def test_binomial_and_sign_tests(spark):
    cases = [(k, n) for n in (1, 7, 60) for k in (0, 1, n // 2, n, n + 1)]
    df = spark.createDataFrame(cases, "k long, n long")
    for k, n, p in rows(df.select("k", "n", stats.binom_sf(F.col("k"), F.col("n"), 0.3).alias("p"))):
        assert p == pytest.approx(sum(math.comb(n, i) * 0.3**i * 0.7 ** (n - i) for i in range(k, n + 1)), abs=1e-12)
    signs = spark.createDataFrame([(5, 0), (0, 0), (3, 3)], "w long, l long").select(stats.sign_test_p(F.col("w"), F.col("l")).alias("p"))
    assert sorted(r.p for r in signs.collect()) == pytest.approx([0.0625, 1.0, 1.0])


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "name string, p_value double")
    out = evaluate.benjamini_hochberg(df, 0.05)
    assert rows(out, "name", "survives") == [("a", True), ("b", True), ("c", True), ("d", False)] and {r.threshold for r in out.collect()} == {0.03}
    assert not any(r.survives for r in evaluate.benjamini_hochberg(df, 0.001).collect())


def test_variance_split_refuses_what_it_cannot_tell(spark):
    schema = "dataset string, resample int, arm string, accuracy double"
    full = [(d, k, arm, base + (0.1 * k if arm == "B" else 0)) for d, base in (("x", 0.5), ("y", 0.6)) for k in (1, 2, 3) for arm in "AB"]
    out = evaluate.variance_split(spark.createDataFrame(full + [("x", 9, "A", 0.1), ("y", 8, "B", None)], schema)).first()
    assert (out.datasets, out.mean_resamples) == (2, 3.0) and out.grand_mean == pytest.approx(0.2)
    assert out.var_within == pytest.approx(0.01) and out.var_between_raw == pytest.approx(-0.01 / 3) and out.var_between == 0.0
    one = evaluate.variance_split(spark.createDataFrame([r for r in full if r[0] == "x"], schema)).first()
    assert one.var_between_raw is None
    single = evaluate.variance_split(spark.createDataFrame([r for r in full if r[1] == 1], schema)).first()
    assert single.var_within is None and single.var_between_raw is None
    plan = {r.datasets: r.resamples_needed for r in evaluate.power_plan(evaluate.variance_split(spark.createDataFrame(full, schema)), 0.1).collect()}
    assert plan[24] == next(r for r in range(1, 201) if math.sqrt(0.01 / (24 * r)) <= 0.1 / 2.8)


def test_curves(spark):
    curve = spark.createDataFrame([("d", 0.0, 0.3), ("d", 0.2, 0.1), ("d", 0.4, -0.1)], "k string, e double, d double")
    assert evaluate.break_even(curve, ["k"]).first().break_even == pytest.approx(0.3)
    assert evaluate.break_even(curve.withColumn("d", F.col("d") + 1), ["k"]).first().break_even is None
    points = spark.createDataFrame([("d", 0.1), ("d", 0.5)], "k string, x double")
    assert [(x, round(v, 6), e) for _, x, v, e in rows(evaluate.curve_at(curve, points, ["k"]))] == [(0.1, 0.2, False), (0.5, -0.2, True)]


def test_predictions_times_and_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (4, "y")], "id long, yhat string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "x")], "id long, yhat string")
    assert rows(evaluate.compare_predictions(a, b)) == [(1, 1, 2, 1, 1)]
    same = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],), ([1.0],)], "values array<double>")
    assert rows(evaluate.duplicate_series(same)) == [(3, 2, 1)]
    times = spark.createDataFrame([(g, 0.1, s) for g, s in enumerate((9.0, 1.0, 1.0, 5.0, 1.0))], "grp int, transform_seconds double, classify_seconds double")
    steady = evaluate.steadiness(times).first()
    assert (steady.spread, steady.warm_up, steady.excursion) == (0.0, 4.5, 2.5)


def test_ridge_by_leave_one_out():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(15, 4)), rng.normal(size=(15, 2))
    alphas = np.array([0.1, 1.0, 10.0])
    coef, intercept, alpha = heads.fit_ridge(x, y, alphas)

    def plain(xs, ys, a):
        mx, my = xs.mean(0), ys.mean(0)
        w = np.linalg.solve((xs - mx).T @ (xs - mx) + a * np.eye(4), (xs - mx).T @ (ys - my))
        return w, my - mx @ w

    errors = {}
    for a in alphas:
        left_out = []
        for i in range(15):
            keep = np.arange(15) != i
            w, b = plain(x[keep], y[keep], a)
            left_out.append(y[i] - x[i] @ w - b)
        errors[a] = float(np.mean(np.square(left_out)))
    assert alpha == min(errors, key=errors.get)
    w, b = plain(x, y, alpha)
    assert coef == pytest.approx(w.T) and intercept == pytest.approx(b)


def test_group_ensemble_learns(spark):
    from convseries.operators.kernels import EnsembleConfig

    rng = np.random.default_rng(3)
    data = [(i, "ab"[i % 2], (np.sin(np.arange(40) * (0.3 if i % 2 else 1.1)) + 0.2 * rng.normal(size=40)).tolist()) for i in range(60)]
    df = spark.createDataFrame(data, "id long, label string, values array<double>")
    model = heads.GroupEnsemble(EnsembleConfig(60, 3)).fit(df.where("id < 40"))
    assert model.score(df.where("id >= 40")).first().accuracy > 0.9
    groups = model.group_proba(df.where("id >= 40"))
    assert evaluate.alignment(groups, 20, 3).first().aligned
    vote = heads.context_vote(df.where("id < 40").withColumnRenamed("values", "features"), df.where("id >= 40").withColumnRenamed("values", "features"), 1.0, 3)
    assert all(sum(r.proba.values()) == pytest.approx(1) for r in vote.collect())


def test_statistics(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0, 4.0, 6.0, 0.0]
    r = statistics.series_statistics(spark.createDataFrame([(x,)], "values array<double>")).first()
    assert r.number_peaks == 3 and r.longest_strike_above_mean == 4
    assert r.fft_coefficient_1_abs == pytest.approx(abs(np.fft.rfft(x)[1])) and r.fft_coefficient_5_abs is None
    assert r.quantile_q10 == pytest.approx(np.quantile(x, 0.1))
    want = statistics.sample_entropy_of(np.array(x))
    assert r.sample_entropy is None if math.isnan(want) else r.sample_entropy == pytest.approx(want)
    p = np.histogram(x, 10)[0] / 8
    assert r.binned_entropy == pytest.approx(-sum(v * math.log(v) for v in p if v))
    with pytest.raises(ValueError):
        statistics.check_family("statistics", 4, 1)


def test_attach_and_columns(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(Exception, match="no or several"):
        src.attach_features(a, spark.createDataFrame([(1, 5.0)], "id long, x double")).collect()
    with pytest.raises(ValueError, match="zz"):
        src.require_columns(a, ["ID", "zz"])


def _labelled(spark, n, classes, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(5, 2, (n, 4)) @ np.diag([1, 10, 0.1, 0])  # the last feature is constant
    y = [classes[int(v)] for v in (np.abs(x[:, 0] + x[:, 1] / 10 + rng.normal(0, 1, n)) / 4).astype(int) % len(classes)]
    rows = [(g, i, y[i], (x[i] * (g + 1)).tolist()) for g in range(2) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "grp long, id long, label string, features array<double>").repartition(5)


def test_large_contexts_fit_on_all_rows(spark, monkeypatch):
    for classes in (["a", "b"], ["a", "b", "c"]):
        x, y, df = _labelled(spark, 240, classes)
        monkeypatch.setattr(heads, "MOST_CONTEXT", 50)
        soft = df.withColumn("proba", F.when(F.col("id") % 3 == 0, F.create_map(F.lit("a"), F.lit(0.25), F.lit("b"), F.lit(0.75)))).withColumn("label", F.when(F.col("proba").isNull(), F.col("label")))
        found = heads.fit_heads(df).collect(), heads.soft_target_heads(soft, classes).collect()
        hot = np.array([[float(own == c) for c in classes] for own in y])
        mixed = np.array([[0.25, 0.75, 0.0][: len(classes)] if i % 3 == 0 else hot[i] for i in range(len(x))])
        for got, want in zip(found, (2 * (hot[:, 1:] if len(classes) == 2 else hot) - 1, mixed)):
            assert sorted(r.grp for r in got) == [0, 1]
            for r in got:
                z, mean, scale = heads._scaled(x * (r.grp + 1))
                coef, intercept, alpha = heads.fit_ridge(z, want)
                assert r.classes == classes and r.alpha == pytest.approx(alpha)
                for a, b in ((r["mean"], mean), (r.scale, scale), (r.coef, coef), (r.intercept, intercept)):
                    assert np.allclose(a, b, atol=1e-8)


def test_large_contexts_vote_with_all_rows(spark, monkeypatch):
    _, _, df = _labelled(spark, 240, ["a", "b", "c"])
    rows = df.where("grp = 0")
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    want = {r.id: r.proba for r in heads.context_vote(train, test).collect()}
    monkeypatch.setattr(heads, "MOST_CONTEXT", 25)
    got = {r.id: r.proba for r in heads.context_vote(train, test).collect()}
    assert got.keys() == want.keys() and len(got) == 60
    for i, proba in got.items():
        assert proba == pytest.approx(want[i])


@pytest.mark.parametrize("most", [10_000, 50])
def test_tuned_weights_and_stability_against_numpy(spark, monkeypatch, most):
    monkeypatch.setattr(heads, "MOST_CONTEXT", most)
    classes = ["a", "b", "c"]
    x, y, df = _labelled(spark, 240, classes)
    z = heads._scaled(x)[0]
    flat = spark.createDataFrame([(i, y[i], z[i].tolist()) for i in range(len(z))], "id long, label string, features array<double>")
    hot = 2 * np.array([[float(c == own) for c in classes] for own in y]) - 1
    fold = {r.id: r.fold for r in sampling.stratified_folds(flat, 3).collect()}
    fold = np.array([fold[i] for i in range(len(z))])
    want = {}
    for w in (0.01, 0.5, 50.0):
        v, right = z * np.array([1, w, w, w]), 0
        for f in range(3):
            coef, intercept, _ = heads.fit_ridge(v[fold != f], hot[fold != f])
            guess = (v[fold == f] @ coef.T + intercept).argmax(axis=1)
            right += sum(classes[g] == y[i] for g, i in zip(guess, np.flatnonzero(fold == f)))
        want[w] = right / len(z)
    got = {r.weight: r.accuracy for r in heads.tune_block_weight(flat, 1, 3, (0.01, 0.5, 50.0)).collect()}
    assert got == pytest.approx(want) and want[0.01] != want[0.5]
    counts, draws = np.zeros(4), {}
    for r in sampling.bootstrap(flat.select("id", "label"), 3, 7).collect():
        draws.setdefault(r.draw, []).append(r.id)
    for ids in draws.values():
        ids = sorted(ids)
        size = np.abs(heads.fit_ridge(heads._scaled(z[ids])[0], hot[ids])[0]).mean(axis=0)
        counts[np.argsort(-size, kind="stable")[:2]] += 1
    found = {r.feature: r.frequency for r in heads.bootstrap_stability(flat, 2, 3, 7).collect()}
    assert found == pytest.approx({k: c / 3 for k, c in enumerate(counts)})


def test_queries_take_all_groups_and_points(spark, sf):
    from convseries.plans import registry

    queries = registry.queries()
    assert queries["C4_soft_target_ridge"](spark, sf).select("grp").distinct().count() == 8
    assert queries["F6_tune_block_weight"](spark, sf).count() == 7
    assert queries["F9_bootstrap_stability"](spark, sf).count() == 64


def test_ridge_queries_equal_plain_fits(spark, sf):
    """C2 and C3 against ridge fits by the normal equations, whose leave-one-out errors come from the hat matrix."""
    import pandas as pd

    from convseries.plans import registry

    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    values, y = np.array(e["embedding"].tolist(), float), "c" + e["label"].astype(str).to_numpy(object)
    test = (e["vec_id"] % 5 == 0).to_numpy()
    alphas, chosen = {}, {}
    for grp in range(8):
        x, own = values[:, 8 * grp : 8 * grp + 8], y[~test]
        classes = sorted(set(own))
        x = (x - x[~test].mean(axis=0)) / x[~test].std(axis=0)
        ones = lambda a: np.column_stack([np.ones(len(a)), a])
        a, t = ones(x[~test]), np.where(own[:, None] == np.array(classes, object), 1.0, -1.0)
        best = None
        for alpha in 10.0 ** np.linspace(-3, 3, 10):
            inverse = np.linalg.inv(a.T @ a + alpha * np.diag([0.0] + [1.0] * 8))
            w = inverse @ a.T @ t
            error = (((t - a @ w) / (1 - np.einsum("ij,jk,ik->i", a, inverse, a))[:, None]) ** 2).mean()
            if best is None or error < best[0]:
                best = error, alpha, w
        alphas[grp] = (len(classes), best[1])
        scores = ones(x[test]) @ best[2]
        for i, row in zip(e["vec_id"][test], scores):
            chosen[grp, i] = classes[int(row.argmax())], row.max()
    fitted = {r.grp: r for r in registry.queries()["C2_ridge_heads"](spark, sf).collect()}
    assert {g: r.n_classes for g, r in fitted.items()} == {g: n for g, (n, _) in alphas.items()}
    assert [fitted[g].alpha for g in range(8)] == pytest.approx([alphas[g][1] for g in range(8)], abs=1e-6)
    got = {(r.grp, r.id): (r.yhat, r.top) for r in registry.queries()["C3_decision_values"](spark, sf).collect()}
    assert got.keys() == chosen.keys()
    for key, (label, top) in chosen.items():
        assert got[key][0] == label and got[key][1] == pytest.approx(top, abs=2e-6)


def test_models_must_know_the_same_classes(spark):
    soft = spark.createDataFrame([("m", 1, "a", 0.5), ("m", 1, "b", 0.5), ("n", 1, "a", 1.0)], "model string, id long, cls string, p double")
    with pytest.raises(ValueError, match="classes"):
        ensemble.ensemble_models(soft, ["m", "n"])
    with pytest.raises(ValueError, match="no probabilities of x"):
        ensemble.ensemble_models(soft, ["m", "x"])


def test_compare_predictions_with_missing_and_repeated_ids(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (5, "z"), (5, "z")], "id long, yhat string")
    b = spark.createDataFrame([(2, "y"), (3, "x"), (4, "w"), (5, "z")], "id long, yhat string")
    assert rows(evaluate.compare_predictions(a, b)) == [(1, 1, 3, 1, 1)]


def test_quantiles_from_two_order_statistics(spark):
    from convseries.operators.ranking import exact_quantile

    rng = np.random.default_rng(4)
    values = rng.normal(size=501).round(1).tolist()
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    for q in (0.0, 0.2, 0.37, 0.5, 1.0):
        assert exact_quantile(df, "v", q, "x").first()["x"] == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert exact_quantile(df.where("v IS NULL"), "v", 0.5, "x").first()["x"] is None
