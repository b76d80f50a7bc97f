"""What holds at any size: exchanges in plans, selection without sorts, pruned joins and reads, batches that are run again."""

import itertools
import math
import os
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from convseries.operators import evaluate, heads, kernels, nearest, ranking, routing, statistics, transform
from convseries.plans import registry
from convseries.sources import series as src
from convseries.streaming import scoring


@pytest.fixture
def plans(monkeypatch):
    """The plans of what is written between steps."""
    found, kept = [], ranking.kept

    def noted(df):
        out = kept(df)
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ranking, "kept", noted)
    return found


def exchanges(plan):
    """Kinds of shuffles of a plan, the one that ran if it was changed on the way."""
    final = plan.split("== Initial Plan ==")[0]
    return re.findall(r"Exchange (\w+)", re.sub(r"BroadcastExchange \w+", "", final))


def test_global_ranks_take_one_exchange(spark, plans):
    rng = np.random.default_rng(0)
    rows = [(int(k), None if k % 50 == 0 else float(v)) for k, v in zip(rng.permutation(3000), rng.integers(0, 40, 3000))]
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    out = ranking.global_rank(df, [F.col("v").desc(), F.col("id")])
    assert exchanges(plans[0]).count("rangepartitioning") == 1 and set(exchanges(plans[0])) <= {"rangepartitioning", "RoundRobinPartitioning"}
    assert exchanges(out._jdf.queryExecution().executedPlan().toString()) == []
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r.id for r in sorted(out.collect(), key=lambda r: r["rank"])] == [i for i, _ in want]
    assert out.columns == ["id", "v", "rank"]
    same = ranking.global_rank(df.select(F.lit(1).alias("one")), [F.col("one")])  # ties throughout: dealt all the same
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 3001))
    assert ranking.global_rank(df.limit(0), [F.col("v")]).count() == 0


def test_quantiles_without_a_sort(spark, plans):
    rng = np.random.default_rng(1)
    odd = [-0.0, 0.0, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, 1.0, 1.0, 1.0]
    values = {"a": rng.normal(size=500).round(1).tolist(), "b": (rng.normal(size=77) * 10.0 ** rng.integers(-300, 300, 77)).tolist(), None: [3.5], "o": odd, "t": [2.0] * 40}
    rows = [(g, v) for g, own in values.items() for v in [*own, None]] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "v", qs).collect()}
    assert len(got) == len(values) * len(qs)
    for g, own in values.items():
        s = sorted(own)
        for q in qs:
            place = q * (len(s) - 1)
            lo, hi = s[math.floor(place)], s[math.ceil(place)]
            want = lo if lo == hi else lo + (hi - lo) * (place - math.floor(place))
            assert got[g, q] == want or got[g, q] == pytest.approx(want, rel=1e-12) or (math.isnan(want) and math.isnan(got[g, q])), (g, q)
    assert not any("rangepartitioning" in p or "Sort [_bits" in p for p in plans)
    nan = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "v double")
    assert ranking.exact_quantile(nan, "v", 0.5, "x").first()["x"] == 2.0
    assert ranking.exact_quantile(nan.where("v < 0"), "v", 0.5, "x").first()["x"] is None


def test_random_routing_ranks_all_draws_at_once(spark, plans):
    rng = np.random.default_rng(2)
    rows = [(k, *rng.choice(["a", "b"], 3).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, student string, alternate string, y string").repartition(3)
    got = {round(r.fraction, 6): r.accuracy for r in routing.route_random(df, 5, 3, 4).collect()}
    assert plans == []  # nothing is written on the way
    from convseries.functions.prng import stable_uniform

    u = [{r.id: r.u for r in df.select("id", stable_uniform(5, F.col("id"), d + 1).alias("u")).collect()} for d in range(3)]
    for k in range(5):
        right = []
        for d in range(3):
            first = set(sorted(range(200), key=lambda i: (u[d][i], i))[: round(200 * k / 4)])
            right.append(sum((alternate if i in first else student) == y for i, student, alternate, y in rows) / 200)
        assert got[k / 4] == pytest.approx(sum(right) / 3)


@pytest.mark.parametrize("rows_in_a_task", [10_000, 60])
def test_pivot_join_is_exact_and_looks_at_few_pairs(spark, monkeypatch, rows_in_a_task):
    monkeypatch.setattr(nearest, "ROWS", rows_in_a_task)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 5)) * 50
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 5))
    x[:300] = x[0]  # a fifth of the context is one point
    q = np.vstack([centres[rng.integers(0, 30, 500)] + rng.normal(size=(500, 5)), np.repeat(x[:1], 100, axis=0), rng.normal(size=(3, 5)) * 1000])
    context = spark.createDataFrame([(7 * i % 1500, f"c{i % 3}", x[i].tolist()) for i in range(1500)], "id long, label string, features array<double>").repartition(4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "row long, features array<double>").repartition(4)
    ids = np.array([7 * i % 1500 for i in range(1500)])
    got = {r.row: [(n.other, n.d, n.label) for n in r.near] for r in nearest.nearest_join(context, asked, 4, 1500).collect()}
    assert len(got) == len(q)
    for i, own in got.items():
        d = ((x - q[i]) ** 2).sum(axis=1)
        order = np.lexsort((ids, d))[:4]
        assert [n[0] for n in own] == ids[order].tolist() and [n[1] for n in own] == pytest.approx(d[order].tolist())
        assert [n[2] for n in own] == [f"c{k % 3}" for k in order]
    compared = nearest.near_rows(context, asked, 4, 1500).agg(F.sum("compared")).first()[0]
    assert compared < (0.45 if rows_in_a_task == 10_000 else 0.6) * len(q) * len(x)  # a fifth of the asked rows sit on the point of a fifth of the context
    few = nearest.nearest_join(context.limit(2), asked.limit(5), 4, 2).collect()
    assert [len(r.near) for r in few] == [2] * 5
    assert nearest.nearest_join(context, asked.limit(0), 4, 1500).count() == 0


def test_large_groups_are_not_solved_on_the_driver(spark, monkeypatch, plans):
    """What the driver fetches for a fit are sizes and classes."""
    from pyspark.sql.classic.dataframe import DataFrame

    fetched, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: fetched.append(self.columns) or collect(self))
    monkeypatch.setattr(heads, "MOST_CONTEXT", 40)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(g, i, "ab"[i % 2], rng.normal(size=3).tolist()) for g in range(3) for i in range(90)], "grp long, id long, label string, features array<double>")
    found = heads.fit_heads(df)
    assert fetched == [["grp", "label", "n"]]
    assert found.count() == 3


@pytest.mark.parametrize("k", [1, 2, 3])
def test_near_pairs(k):
    rng = np.random.default_rng(k)
    for n in (1, 2, 9, 100, 700):
        for x in (rng.normal(size=(n, k)), rng.integers(0, 3, (n, k)).astype(float)):
            for tol in (0.0, 0.2, 1.0):
                want = sum(int((np.abs(x[i + 1 :] - x[i]).max(axis=1) <= tol).sum()) for i in range(n - 1))
                assert statistics.near_pairs(x, tol)[0] == want
    small, large = (statistics.near_pairs(rng.normal(size=(n, k)), 0.2)[1] for n in (2000, 16_000))
    assert large < 0.15 * 16_000**2 / 2 and large < 0.5 * 64 * small  # 8 times the points: 64 times the pairs


def test_sample_entropy_against_all_pairs():
    x = np.sin(np.arange(300) / 5) + np.random.default_rng(0).normal(size=300) / 5
    tol, n = 0.2 * x.std(), len(x)
    count = {m: sum(max(abs(x[i + d] - x[j + d]) for d in range(m)) <= tol for i, j in itertools.combinations(range(n - 2), 2)) for m in (2, 3)}
    assert statistics.sample_entropy_of(x) == pytest.approx(-math.log(count[3] / count[2]))
    assert math.isnan(statistics.sample_entropy_of(np.array([1.0, np.nan] * 5))) and statistics.sample_entropy_of(np.zeros(9)) == pytest.approx(0.0)


def test_overlap_with_null_and_missing_answers(spark):
    rng = np.random.default_rng(5)
    preds = [(m, d, i, [None, "x", "y", "z"][rng.integers(0, 4)]) for m in "pqr" for d in "ab" for i in range(60) if rng.random() < 0.9]
    truth = {(d, i): "xyz"[i % 3] for d in "ab" for i in range(55)}
    out = evaluate.error_overlap(spark.createDataFrame(preds, "model string, dataset string, id long, yhat string"), spark.createDataFrame([(*k, y) for k, y in truth.items()], "dataset string, id long, y string"), ["dataset"])
    own = {(m, d, i): v for m, d, i, v in preds}
    mean = lambda v: sum(v) / len(v) if v else None
    for r in out.collect():
        both = [(own[r.a, r.dataset, i], own[r.b, r.dataset, i], truth[r.dataset, i]) for i in range(55) if (r.a, r.dataset, i) in own and (r.b, r.dataset, i) in own]
        wrong = lambda v, y: None if v is None else float(v != y)
        known = lambda f: mean([f(*x) for x in both if f(*x) is not None])
        joint = known(lambda a, b, y: None if None in (a, b) else wrong(a, y) * wrong(b, y))
        independent = known(lambda a, b, y: wrong(a, y)) * known(lambda a, b, y: wrong(b, y))
        assert (r.joint, r.independent) == pytest.approx((joint, independent))
        assert r.disagreement == pytest.approx(known(lambda a, b, y: None if None in (a, b) else float(a != b)))
    assert out.count() == 6


def test_production_bank_equals_the_loop(spark):
    """10,000 kernels, as the default ensemble has, one channel and three."""
    from test_transform import naive

    rng = np.random.default_rng(6)
    for channels, n, kind in ((1, 41, "array<array<double>>"), (3, 30, "array<array<double>>")):
        x = rng.normal(size=(1, channels, n))
        got = transform.conv_features(spark.createDataFrame([(0, x[0].tolist())], f"id long, values {kind}"), "values", 10_000, 9).first().features
        bank = kernels.draw_kernels(9, np.arange(10_000), n, channels)
        for k in range(0, 10_000, 37):
            assert got[2 * k : 2 * k + 2] == pytest.approx(naive(x[0].tolist(), bank[k]), abs=1e-12)


def test_groups_are_read_from_their_folders(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/groups"
    df = spark.createDataFrame([(i, "train" if i % 3 else "test", "c", [float(i + k) for k in range(8)]) for i in range(30)], "id long, split string, label string, features array<double>")
    src.write_group_features(src.group_features(df, 4, 2), path)
    out = src.read_group_features(spark, path, [1, 3], "test")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*grp#\d+ IN \(1,3\).*split#\d+ = test", plan) and "PushedFilters: []" in plan
    assert sorted((r.grp, r.id, tuple(r.features)) for r in out.collect()) == sorted((g, i, (float(i + 2 * g), float(i + 2 * g + 1))) for g in (1, 3) for i in range(0, 30, 3))
    assert src.read_group_features(spark, path).count() == 120


def test_run_records(spark):
    runs = spark.createDataFrame([("m", 10, 0.5, None), ("n", 3, 0.25, "bad")], "model string, n_rows long, accuracy double, problem string")
    found = src.run_records(runs, ["model"], ["n_rows"], ["accuracy"], [], F.array(F.col("problem"), F.lit(None).cast("string")))
    rows = {r.config["model"]: r for r in found.collect()}
    assert rows["m"].failures == [] and rows["n"].failures == ["bad"] and rows["n"].shape == {"n_rows": "3"} and rows["m"].result == {"accuracy": 0.5}
    assert [r.config["model"] for r in src.clean_runs(found).collect()] == ["m"]


def test_kernels_as_a_table_function(spark):
    transform.register(spark)
    rows = spark.sql("SELECT * FROM kernel_bank(3, 64, 5, 2)").collect()
    for i, length, weights, bias, dilation, padding, _ in kernels.draw_kernels(3, np.arange(2, 7), 64):
        own = sorted((r for r in rows if r.kernel_id == i), key=lambda r: r.j)
        assert [r.weight for r in own] == weights[0] and {(r.length, r.bias, r.dilation, r.padding, r.channel) for r in own} == {(length, bias, dilation, padding, 0)}
    assert spark.sql("SELECT b.* FROM VALUES (1), (9) AS k(first), LATERAL kernel_bank(3, 64, 2, k.first) b").select("kernel_id").distinct().count() == 4
    with pytest.raises(Exception, match="kernels_per_group"):
        spark.sql("SELECT * FROM kernel_bank(3, 64, 0, 2)").collect()


def test_reports_say_what_the_checks_say(spark):
    """Problems by column, against the messages of the functions that refuse."""
    sizes = [(k, g, e) for k in (0, 10, 40, 1000, 10_000, 50_000) for g in (-1, 0, 1, 4, 7, 40) for e in (0, 1, 3)]
    found = {(r.k, r.g, r.e): r.problem for r in spark.createDataFrame(sizes, "k long, g long, e long").withColumn("problem", kernels.config_problem(F.col("k"), F.col("g"), F.col("e"))).collect()}
    families = [(f, g, c) for f in ("kernels", "statistics", "both", "odd") for g in (1, 2) for c in (1, 3)]
    named = {(r.f, r.g, r.c): r.problem for r in spark.createDataFrame(families, "f string, g long, c long").withColumn("problem", statistics.family_problem(F.col("f"), F.col("g"), F.col("c"))).collect()}

    def message(f):
        try:
            f()
        except ValueError as e:
            return str(e)

    assert found == {s: message(lambda s=s: kernels.EnsembleConfig(*s).validate()) for s in sizes}
    assert named == {s: message(lambda s=s: statistics.check_family(*s)) for s in families}
    have = spark.createDataFrame([(["a", "B"],), ([],)], "have array<string>")
    assert [r[0] for r in have.select(src.missing_columns(F.col("have"), ["A", "b", "c"])).collect()] == [["c"], ["A", "b", "c"]]


class Halves:
    """Stands for an ensemble: answers `hard` for every row, or fails once."""

    def __init__(self):
        self.calls, self.fail_at = 0, None

    def predict(self, rows):
        self.calls += 1
        if self.calls == self.fail_at:
            return rows.select("id", F.when(F.col("id") % 5 == 4, F.raise_error(F.lit("lost"))).otherwise("hard").alias("yhat"))
        return rows.select("id", F.lit("hard").alias("yhat"))


def test_batches_that_are_run_again_count_once(spark):
    """A batch that fails half-way, a restart, and a batch whose commit got lost after the sink had written it."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "id long, values array<double>, student string, escalated boolean"
    for k in range(4):
        rows = spark.createDataFrame([(10 * k + i, [1.0], "easy", i % 2 == 0) for i in range(10)], schema)
        rows.repartition(2).write.mode("append").parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    out, check = f"{folder}/out", f"{folder}/check"
    ensemble = Halves()
    ensemble.fail_at = 3
    run = lambda: scoring.escalate_batches(stream(), ensemble, scoring.batch_folders(out), check).awaitTermination()
    answers = lambda: sorted((r.id, r.yhat, r.escalated) for r in scoring.committed_batches(spark, out, "id long, yhat string, escalated boolean").collect())
    assert answers() == []
    with pytest.raises(Exception, match="lost"):
        run()
    assert 0 < len(answers()) < 40
    run()
    want = sorted((i, "hard" if i % 10 % 2 == 0 else "easy", i % 10 % 2 == 0) for i in range(40))
    assert answers() == want
    commits = sorted(f for f in os.listdir(f"{check}/commits") if f.isdigit())
    for f in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{check}/commits/{f}")
    calls = ensemble.calls
    run()
    assert ensemble.calls == calls + 1 and answers() == want


# -- queries without SQL, against NumPy --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def embedded(sf):
    import pandas as pd

    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    return np.array(e["embedding"].tolist(), float), "c" + e["label"].astype(str).to_numpy(object), e["vec_id"].to_numpy()


def plain_ridge(x, y, classes):
    """Standardised ridge by the normal equations, the alpha by leave-one-out errors from the hat matrix: a scoring function, coefficients of the standardised features, alpha. y: labels, or targets for each class."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    if np.ndim(y) == 2:
        t = y
    else:
        t = np.where(np.array(y, object)[:, None] == np.array(classes, object), 1.0, -1.0)
        t = t[:, 1:] if len(classes) == 2 else t
    best = None
    for alpha in 10.0 ** np.linspace(-3, 3, 10):
        inverse = np.linalg.inv(a.T @ a + alpha * np.diag([0.0] + [1.0] * x.shape[1]))
        w = inverse @ a.T @ t
        error = (((t - a @ w) / (1 - np.einsum("ij,jk,ik->i", a, inverse, a))[:, None]) ** 2).mean()
        if best is None or error < best[0]:
            best = error, w, alpha
    return lambda z: np.column_stack([np.ones(len(z)), (z - mean) / sd]) @ best[1], best[1][1:], best[2]


def softmax(d):
    e = np.exp(d - d.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_group_heads_against_numpy(spark, sf, embedded):
    """C1, C8 and F8: probabilities, margins and coefficients of eight groups of eight points."""
    x, y, ids = embedded
    test = ids % 5 == 0
    classes = sorted(set(y[~test]))
    assert len(classes) > 2
    proba = {(r.grp, r.id, r["cls"]): r.p for r in registry.queries()["C1_classify_groups"](spark, sf).collect()}
    scored = {(r.grp, r.id): (r.student, r.margin) for r in registry.queries()["C8_score_with_margin"](spark, sf).collect()}
    size = {(r.grp, r.feature): r.magnitude for r in registry.queries()["F8_coef_magnitude"](spark, sf).collect()}
    assert len(proba) == 8 * test.sum() * len(classes) and len(scored) == 8 * test.sum() and len(size) == 64
    for g in range(8):
        own = x[:, 8 * g : 8 * g + 8]
        score, coef, _ = plain_ridge(own[~test], y[~test], classes)
        d = score(own[test])
        for i, row, p in zip(ids[test], d, softmax(d)):
            assert [proba[g, i, c] for c in classes] == pytest.approx(p.tolist(), abs=2e-6)
            assert scored[g, i][0] == classes[int(row.argmax())] and scored[g, i][1] == pytest.approx(np.sort(row)[-1] - np.sort(row)[-2], abs=2e-6)
        assert [size[g, k] for k in range(8)] == pytest.approx(np.abs(coef).mean(axis=1).tolist(), abs=2e-6)


def test_soft_targets_query_against_numpy(spark, sf, embedded):
    """C4: one-hot targets for training rows, the teacher's probabilities for the others."""
    from convseries.operators import ensemble
    from convseries.plans.base import group_cube

    x, y, ids = embedded
    test = ids % 5 == 0
    classes = sorted(set(y))
    teacher = {(r.id, r["cls"]): r.mean_p for r in ensemble.mean_proba(group_cube(spark, sf)).collect()}
    targets = np.array([[teacher.get((i, c), 0.0) if held else float(c == own) for c in classes] for i, own, held in zip(ids, y, test)])
    got = {(r.grp, r.id): r.yhat for r in registry.queries()["C4_soft_target_ridge"](spark, sf).collect()}
    assert len(got) == 8 * test.sum()
    for g in range(8):
        own = x[:, 8 * g : 8 * g + 8]
        d = plain_ridge(own, targets, classes)[0](own[test])
        for i, row in zip(ids[test], d):
            first, second = np.sort(row)[::-1][:2]
            assert got[g, i] == classes[int(row.argmax())] or first - second < 1e-9


def plain_features(x, k, seed):
    bank = kernels.draw_kernels(seed, np.arange(k), x.shape[1])
    from test_transform import naive

    return np.array([[v for kernel in bank for v in naive([row.tolist()], kernel)] for row in x])


def test_ensemble_query_against_numpy(spark, sf, embedded):
    """C9: 200 kernels in four groups, their mean probabilities."""
    x, y, ids = embedded
    test = ids % 5 == 0
    classes = sorted(set(y[~test]))
    f = np.array([r.features for r in transform.conv_features(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, values array<double>"), "values", 200, 7).orderBy("id").collect()])
    assert np.abs(f[:3] - plain_features(x[:3], 200, 7)).max() < 1e-12
    mean = sum(softmax(plain_ridge(own[~test], y[~test], classes)[0](own[test])) for own in np.split(f, 4, axis=1)) / 4
    got = {r.id: (r.yhat, r.confidence) for r in registry.queries()["C9_group_ensemble"](spark, sf).collect()}
    assert len(got) == test.sum()
    for i, p in zip(ids[test], mean):
        assert got[i][0] == classes[int(p.argmax())] and got[i][1] == pytest.approx(p.max(), abs=1e-5)


def test_production_ensemble_against_numpy(spark, sf, embedded):
    """The default ensemble, 10,000 kernels in 40 groups: some groups by the normal equations, all of them in the mean."""
    x, y, ids = embedded
    test = ids % 5 == 0
    classes = sorted(set(y[~test]))
    s = spark.createDataFrame([(int(i), v.tolist(), c) for i, v, c in zip(ids, x, y)], "id long, values array<double>, label string")
    model = heads.GroupEnsemble(kernels.EnsembleConfig(seed=7)).fit(s.where("id % 5 <> 0"))
    proba = {(r.grp, r.id): r.proba for r in model.group_proba(s.where("id % 5 = 0")).collect()}
    assert len(proba) == 40 * test.sum()
    bank = transform.Transformer(10_000, 7)
    f = np.array(bank(list(x)))
    for g in (0, 17, 39):
        own = f[:, 500 * g : 500 * g + 500]
        for i, p in zip(ids[test], softmax(plain_ridge(own[~test], y[~test], classes)[0](own[test]))):
            assert [proba[g, i][c] for c in classes] == pytest.approx(p.tolist(), abs=1e-5)
    got = {r.id: (r.yhat, r.confidence) for r in registry.queries()["C9_production_ensemble"](spark, sf).collect()}
    assert got.keys() == set(ids[test])
    for i, (label, confidence) in got.items():
        mean = {c: sum(proba[g, i][c] for g in range(40)) / 40 for c in classes}
        assert label == max(mean, key=mean.get) and confidence == pytest.approx(max(mean.values()), abs=1e-6)


def test_margins_and_serving_against_numpy(spark, sf, embedded):
    """M8, M11, M12, X1 and X3: out-of-fold margins, the deployed student, its threshold, and who answers whom."""
    from convseries.operators import sampling
    from convseries.plans.base import series

    x, y, ids = embedded
    test = ids % 5 == 0
    classes = sorted(set(y[~test]))
    train = series(spark, sf).where("split = 'train'")
    fold = {r.id: r.fold for r in sampling.stratified_folds(train, 5, 7).collect()}

    def out_of_fold(f, folds):
        own, at = np.array([folds[i] for i in ids[~test]]), {}
        for k in sorted(set(own)):
            d = plain_ridge(f[~test][own != k], y[~test][own != k], classes)[0](f[~test][own == k])
            at |= {i: row for i, row in zip(ids[~test][own == k], d)}
        return at

    margin = lambda row: np.sort(row)[-1] - np.sort(row)[-2]
    want = out_of_fold(x, fold)
    got = {r.id: r for r in registry.queries()["M8_oof_margins"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert (got[i].fold, got[i].student) == (fold[i], classes[int(row.argmax())]) and got[i].margin == pytest.approx(margin(row), abs=2e-6)

    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, values array<double>")
    for kernels_, query in ((100, "M12_serve"), (50, "X3_escalate_batches"), (50, "X1_score_stream")):
        f = np.array([r.features for r in transform.conv_features(df, "values", kernels_, 7).orderBy("id").collect()])[np.argsort(np.argsort(ids))]
        score, _, alpha = plain_ridge(f[~test], y[~test], classes)
        threshold = np.quantile([margin(row) for row in out_of_fold(f, {r.id: r.fold for r in sampling.stratified_folds(train, 5, 7).collect()}).values()], 0.2)
        if query == "X1_score_stream":  # the stream is normalised before it is scored
            f = np.array([r.features for r in transform.conv_features(df, "values", kernels_, 7, normalize=True).orderBy("id").collect()])[np.argsort(np.argsort(ids))]
        answers = {r.id: r for r in registry.queries()[query](spark, sf).collect()}
        asked = test if query == "M12_serve" else np.ones(len(ids), bool)
        assert answers.keys() == set(ids[asked])
        escalated = 0
        for i, row in zip(ids[asked], score(f[asked])):
            if abs(margin(row) - threshold) > 1e-6:
                assert answers[i].escalated == (margin(row) < threshold)
            if not answers[i].escalated or query == "X1_score_stream":
                assert (answers[i].student if query == "X1_score_stream" else answers[i].yhat) == classes[int(row.argmax())]
            escalated += answers[i].escalated
        assert query == "X1_score_stream" or 0 < escalated < asked.sum()
        if query == "M12_serve":
            deployed = registry.queries()["M11_deploy"](spark, sf).first()
            assert (deployed.n_classes, deployed.n_features, deployed.alpha) == (len(classes), 200, pytest.approx(alpha, abs=1e-6))


def test_stacks_on_a_fixed_split(spark):
    """N13 and N14 where the answer is known: the stacked scores tell the classes apart, and a fold whose other folds hold one class gets that class."""
    from convseries.operators import ensemble

    rng = np.random.default_rng(8)
    rows = [(i, "xyz"[i % 3], i // 3 % 3) for i in range(120)]
    stacked = spark.createDataFrame([(i, [float(k == i % 3) + rng.normal() / 200 for k in range(3)]) for i, _, _ in rows], "id long, stacked array<double>")
    truth = spark.createDataFrame(rows, "id long, y string, fold int")
    assert {r.id: r.yhat for r in ensemble.stack_logistic(stacked, truth).collect()} == {i: y for i, y, _ in rows}
    trees = {r.id: r.yhat for r in ensemble.stack_trees(stacked, truth, rounds=3).collect()}
    assert len(trees) == 120 and sum(trees[i] == y for i, y, _ in rows) >= 108
    one = truth.withColumn("fold", F.when(F.col("y") == "x", 0).otherwise(1))
    found = {r.id: r.yhat for r in ensemble.stack_logistic(stacked.where("id < 60"), one.where("id < 60")).collect()}
    assert {y for i, y in found.items() if i % 3} == {"x"} and not {y for i, y in found.items() if i % 3 == 0} & {"x"}
    assert ensemble.stack_logistic(stacked.limit(0), truth.limit(0)).count() == 0


def test_grid_weights_shuffle_counts_only(spark, monkeypatch):
    """All weightings are tried where an id stands; sums that differ by rounding only are ties, as in SQL."""
    from convseries.operators import ensemble

    rng = np.random.default_rng(5)
    soft = [(m, i, c, float(p)) for i in range(60) for m in ("a", "b", "c") for c, p in zip("xyz", rng.dirichlet([1, 1, 1]).round(2)) if i % 7 or m != "b" or c != "y"]
    soft += [(m, 60, c, p) for m, pair in (("a", (0.1, 0.3)), ("b", (0.2, 0.3)), ("c", (0.3, 0.0))) for c, p in zip("xy", pair)]  # 0.1 + 0.2 + 0.3 against 0.3 + 0.3
    truth = [(i, "xyz"[int(rng.integers(3))], i % 3) for i in range(61)]
    dfs = spark.createDataFrame(soft, "model string, id long, cls string, p double"), spark.createDataFrame(truth, "id long, y string, fold int")
    plans = []
    monkeypatch.setattr(ensemble, "kept", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), ranking.kept(df))[1])
    got = {r.id: (r.fold, r.w, round(r.train_accuracy, 9), r.yhat) for r in ensemble.grid_weights(*dfs, ["a", "b", "c"]).collect()}
    assert len(plans) == 2 and "MapInPandas" in plans[1]
    weights = [c for c in itertools.product(ensemble.STEPS, repeat=3) if sum(c) > 0]
    p = {(m, i, c): v for m, i, c, v in soft}

    def label(i, w):
        own = [c for c in "xyz" if any((m, i, c) in p for m in "abc")]
        return min(own, key=lambda c: (-round(sum(x * p.get((m, i, c), 0.0) for m, x in zip("abc", w)), 12), c))

    labels = {(i, k): label(i, w) for i, _, _ in truth for k, w in enumerate(weights)}
    for held in range(3):
        others = [(i, y) for i, y, f in truth if f != held]
        right = [sum(labels[i, k] == y for i, y in others) for k in range(len(weights))]
        k = right.index(max(right))
        for i, _, f in truth:
            if f == held:
                assert got[i] == (f, k, round(right[k] / len(others), 9), labels[i, k])
    assert ensemble.grid_weights(dfs[0].limit(0), dfs[1], ["a"]).count() == 0


def test_relational_transform_shuffles_points_only(spark):
    """One exchange, by series; series with missing points and taps outside come out as by sums over rows."""
    rng = np.random.default_rng(6)
    x = {i: {t: float(v) for t, v in enumerate(rng.normal(size=12 + i)) if i != 3 or t not in (0, 4, 5)} for i in range(5)}
    series = spark.createDataFrame([(i, t, v) for i, own in x.items() for t, v in own.items()], "id long, t long, value double").repartition(5)
    bank = kernels.bank_long(spark.range(6).withColumnRenamed("id", "kernel_id"), 7, 12)
    taps = ranking.kept(bank)
    out = transform.conv_features_relational(series, taps)
    got = {(r.id, r.kernel_id): (r.max, r.ppv) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([e for e in re.findall(r"Exchange hashpartitioning\((\w+)", re.sub(r"BroadcastExchange[^+]*", "", plan)) if e.startswith("_id")]) == 1
    rows = taps.collect()
    for k in range(6):
        own = {r.j: r.weight for r in rows if r.kernel_id == k}
        one = next(r for r in rows if r.kernel_id == k)
        for i, points in x.items():
            conv = []
            for o in range(max(points) + 1 + 2 * one.padding - (one.length - 1) * one.dilation):
                terms = [w * points[t] for j, w in own.items() if (t := o + j * one.dilation - one.padding) in points]
                conv += [one.bias + sum(terms)] if terms else []
            assert got[i, k] == (pytest.approx(max(conv), abs=1e-12), pytest.approx(np.mean([c > 0 for c in conv]))), (i, k)


def test_workers_hold_parts_of_batches(spark, monkeypatch):
    """What leaves a worker is bounded by bytes, whatever the rows of a batch."""
    monkeypatch.setattr(transform, "FEATURES", 400)
    wide = transform.conv_features(spark.range(50).select("id", F.array(*[F.sin(F.col("id") * 3 + k) for k in range(20)]).alias("values")).coalesce(1), "values", 20, 7, 0, 20)
    sizes = wide.mapInArrow(lambda batches: batches, wide.schema).select(F.spark_partition_id(), "id", F.size("features").alias("n")).collect()
    assert [r.n for r in sizes] == [40] * 50 and [r.id for r in sizes] == list(range(50))
    import pandas as pd

    parts = list(nearest._parts([pd.DataFrame({"a": range(2 * nearest.PLACED + 1)}), pd.DataFrame({"a": []})]))
    assert [len(p) for p in parts] == [nearest.PLACED, nearest.PLACED, 1]


def test_ensemble_scores_where_kernels_run(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], [math.sin((1 + i % 2) * t + i) for t in range(20)]) for i in range(30)], "id long, label string, values array<double>")
    model = heads.GroupEnsemble(kernels.EnsembleConfig(40, 4, 1, 3)).fit(rows)
    out = model.group_proba(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "features" not in plan
    scored = heads.decision_values(model.features(rows.select("id", "values")), model.heads)
    want = {(r.grp, r.id): r.proba for r in scored.select("grp", "id", heads.softmax_map(F.col("decision"), F.col("classes")).alias("proba")).collect()}
    got = {(r.grp, r.id): r.proba for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def fitted_groups(model, x, y, k, n_ref):
    """Holds each group's head against one fit in NumPy on the features of all rows."""
    classes = sorted(set(y) - {None})
    hot = np.where(np.array(y, object)[:, None] == np.array(classes, object), 1.0, -1.0)
    found = model.heads.orderBy("grp").collect()
    assert [r.grp for r in found] == list(range(model.config.n_groups))
    for r in found:
        z, mean, scale = heads._scaled(np.vstack(transform.Transformer(k, model.config.seed, r.grp * k, n_ref)(x)))
        coef, intercept, alpha = heads.fit_ridge(z, hot[:, 1:] if len(classes) == 2 else hot)
        assert r.classes == classes and r.alpha == pytest.approx(alpha)
        for a, b in ((r["mean"], mean), (r.scale, scale), (r.coef, coef), (r.intercept, intercept)):
            assert np.allclose(a, b, atol=1e-8)


@pytest.mark.parametrize("points", [1 << 22, 50_000])
def test_ensemble_is_fitted_from_all_rows(spark, monkeypatch, points):
    """No row is left out beyond 10,000, in one block of rows or in several."""
    monkeypatch.setattr(heads, "BLOCK_POINTS", points, raising=False)
    rng = np.random.default_rng(5)
    y = ["abc"[i % 3] for i in range(10_400)]
    x = [(rng.normal(size=12) + np.sin(np.arange(12) * "abc".index(c))).tolist() for c in y]
    rows = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(zip(y, x))], "id long, label string, values array<double>")
    fitted_groups(heads.GroupEnsemble(kernels.EnsembleConfig(24, 3, 1, 3)).fit(rows), x, y, 8, 12)


def test_ensemble_fits_channels_in_many_blocks(spark, monkeypatch):
    """Blocks of a row or none, whose sums meet in two rounds; two channels; a row without a label."""
    rng = np.random.default_rng(6)
    y = ["ab"[i % 2] if i else None for i in range(90)]
    x = [rng.normal(size=(2, 12 + i % 2)).tolist() for i in range(90)]
    rows = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(zip(y, x))], "id long, label string, values array<array<double>>")
    few = heads.GroupEnsemble(kernels.EnsembleConfig(12, 2, 1, 3)).fit(rows)
    fitted_groups(few, x, y, 6, 12)
    monkeypatch.setattr(heads, "MOST_CONTEXT", 40)
    monkeypatch.setattr(heads, "BLOCK_POINTS", 30)
    fitted_groups(heads.GroupEnsemble(kernels.EnsembleConfig(12, 2, 1, 3)).fit(rows), x, y, 6, 12)
