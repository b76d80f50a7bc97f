"""Classifier heads on group features: ridge with leave-one-out, soft targets, context votes, and the ensemble object.

A head is fitted from all rows of its labelled context. Groups of at most MOST_CONTEXT rows are a task each; beyond
that the rows meet in partial sums of products (features x features), each group is solved in a task, and leave-one-out
errors take a second pass over blocks of rows. Heads are small (classes x features) and reach every partition of the rows
to score by broadcast.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convseries.functions.prng import let
from convseries.functions.series import slice_group
from convseries.operators import ensemble, routing, sampling
from convseries.operators.kernels import EnsembleConfig
from convseries.operators.nearest import matrix, nearest, nearest_join
from convseries.operators.ranking import global_rank, kept
from convseries.operators.transform import FEATURES, Transformer, conv_features

MOST_CONTEXT = 10_000
MOST_CLASSES = 10
#: Bytes of sums of products, or of eigenvectors, and points of series that a task of an ensemble's fit holds at most.
SUMS_BYTES, BLOCK_POINTS = 1 << 25, 1 << 22
ALPHAS = np.logspace(-3, 3, 10)

HEAD_SCHEMA = "grp long, classes array<string>, mean array<double>, scale array<double>, coef array<array<double>>, intercept array<double>, alpha double"


def fit_ridge(x: np.ndarray, targets: np.ndarray, alphas: np.ndarray = ALPHAS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (classes, features), intercepts and the alpha with the smallest squared leave-one-out error.

    With centred x = U S V', the prediction for a row without itself is off by e / (1 - h), h its leverage (the
    intercept adds 1 / n), so that one decomposition serves every alpha."""
    n = len(x)
    x_mean, y_mean = x.mean(axis=0), targets.mean(axis=0)
    u, s, vt = np.linalg.svd(x - x_mean, full_matrices=False)
    y = targets - y_mean
    uty = u.T @ y
    best = None
    for alpha in alphas:
        shrink = s**2 / (s**2 + alpha)
        leverage = (u**2 * shrink).sum(axis=1) + 1.0 / n
        error = (((y - u @ (shrink[:, None] * uty)) / np.maximum(1e-12, 1 - leverage)[:, None]) ** 2).mean()
        if best is None or error < best[0]:
            best = (error, alpha)
    coef = (vt.T @ ((s / (s**2 + best[1]))[:, None] * uty)).T
    return coef, y_mean - coef @ x_mean, float(best[1])


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    return (x - mean) / scale, mean, scale


def _hot(pdf, classes: list[str]) -> np.ndarray:  # noqa: ANN001
    """Targets -1 and 1, one column for two classes."""
    hot = np.where(pdf["label"].to_numpy()[:, None] == np.array(classes, object)[None, :], 1.0, -1.0)
    return hot[:, 1:] if len(classes) == 2 else hot


def _soft(pdf, classes: list[str]) -> np.ndarray:  # noqa: ANN001
    """One-hot for labelled rows, the given probabilities for others."""
    return np.array([[float(c == own) for c in classes] if own is not None else [dict(p).get(c, 0.0) for c in classes] for own, p in zip(pdf["label"], pdf["proba"])])


def _merge_sums(parts) -> tuple[int, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Rows, means and centred sums of products of the union of parts (Chan's update)."""
    n, mean, products = 0, 0.0, 0.0
    for m, other, more in parts:
        delta = other - mean
        products = products + more + np.outer(delta, delta) * (n * m / (n + m))
        mean, n = mean + delta * (m / (n + m)), n + m
    return n, mean, products


SUMS = "grp long, part int, n long, mean array<double>, products array<double>"
SOLVED = "grp long, n long, mean array<double>, scale array<double>, y_mean array<double>, values array<double>, vectors array<double>, weights array<double>"


def _solve(n: int, mean: np.ndarray, products: np.ndarray, d: int, scaled: bool) -> tuple:
    """What a group's sums say of all alphas: mean and scale of d features, means of the targets, eigenvalues and eigenvectors of the scaled products and the targets in their terms."""
    scale = np.sqrt(np.maximum(0.0, products.diagonal()[:d]) / n)
    scale = np.where((scale > 1e-12 * np.abs(mean[:d])) & scaled, scale, 1.0)
    values, vectors = np.linalg.eigh(products[:d, :d] / np.outer(scale, scale))
    return mean[:d], scale, mean[d:], np.maximum(0.0, values), vectors, vectors.T @ (products[:d, d:] / scale[:, None])


def _sums_of(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """What _merge_sums joins: rows, means and centred sums of products of features and targets."""
    both = np.hstack([x, y])
    mean = both.mean(axis=0)
    centred = both - mean
    return len(both), mean, centred.T @ centred


def _sums_frame(rows: list[tuple]):  # noqa: ANN202
    import pandas as pd

    return pd.DataFrame([(g, part, n, mean, products.ravel()) for g, part, (n, mean, products) in rows], columns=["grp", "part", "n", "mean", "products"])


def _united(pdf) -> tuple[int, np.ndarray, np.ndarray]:  # noqa: ANN001
    return _merge_sums((int(r.n), r.mean_, r.products.reshape(len(r.mean_), -1)) for r in pdf.rename(columns={"mean": "mean_"}).sort_values("part", kind="stable").itertuples())


def _merged(sums: DataFrame) -> DataFrame:
    """Sums of a group's part, joined."""
    return sums.groupBy("grp", "part").applyInPandas(lambda pdf: _sums_frame([(pdf["grp"].iloc[0], pdf["part"].iloc[0], _united(pdf))]), SUMS)


def _solved(sums: DataFrame, targets, classes: dict[int, list[str]], scaled: bool) -> DataFrame:  # noqa: ANN001
    """Each group's sums solved in a task."""

    def solve(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        n, mean, products = _united(pdf)
        own = classes[int(pdf["grp"].iloc[0])]
        d = len(mean) - (1 if len(own) == 2 and targets is _hot else len(own))
        found = _solve(n, mean, products, d, scaled)
        return pd.DataFrame([(pdf["grp"].iloc[0], n, *(x.ravel() for x in found))], columns=["grp", "n", "mean", "scale", "y_mean", "values", "vectors", "weights"])

    return kept(sums.groupBy("grp").applyInPandas(solve, SOLVED))


def _parts(r) -> tuple:  # noqa: ANN001
    """A row of SOLVED as matrices."""
    d = len(r["mean"])
    return r["n"], r["mean"], r["scale"], r["y_mean"], r["values"], r["vectors"].reshape(d, d), r["weights"].reshape(d, -1)


def _left_out(x: np.ndarray, y: np.ndarray, parts: tuple) -> np.ndarray:
    """The sum of the rows' squared leave-one-out errors at every alpha, as in fit_ridge."""
    n, mean, scale, y_mean, values, vectors, weights = parts
    z = (x - mean) / scale @ vectors
    shrink = 1 / (values[:, None] + ALPHAS)
    off = (y - y_mean)[:, None, :] - (z @ (shrink[:, :, None] * weights[:, None, :]).reshape(len(values), -1)).reshape(len(z), len(ALPHAS), -1)
    leverage = z**2 @ shrink + 1.0 / n
    return ((off / np.maximum(1e-12, 1 - leverage)[:, :, None]) ** 2).sum(axis=(0, 2))


def _best(solved: DataFrame, errors: DataFrame, classes: dict[int, list[str]]) -> DataFrame:
    """Heads at the alphas with the smallest errors (grp, k, error), which are summed over blocks of rows."""

    def head(solved):  # noqa: ANN001, ANN202
        import pandas as pd

        r = solved.iloc[0]
        _, mean, scale, y_mean, values, vectors, weights = _parts(r)
        alpha = float(ALPHAS[r["k"]])
        coef = (vectors @ (weights / (values + alpha)[:, None])).T
        return pd.DataFrame({"grp": [r["grp"]], "classes": [classes[int(r["grp"])]], "mean": [mean], "scale": [scale], "coef": [list(coef)], "intercept": [y_mean], "alpha": [alpha]})

    least = errors.groupBy("grp", "k").agg(F.sum("error").alias("error")).groupBy("grp").agg(F.min_by("k", F.struct("error", "k")).alias("k"))
    return solved.join(least, "grp").groupBy("grp").applyInPandas(head, HEAD_SCHEMA)


ERRORS = "grp long, k int, error double"


def _fit_sums(rows: DataFrame, targets, classes: dict[int, list[str]], scaled: bool, sizes: dict[int, int]) -> DataFrame:  # noqa: ANN001
    """Heads from all rows of (grp, id, label, proba, features), however many a group has.

    Each partition sums its products, which meet in two rounds; a task for each group finds its eigenvectors, and blocks of
    MOST_CONTEXT rows meet them for each row's leave-one-out error at every alpha, as in fit_ridge. The driver sees sizes and
    class lists only; a task holds features x features numbers of one group and one block of rows."""
    import pandas as pd

    def sums(batches):  # noqa: ANN001, ANN202
        from pyspark import TaskContext

        found = {}
        for batch in batches:
            for grp, part in batch.groupby("grp"):
                own = _sums_of(np.vstack(part["features"].to_numpy()).astype(float), targets(part, classes[int(grp)]))
                found[int(grp)] = _merge_sums([found[int(grp)], own]) if int(grp) in found else own
        for grp, own in found.items():
            yield _sums_frame([(grp, TaskContext.get().partitionId() % 64, own)])

    def errors(part, solved):  # noqa: ANN001, ANN202
        if not len(part):
            return pd.DataFrame({"grp": pd.Series(dtype="int64"), "k": pd.Series(dtype="int32"), "error": pd.Series(dtype="float64")})
        grp = int(part["grp"].iloc[0])
        own = _left_out(np.vstack(part["features"].to_numpy()).astype(float), targets(part, classes[grp]), _parts(solved.iloc[0]))
        return pd.DataFrame({"grp": grp, "k": np.arange(len(ALPHAS)), "error": own})

    solved = _solved(_merged(rows.mapInPandas(sums, SUMS)), targets, classes, scaled)
    blocks = F.element_at(F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, -(-n // MOST_CONTEXT))]), F.col("grp"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    beside = solved.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return _best(solved, dealt.groupBy("grp", "block").cogroup(beside.groupBy("grp", "block")).applyInPandas(errors, ERRORS), classes)


def _head(grp: int, x: np.ndarray, y: np.ndarray, classes: list[str], scaled: bool):  # noqa: ANN202
    """The head of a group whose rows are in one task."""
    import pandas as pd

    x, mean, scale = _scaled(x) if scaled else (x, np.zeros(x.shape[1]), np.ones(x.shape[1]))
    coef, intercept, alpha = fit_ridge(x, y)
    return pd.DataFrame({"grp": [grp], "classes": [classes], "mean": [mean], "scale": [scale], "coef": [list(coef)], "intercept": [intercept], "alpha": [alpha]})


def _series_heads(train: DataFrame, config: EnsembleConfig, n_ref: int) -> DataFrame:
    """Heads of an ensemble's groups from all rows of (id, label, values), in tasks that run their groups' kernels themselves, so that only series and sums are shuffled.

    A task has a range of groups and a block of rows of BLOCK_POINTS points. Up to MOST_CONTEXT rows are one block, fitted
    there; beyond, blocks give sums, and run their kernels once more for the leave-one-out errors, as in _fit_sums."""
    import pandas as pd

    many = dict(train.dtypes)["values"].startswith("array<array")
    rows = kept(train.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("values").cast("array<array<double>>" if many else "array<double>").alias("values")))
    points = F.aggregate("values", F.lit(0), lambda a, v: a + F.size(v)) if many else F.size("values")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(points).alias("points")).collect()  # a row per class
    classes = sorted(r["label"] for r in counts if r["label"] is not None)
    k, width, n_groups = config.kernels_per_group, config.features_per_group, config.n_groups
    small = sum(r["n"] for r in counts) <= MOST_CONTEXT
    blocks = 1 if small else -(-sum(r["points"] or 0 for r in counts) // BLOCK_POINTS)
    cores = train.sparkSession.sparkContext.defaultParallelism
    chunks = min(n_groups, max(-(-8 * n_groups * (width + len(classes)) ** 2 // SUMS_BYTES), -(-2 * cores // blocks)))
    edges = [n_groups * i // chunks for i in range(chunks + 1)]

    def features(pdf, chunk):  # noqa: ANN001, ANN202
        """(group, rows, features) of parts of a block, in order of ids."""
        lo, hi = edges[chunk], edges[chunk + 1]
        bank, step = Transformer((hi - lo) * k, config.seed, lo * k, n_ref), max(1, 4 * FEATURES // ((hi - lo) * width))
        pdf = pdf.sort_values("id", kind="stable")
        for part in (pdf.iloc[at : at + step] for at in range(0, len(pdf), step)):
            x = np.vstack(bank(part["values"].to_numpy()))
            for g in range(lo, hi):
                yield g, part, x[:, (g - lo) * width : (g - lo + 1) * width]

    def fit(pdf):  # noqa: ANN001, ANN202
        chunk, pdf = int(pdf["unit"].iloc[0]), pdf.sort_values("id", kind="stable")
        y = _hot(pdf, classes)
        banks = ((g, Transformer(k, config.seed, g * k, n_ref)) for g in range(edges[chunk], edges[chunk + 1]))
        return pd.concat([_head(g, np.vstack(bank(pdf["values"].to_numpy())), y, classes, True) for g, bank in banks])

    def sums(pdf):  # noqa: ANN001, ANN202
        chunk, block = divmod(int(pdf["unit"].iloc[0]), blocks)
        found = {}
        for g, part, x in features(pdf, chunk):
            own = _sums_of(x, _hot(part, classes))
            found[g] = _merge_sums([found[g], own]) if g in found else own
        return _sums_frame([(g, block, own) for g, own in found.items()])

    def errors(pdf, solved):  # noqa: ANN001, ANN202
        found = {int(r["grp"]): np.zeros(len(ALPHAS)) for _, r in solved.iterrows()}
        parts = {int(r["grp"]): _parts(r) for _, r in solved.iterrows()}
        if len(pdf):
            for g, part, x in features(pdf, int(pdf["unit"].iloc[0]) // blocks):
                found[g] += _left_out(x, _hot(part, classes), parts[g])
        return pd.concat([pd.DataFrame({"grp": g, "k": np.arange(len(ALPHAS)), "error": own}) for g, own in found.items()])

    def dealt(df, chunk, block):  # noqa: ANN001, ANN202
        return df.withColumn("unit", (chunk * blocks + block).cast("int")).repartitionById(chunks * blocks, F.col("unit"))

    chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    units = dealt(rows.withColumn("chunk", chunk), F.col("chunk"), F.pmod(F.xxhash64("id"), F.lit(blocks))).drop("chunk")
    if small:
        return units.groupBy("unit").applyInPandas(fit, HEAD_SCHEMA)
    found = units.groupBy("unit").applyInPandas(sums, SUMS)
    if blocks > 64:
        found = _merged(found.withColumn("part", F.col("part") % math.isqrt(blocks)))
    of = {g: i for i in range(chunks) for g in range(edges[i], edges[i + 1])}
    known = {g: classes for g in range(n_groups)}
    solved = _solved(found, _hot, known, True)
    beside = solved.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    beside = dealt(beside, F.get(F.array(*[F.lit(of[g]) for g in range(n_groups)]), F.col("grp").cast("int")), F.col("block"))
    return _best(solved, units.groupBy("unit").cogroup(beside.groupBy("unit")).applyInPandas(errors, ERRORS), known)


def _fit(rows: DataFrame, targets, classes: list[str] | None = None, scaled: bool = True) -> DataFrame:  # noqa: ANN001
    """Heads of (grp, id, label, proba, features), which is read up to three times; without a class list each group has the classes of its rows."""
    counts = rows.groupBy("grp", "label").agg(F.count("*").alias("n")).collect()  # a row per group and class
    sizes, known = {}, {}
    for r in counts:
        sizes[r["grp"]] = sizes.get(r["grp"], 0) + r["n"]
        known.setdefault(r["grp"], set()).update([r["label"]] if r["label"] is not None else [])
    if classes is not None and (unknown := set().union(*known.values()) - set(classes)):
        raise ValueError(f"labels {sorted(unknown)} are not in the class list")
    lists = {g: classes if classes is not None else sorted(found) for g, found in known.items()}

    def fit(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values("id", kind="stable")
        own = lists[int(pdf["grp"].iloc[0])]
        return _head(pdf["grp"].iloc[0], np.vstack(pdf["features"].to_numpy()), targets(pdf, own), own, scaled)

    large = [g for g, n in sizes.items() if n > MOST_CONTEXT]
    if not large:
        return rows.groupBy("grp").applyInPandas(fit, HEAD_SCHEMA)
    heads = _fit_sums(rows.where(F.col("grp").isin(large)), targets, lists, scaled, {g: sizes[g] for g in large})
    return heads.unionByName(rows.where(~F.col("grp").isin(large)).groupBy("grp").applyInPandas(fit, HEAD_SCHEMA)) if len(large) < len(sizes) else heads


def fit_heads(train: DataFrame, keys: str = "grp", features: str = "features", label: str = "label", scaled: bool = True, keep: bool = True) -> DataFrame:
    """One ridge head per group from (grp, label, features): features standardised unless told otherwise, targets -1 and 1, one row for two classes. Without keep, train is computed up to three times."""
    none = F.lit(None).cast("map<string,double>")
    rows = train.select(F.col(keys).cast("long").alias("grp"), F.col("id").cast("long").alias("id"), F.col(label).cast("string").alias("label"), none.alias("proba"), F.col(features).alias("features"))
    return _fit(kept(rows) if keep else rows, _hot, scaled=scaled)


def soft_target_heads(train: DataFrame, classes: list[str], features: str = "features") -> DataFrame:
    """One ridge head per group on probability vectors: one-hot for labelled rows, the teacher's map for pool rows. An unknown label is an error."""
    return _fit(kept(train.select(F.col("grp").cast("long").alias("grp"), "id", "label", "proba", F.col(features).alias("features"))), _soft, classes)


def _dot(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def decision_values(rows: DataFrame, heads: DataFrame, features: str = "features") -> DataFrame:
    """rows (grp, ...) plus decision, an array with a value per head row, and classes. Columns only, so it also runs on streams."""
    joined = rows.join(F.broadcast(heads), "grp")
    z = F.zip_with(F.zip_with(features, "mean", lambda a, m: a - m), "scale", lambda a, s: a / s)
    joined = joined.withColumn("_z", z)
    products = let(F.col("_z"), lambda v: F.transform("coef", lambda w: _dot(w, v)))  # bound outside the lambda, so that features may come from a Python function
    decision = F.zip_with(products, "intercept", lambda a, b: a + b)
    return joined.withColumn("decision", decision).drop("_z", "mean", "scale", "coef", "intercept", "alpha")


def argmax_decision(decision: Column, classes: Column) -> Column:
    """The class of the largest decision value (the first of ties); for a single value its sign decides."""
    at = F.when(F.size(decision) == 1, (F.get(decision, F.lit(0)) > 0).cast("int")).otherwise((F.array_position(decision, F.array_max(decision)) - 1).cast("int"))
    return F.get(classes, at)


def softmax_map(decision: Column, classes: Column) -> Column:
    """Class probabilities from decision values; a single value becomes (-d, d)."""
    both = F.when(F.size(decision) == 1, F.array(-F.get(decision, F.lit(0)), F.get(decision, F.lit(0)))).otherwise(decision)
    exps = let(both, lambda b: F.transform(b, lambda d: F.exp(d - F.array_max(b))))
    shares = let(exps, lambda x: F.transform(x, lambda e: e / F.aggregate(x, F.lit(0.0), lambda a, v: a + v)))
    return F.map_from_arrays(classes, shares)


def classify_groups(train: DataFrame, test: DataFrame, features: str = "features") -> DataFrame:
    """The group contract: (grp, id, proba) for test rows (grp, id, features) from labelled context rows (grp, id, label, features). Rows are scored independently; all groups must know the same classes."""
    heads = kept(fit_heads(train, features=features))
    n_lists = heads.select("classes").distinct().count()  # one row per group
    if n_lists > 1:
        raise ValueError("the groups do not agree on the classes")
    scored = decision_values(test, heads, features)
    return scored.select("grp", "id", softmax_map(F.col("decision"), F.col("classes")).alias("proba"))


def score_with_margin(rows: DataFrame, heads: DataFrame, features: str = "features") -> DataFrame:
    """rows plus student (label) and margin."""
    scored = decision_values(rows, heads, features)
    return scored.withColumns({"student": argmax_decision(F.col("decision"), F.col("classes")), "margin": routing.decision_margin(F.col("decision"))}).drop("decision", "classes")


def _pivot_vote(context: DataFrame, test: DataFrame, n_context: int, temperature: float, k: int) -> DataFrame:
    """context_vote for contexts of any size, by the join over pivots."""
    test = kept(test.withColumn("row", F.monotonically_increasing_id()))
    classes = [r[0] for r in context.select("label").distinct().orderBy("label").collect()]
    lists = lambda df: df.withColumn("features", F.col("features").cast("array<double>"))
    best = nearest_join(kept(lists(context)), lists(test).select("row", "features"), k, n_context)
    w = best.withColumn("w", F.transform("near", lambda v: F.exp(-(v["d"] - F.col("near")[0]["d"]) / temperature)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    share = lambda c: total(F.zip_with("near", "w", lambda v, x: F.when(v["label"] == c, x).otherwise(0.0))) / total(F.col("w"))
    shares = w.select("row", F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*map(share, classes))).alias("proba"))
    return test.select("row", "id").join(shares, "row").select("id", "proba")


def context_vote(train: DataFrame, test: DataFrame, temperature: float = 1.0, k: int = 5, features: str = "features") -> DataFrame:
    """(id, proba) of test rows by the k nearest labelled rows (squared distance, ties by id), weighted by softmax. No training; a context of at most MOST_CONTEXT rows is broadcast, a larger one meets the test rows in the cells of pivots."""
    known = train.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col(features).alias("features"))
    asked = test.select(F.col("id").cast("long").alias("id"), F.col(features).alias("features"))
    n_context = known.count()
    if n_context > MOST_CONTEXT:
        return _pivot_vote(known, asked, n_context, temperature, k)
    rows = known.orderBy("id").collect()
    context = test.sparkSession.sparkContext.broadcast((np.array([r[2] for r in rows], float), [r[1] for r in rows]))
    classes = sorted({r[1] for r in rows})

    def vote(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        x, labels = context.value
        hot = np.array([[float(y == c) for c in classes] for y in labels])
        for batch in batches:
            if not len(batch):
                continue
            near, w = nearest(matrix(batch["features"]), x, k)
            w = np.exp(-(w - w[:, :1]) / temperature)
            w /= w.sum(axis=1, keepdims=True)
            p = np.einsum("ij,ijc->ic", w, hot[near])
            yield pd.DataFrame({"id": batch["id"], "proba": [dict(zip(classes, map(float, row))) for row in p]})

    return asked.mapInPandas(vote, "id long, proba map<string,double>")


def test_chunks(df: DataFrame, size: int, id_col: str = "id") -> DataFrame:
    """df plus chunk: contiguous windows of `size` ids."""
    return global_rank(df, [F.col(id_col)], "_rank").withColumn("chunk", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def context_checks(df: DataFrame, most_classes: int = MOST_CLASSES, most_rows: int = MOST_CONTEXT) -> DataFrame:
    """One row: n_rows, n_classes and whether either is over its limit."""
    out = df.where(F.col("split") == "train").agg(F.count("*").alias("n_rows"), F.countDistinct("label").alias("n_classes"))
    return out.withColumns({"too_many_rows": F.col("n_rows") > most_rows, "too_many_classes": F.col("n_classes") > most_classes})


def coef_magnitude(heads: DataFrame) -> DataFrame:
    """(grp, feature, magnitude): mean absolute coefficient of each standardised feature."""
    rows = heads.select("grp", F.size("coef").alias("k"), F.posexplode(F.aggregate("coef", F.transform(F.get("coef", F.lit(0)), lambda v: F.lit(0.0)), lambda a, w: F.zip_with(a, w, lambda x, y: x + F.abs(y)))).alias("feature", "total"))
    return rows.select("grp", "feature", (F.col("total") / F.col("k")).alias("magnitude"))


def bootstrap_stability(train: DataFrame, k: int, draws: int, seed: int = 0) -> DataFrame:
    """(feature, frequency): how often a feature is among the k largest coefficients over bootstrap resamples of a context (id, label, features)."""
    resampled = sampling.bootstrap(train.select("id", "label"), draws, seed).join(train.select("id", "features"), "id")
    heads = fit_heads(resampled.select(F.col("draw").alias("grp"), "id", "label", "features"))
    from pyspark.sql import Window

    ranked = coef_magnitude(heads).withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("magnitude"), "feature")))
    return ranked.groupBy("feature").agg((F.count_if(F.col("_r") <= k) / F.count("*")).alias("frequency"))


def oof_margins(train: DataFrame, folds: int, seed: int = 0, features: str = "features") -> DataFrame:
    """(id, fold, student, margin): out-of-fold labels and margins of a capped context; folds shrink to the rarest class, two at least."""
    rarest = train.groupBy("label").count().agg(F.min("count")).first()[0] or 2
    k = max(2, min(folds, rarest))
    rows = sampling.stratified_folds(train, k, seed)
    fits = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("grp <> fold")
    heads = kept(fit_heads(fits, features=features))
    return score_with_margin(rows.withColumn("grp", F.col("fold").cast("long")), heads, features).select("id", "fold", "student", "margin")


def tune_block_weight(train: DataFrame, n_first: int, folds: int, weights: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0, 9.3, 20.0, 50.0), seed: int = 0) -> DataFrame:
    """(weight, accuracy): out-of-fold accuracy for each weight of the features after the first n_first; context rows multiply by folds and weights."""
    rows = kept(sampling.stratified_folds(train, folds, seed))  # the grid, folds x weights times as large, is not written
    grid = rows.withColumn("wi", F.explode(F.sequence(F.lit(0), F.lit(len(weights) - 1))))
    w = F.get(F.array(*map(F.lit, weights)), F.col("wi"))
    grid = grid.withColumn("features", F.transform("features", lambda v, i: F.when(i < n_first, v).otherwise(v * w)))
    # the weight acts after standardising, so heads must not scale it away: features come standardised
    fits = grid.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("held <> fold").withColumn("grp", (F.col("wi") * folds + F.col("held")).cast("long"))
    heads = kept(fit_heads(fits, scaled=False, keep=False))
    scored = score_with_margin(grid.withColumn("grp", (F.col("wi") * folds + F.col("fold")).cast("long")), heads)
    return scored.groupBy(w.alias("weight")).agg(F.avg((F.col("student") == F.col("label")).cast("double")).alias("accuracy"))


class GroupEnsemble:
    """fit, predict_proba, predict and score over DataFrames (id, label, values). All rows are the context, unless max_context caps it."""

    def __init__(self, config: EnsembleConfig = EnsembleConfig(), max_context: int | None = None):
        self.config, self.max_context, self.heads, self.n_ref = config.validate(), max_context, None, None

    def features(self, df: DataFrame) -> DataFrame:
        """(id, ..., grp, features): one row per series and group. Kernels run once over the series; groups are slices."""
        c = self.config
        wide = conv_features(df, "values", c.n_kernels, c.seed, 0, self.n_ref)
        rows = wide.drop("values").withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c.n_groups - 1).cast("long"))))
        return rows.withColumn("features", slice_group(F.col("features"), F.col("grp").cast("int"), c.features_per_group))

    def fit(self, train: DataFrame) -> GroupEnsemble:
        from convseries.operators.transform import reference_length

        self.n_ref = reference_length(train).first()["n_ref"]
        context = train if self.max_context is None else sampling.cap_context(train, self.max_context, self.config.seed)
        self.heads = kept(_series_heads(context, self.config, self.n_ref))
        return self

    def group_proba(self, test: DataFrame) -> DataFrame:
        """(grp, id, proba). Rows are scored where their kernels run, so no features leave a worker; heads reach it by broadcast."""
        c = self.config
        found = {int(r["grp"]): r for r in self.heads.collect()}  # a row per group
        sent = test.sparkSession.sparkContext.broadcast({g: tuple(np.array(r[n], float) for n in ("mean", "scale", "coef", "intercept")) for g, r in found.items()})
        own = Transformer(c.n_kernels, c.seed, 0, self.n_ref)
        step, width = max(1, FEATURES // (2 * c.n_kernels)), c.features_per_group

        def decide(batches):  # noqa: ANN001, ANN202
            import pyarrow as pa

            for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
                features = own(batch.column(1).to_numpy(zero_copy_only=False))
                rows = np.flatnonzero([f is not None for f in features])
                if not len(rows):
                    continue
                x = np.vstack([features[i] for i in rows])
                ids = batch.column(0).take(pa.array(rows))
                for g, (mean, scale, coef, intercept) in sent.value.items():
                    d = (x[:, g * width : (g + 1) * width] - mean) / scale @ coef.T + intercept
                    ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), g)), ids, pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], names=["grp", "id", "decision"])

        kinds = dict(test.dtypes)
        kind, many = kinds["id"], kinds["values"].startswith("array<array")
        scored = test.select("id", F.col("values").cast("array<array<double>>" if many else "array<double>")).mapInArrow(decide, f"grp long, id {kind}, decision array<double>")
        # the classes of each group, which are the same for all but odd contexts
        classes = F.get(F.array(*[F.array(*[F.lit(x) for x in found[g]["classes"]]) if g in found else F.array().cast("array<string>") for g in range(c.n_groups)]), F.col("grp").cast("int"))
        return scored.select("grp", "id", softmax_map(F.col("decision"), classes).alias("proba"))

    def predict_proba(self, test: DataFrame) -> DataFrame:
        """(id, cls, mean_p, n_groups_seen)."""
        cube = self.group_proba(test).select("grp", "id", F.explode("proba").alias("cls", "p"))
        return ensemble.mean_proba(cube)

    def predict(self, test: DataFrame) -> DataFrame:
        """(id, yhat, confidence)."""
        return ensemble.argmax_label(self.predict_proba(test), ["id"])

    def score(self, test: DataFrame) -> DataFrame:
        """One row: n, accuracy."""
        rows = self.predict(test).join(test.select("id", F.col("label").alias("y")), "id")
        return rows.agg(F.count("*").alias("n"), F.avg((F.col("yhat") == F.col("y")).cast("double")).alias("accuracy"))
