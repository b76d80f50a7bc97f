"""Sampling and splitting that depend on (seed, id) only, and label experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convseries.functions.prng import stable_below, stable_uniform
from convseries.operators.ranking import global_rank, kept, small, uniform_rank


def class_quota(counts: DataFrame, max_rows: int) -> DataFrame:
    """(label, n, quota) from (label, n): one row per class first, the rest in proportion, and what rounding leaves to the classes with the largest shortfall, one row at a time."""
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per class
    rows = counts.withColumns({"total": F.sum("n").over(every), "classes": F.count("*").over(every)})
    share = F.floor(F.greatest(F.lit(0), F.lit(max_rows) - F.col("classes")) * F.col("n") / F.col("total"))
    rows = rows.withColumn("base", F.least(F.col("n"), 1 + share).cast("long"))
    rows = rows.withColumn("left", F.greatest(F.lit(0), F.lit(max_rows) - F.sum("base").over(every)))
    # units of shortfall: the largest come first, so the `left` largest units are what the rounds would give
    units = rows.where("n > base AND left > 0").withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n") - F.col("base"), F.col("left")) - 1)))
    units = units.withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.col("n") - F.col("base") - F.col("u")), "label"))).where("r <= left")
    extra = units.groupBy("label").agg(F.count("*").alias("extra"))
    quota = F.when(F.lit(max_rows) >= F.col("total"), F.col("n")).otherwise(F.col("base") + F.coalesce(F.col("extra"), F.lit(0)))
    return rows.join(extra, "label", "left").select("label", "n", quota.alias("quota"))


def cap_context(df: DataFrame, max_rows: int, seed: int, label: str = "label", id_col: str = "id") -> DataFrame:
    """At most max_rows rows, stratified: every class survives."""
    quota = class_quota(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), max_rows).select(F.col("label").alias("_label"), "quota")
    ranked = uniform_rank(df, [label], stable_uniform(seed, F.col(id_col)), [id_col], "_rank")
    return ranked.join(small(quota), F.col(label).eqNullSafe(F.col("_label"))).where("_rank <= quota").drop("_label", "quota", "_rank")


def resample_split(df: DataFrame, k: int, label: str = "label", id_col: str = "id") -> DataFrame:
    """A new split of the pooled rows with the same number of training rows in every class; k = 0 leaves the split alone."""
    if k == 0:
        return df
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count_if(F.col("split") == "train").alias("_train"))
    ranked = uniform_rank(df, [label], stable_uniform(k, F.col(id_col)), [id_col], "_rank")
    joined = ranked.join(small(sizes), F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn("split", F.when(F.col("_rank") <= F.col("_train"), "train").otherwise("test")).drop("_label", "_train", "_rank")


def split_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n_train, n_test)."""
    return df.groupBy(label).agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))


def stratified_folds(df: DataFrame, k: int, seed: int = 0, label: str = "label", id_col: str = "id") -> DataFrame:
    """df plus fold: round robin within each class in shuffled order."""
    ranked = uniform_rank(df, [label], stable_uniform(seed, F.col(id_col)), [id_col], "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def pool_holdout(df: DataFrame, seed: int, rep: int, label: str = "label", id_col: str = "id") -> DataFrame:
    """df plus part: half of each class (rounded down) is the pool, the rest the holdout. Where a class has one row only, the whole table is halved instead."""
    u = stable_uniform(seed + rep, F.col(id_col))
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    whole = sizes.agg((F.min("_n") < 2).alias("_single"), F.sum("_n").alias("_all"))  # one row
    ranked = uniform_rank(uniform_rank(df, [label], u, [id_col], "_rank"), [], u, [id_col], "_rank_all")
    joined = ranked.join(small(sizes), F.col(label).eqNullSafe(F.col("_label"))).crossJoin(F.broadcast(whole))
    in_pool = F.when(F.col("_single"), F.col("_rank_all") <= F.floor(F.col("_all") / 2)).otherwise(F.col("_rank") <= F.floor(F.col("_n") / 2))
    return joined.withColumn("part", F.when(in_pool, "pool").otherwise("holdout")).drop("_label", "_n", "_single", "_all", "_rank", "_rank_all")


def corrupt_labels(df: DataFrame, rate: float, classes: list[str], seed: int, rep: int = 0, label: str = "label", id_col: str = "id") -> DataFrame:
    """df with each label replaced, at the given rate, by another class; streams depend on (seed, rep, rate)."""
    own = (seed * 1_000 + rep) * 1_000 + round(rate * 100)
    options = F.filter(F.array(*map(F.lit, classes)), lambda c: c != F.col(label))
    pick = F.get(options, stable_below(own, F.col(id_col), max(1, len(classes) - 1), 2).cast("int"))
    flipped = F.when((stable_uniform(own, F.col(id_col)) < rate) & F.lit(len(classes) > 1), F.coalesce(pick, F.get(options, F.lit(0)))).otherwise(F.col(label))
    return df.withColumn(label, flipped)


def bootstrap(df: DataFrame, draws: int, seed: int, label: str = "label", id_col: str = "id", attempts: int | None = None) -> DataFrame:
    """(draw, slot, id, label): resamples with replacement of the table's own size. A resample that loses a class is drawn again, up to `attempts` (10 for each draw); fewer draws come out if that is not enough.

    Attempts are drawn as many at a time as draws are still missing, so rows multiply by the draws, and by more only
    where classes get lost.
    """
    attempts = attempts or 10 * draws
    base = kept(uniform_rank(df.select(F.col(id_col).alias("id"), F.col(label).alias("label")), [], stable_uniform(seed, F.col(id_col)), [id_col], "row"))
    size = F.broadcast(base.agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels")))  # one row
    out, found, tried = None, 0, 0
    while found < draws and tried < attempts:
        last = min(attempts, tried + draws - found)
        slots = base.select("row").crossJoin(size).withColumn("attempt", F.explode(F.sequence(F.lit(tried), F.lit(last - 1))))
        source = F.floor(stable_uniform(seed + 1, F.col("attempt") * F.col("n") + F.col("row")) * F.col("n")).cast("long") + 1
        drawn = kept(slots.withColumn("source", source).join(base.withColumnRenamed("row", "source"), "source"))
        good = sorted(r["attempt"] for r in drawn.groupBy("attempt", "n_labels").agg(F.countDistinct("label").alias("k")).where("k = n_labels").collect())  # at most a row per attempt
        if good:
            number = F.element_at(F.create_map(*[F.lit(x) for k, attempt in enumerate(good) for x in (attempt, found + k + 1)]), F.col("attempt"))
            part = drawn.where(F.col("attempt").isin(good)).select(number.alias("draw"), F.col("row").alias("slot"), "id", "label")
            out = part if out is None else out.union(part)
        found, tried = found + len(good), last
    return out if out is not None else base.limit(0).select(F.lit(0).alias("draw"), F.col("row").alias("slot"), "id", "label")


def confident_half(pool: DataFrame, id_col: str = "id") -> DataFrame:
    """The surest half of the pool, at least one row, ties by id."""
    ranked = global_rank(pool, [F.desc("confidence"), F.col(id_col)], "_rank")
    size = ranked.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("_k"))
    return ranked.crossJoin(F.broadcast(size)).where("_rank <= _k").drop("_rank", "_k")


def label_arms(train: DataFrame, pool: DataFrame, teacher: DataFrame, noise_rates: tuple[float, ...] = (), classes: list[str] | None = None, seed: int = 0, rep: int = 0) -> DataFrame:
    """(arm, id, label, weight_map): the training sets of a pseudo-label experiment.

    train and pool are (id, label); teacher is (id, yhat, confidence, proba). Arms: A the labelled rows; B with the pool
    under the teacher's labels; C under its true labels; Bc with the surest half of B; Bs with the teacher's whole
    distribution; Nxx with true labels corrupted at xx percent.
    """
    none = F.lit(None).cast("map<string,double>")
    labelled = pool.join(teacher, "id")
    own = train.select("id", "label", none.alias("proba"))
    parts = {
        "A": None,
        "B": labelled.select("id", F.col("yhat").alias("label"), none.alias("proba")),
        "C": pool.select("id", "label", none.alias("proba")),
        "Bc": confident_half(labelled).select("id", F.col("yhat").alias("label"), none.alias("proba")),
        "Bs": labelled.select("id", F.lit(None).cast("string").alias("label"), "proba"),
    }
    for rate in noise_rates:
        parts[f"N{round(rate * 100):02d}"] = corrupt_labels(pool.select("id", "label"), rate, classes or [], seed, rep).select("id", "label", none.alias("proba"))
    out = None
    for arm, extra in parts.items():
        rows = own if extra is None else own.unionByName(extra)
        rows = rows.select(F.lit(arm).alias("arm"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def select_hard(records: DataFrame, threshold: float) -> DataFrame:
    """Datasets on which every student stays below the threshold; records are (dataset, student, accuracy)."""
    return records.groupBy("dataset").agg(F.max("accuracy").alias("best")).where(F.col("best") < threshold)


def assert_same_split(records: DataFrame, resample: int) -> DataFrame:
    """records, failing at run time if one belongs to another resample."""
    same = F.coalesce(F.col("resample"), F.lit(0)) == resample
    return records.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit(f"a record is not of resample {resample}")).cast("boolean")))


def same_split(records: DataFrame, resample: int, keys: list[str]) -> DataFrame:
    """(keys, same): the same check as a report."""
    same: Column = F.coalesce(F.col("resample"), F.lit(0)) == resample
    return records.groupBy(*keys).agg(F.bool_and(same).alias("same"))
