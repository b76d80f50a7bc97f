"""Deploying a routed student and serving with it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convseries.operators import heads, routing
from convseries.operators.transform import conv_features

HEADS, THRESHOLD = "heads", "threshold"


def deploy(train: DataFrame, path: str, kernels: int, seed: int, target: float, folds: int = 5, n_groups: int = 1) -> dict:
    """Fits the student on a capped context (id, label, values), the threshold from its out-of-fold margins, and writes both with their metadata under path."""
    if kernels % n_groups:
        raise ValueError(f"{kernels} kernels do not make {n_groups} equal groups")
    n_ref = train.agg(F.min(F.size("values"))).first()[0]
    rows = conv_features(train, "values", kernels, seed, 0, n_ref).drop("values")
    margins = heads.oof_margins(rows, folds, seed)
    threshold = routing.calibrate_threshold(margins, target).first()["threshold"]
    heads.fit_heads(rows.withColumn("grp", F.lit(0))).write.mode("overwrite").parquet(f"{path}/{HEADS}")
    meta = {"kernels": kernels, "seed": seed, "n_ref": int(n_ref), "threshold": float(threshold), "target": target}
    train.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/{THRESHOLD}")
    return meta


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Heads and metadata."""
    return spark.read.parquet(f"{path}/{HEADS}"), json.loads(spark.read.parquet(f"{path}/{THRESHOLD}").first()["meta"])


def score(rows: DataFrame, student: DataFrame, meta: dict, normalize: bool = False) -> DataFrame:
    """rows (id, values) plus student, margin, escalated; columns and Arrow batches only, so it also runs on streams."""
    own = conv_features(rows, "values", meta["kernels"], meta["seed"], 0, meta["n_ref"], normalize=normalize).withColumn("grp", F.lit(0).cast("long"))
    out = heads.score_with_margin(own, student).drop("features", "grp")
    return out.withColumn("escalated", F.col("margin") < meta["threshold"])


def serve(rows: DataFrame, student: DataFrame, meta: dict, ensemble) -> DataFrame:  # noqa: ANN001
    """(id, yhat, escalated): the student answers all rows, the ensemble (a fitted GroupEnsemble) the escalated ones."""
    scored = score(rows, student, meta)
    hard = ensemble.predict(scored.where("escalated").select("id", "values")).select("id", F.col("yhat").alias("_better"))
    return scored.join(hard, "id", "left").select("id", F.coalesce("_better", "student").alias("yhat"), "escalated")

