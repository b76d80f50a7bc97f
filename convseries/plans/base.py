"""What the registered queries share: the registry, the derived base tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convseries.functions.prng import GOLDEN_GAMMA, MIX_A, MIX_B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Registers a query under the operator's id, with its SQL twin where SQL can express it."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col) -> F.Column:  # noqa: ANN001
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


# -- base tables -------------------------------------------------------------------------------------------------------

GROUPS, WIDTH = 8, 8
MODELS = ["m0", "m1", "m2"]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as labelled series (id, split, label, values); every fifth is a test row."""
    e = table(spark, sf_dir, "embeddings")
    split = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    return e.select(F.col("vec_id").alias("id"), split.alias("split"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("values"))


SERIES = "series AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'c' || label::VARCHAR AS label, embedding::DOUBLE[] AS vals FROM embeddings)"
LONG = SERIES + ", long AS (SELECT id, split, label, (unnest(range(len(vals))))::BIGINT AS t, unnest(vals) AS value FROM series)"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("id", F.col("label").alias("y"))


def group_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, id, cls, p): for each group of WIDTH points, the closeness to the training centroid of each class, as shares.

    Centroids are groups x classes short arrays, so they are broadcast."""
    s = series(spark, sf_dir)
    parts = s.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1)))).withColumn("part", F.slice("values", F.col("grp") * WIDTH + 1, WIDTH)).drop("values")
    points = parts.where("split = 'train'").select("grp", F.col("label").alias("cls"), F.posexplode("part").alias("k", "x"))
    centre = points.groupBy("grp", "cls", "k").agg(F.avg("x").alias("c")).groupBy("grp", "cls").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("cs"))
    d = F.aggregate(F.zip_with("part", F.transform("cs", lambda v: v["c"]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = parts.join(F.broadcast(centre), "grp").select("grp", "id", "cls", (1.0 / (1.0 + d)).alias("w"))
    total = near.groupBy("grp", "id").agg(F.sum("w").alias("total"))
    return near.join(total, ["grp", "id"]).select("grp", "id", "cls", F.round(F.col("w") / F.col("total"), 9).alias("p"))


CUBE = (
    LONG
    + f""", parts AS (SELECT id, split, label, t // {WIDTH} AS grp, t % {WIDTH} AS k, value FROM long WHERE t < {GROUPS * WIDTH}),
centre AS (SELECT grp, label AS cls, k, avg(value) AS c FROM parts WHERE split = 'train' GROUP BY ALL),
near AS (SELECT p.grp, p.id, c.cls, 1.0 / (1.0 + sum((p.value - c.c) * (p.value - c.c))) AS w FROM parts p JOIN centre c ON p.grp = c.grp AND p.k = c.k GROUP BY ALL),
cube AS (SELECT grp, id, cls, round(w / sum(w) OVER (PARTITION BY grp, id), 9) AS p FROM near), truth AS (SELECT id, label AS y FROM series)"""
)


def soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, id, cls, p): three models, each the mean of every third group."""
    cube = group_cube(spark, sf_dir)
    return cube.groupBy(F.concat(F.lit("m"), (F.col("grp") % 3).cast("string")).alias("model"), "id", "cls").agg(F.round(F.avg("p"), 9).alias("p"))


SOFT = CUBE + ", soft AS (SELECT 'm' || (grp % 3)::VARCHAR AS model, id, cls, round(avg(p), 9) AS p FROM cube GROUP BY ALL)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, id, yhat)."""
    from convseries.operators.ensemble import argmax_label

    return argmax_label(soft(spark, sf_dir), ["model", "id"], "p").select("model", "id", "yhat")


PREDS = SOFT + ", labels_m AS (SELECT model, id, cls AS yhat, p AS confidence FROM soft QUALIFY row_number() OVER (PARTITION BY model, id ORDER BY p DESC, cls) = 1), preds AS (SELECT model, id, yhat FROM labels_m)"


def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, margin, student, alternate, y): model m0 is the student, m1 the alternate."""
    from convseries.operators.routing import proba_margin

    s = soft(spark, sf_dir)
    p = predictions(spark, sf_dir)
    margin = proba_margin(s.where("model = 'm0'"), ["id"]).withColumn("margin", F.round("margin", 9))
    student = p.where("model = 'm0'").select("id", F.col("yhat").alias("student"))
    other = p.where("model = 'm1'").select("id", F.col("yhat").alias("alternate"))
    return margin.join(student, "id").join(other, "id").join(truth(spark, sf_dir), "id")


ROUTED = (
    PREDS
    + """, margins AS (SELECT id, round(max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END), 9) AS margin FROM (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS r FROM soft WHERE model = 'm0') GROUP BY id),
routed AS (SELECT m.id, m.margin, a.yhat AS student, b.yhat AS alternate, t.y FROM margins m JOIN preds a ON a.id = m.id AND a.model = 'm0' JOIN preds b ON b.id = m.id AND b.model = 'm1' JOIN truth t ON t.id = m.id)"""
)


def supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records of runs: (dataset, setting 1..7, flag, one, two, size): rounded means by supplier, line number and return flag."""
    l = table(spark, sf_dir, "lineitem")
    keys = [F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dataset"), F.col("l_linenumber").cast("long").alias("setting"), F.col("l_returnflag").alias("flag")]
    return l.groupBy(*keys).agg(r6(F.avg("l_discount") * 10).alias("one"), r6(F.avg("l_tax") * 10).alias("two"), r6(F.sum("l_quantity")).alias("size"))


RECORDS = "records AS (SELECT 's' || l_suppkey::VARCHAR AS dataset, l_linenumber::BIGINT AS setting, l_returnflag AS flag, round(avg(l_discount) * 10, 6) AS one, round(avg(l_tax) * 10, 6) AS two, round(sum(l_quantity), 6) AS size FROM lineitem GROUP BY ALL)"


# -- SplitMix64 in SQL -------------------------------------------------------------------------------------------------

_M = "18446744073709551616::UHUGEINT"


def mix_ctes(name: str, source: str, z: str, out: str) -> str:
    """CTEs that add column `out` = mix(z modulo 2**64) to a source; the last is called `name`."""
    mul = lambda a, k: f"(({a})::UHUGEINT * {k}::UHUGEINT % {_M})::UBIGINT"
    return f"""{name}_a AS (SELECT *, (({z}) % {_M})::UBIGINT AS _z FROM {source}),
{name}_b AS (SELECT * EXCLUDE (_z), {mul("xor(_z, _z >> 30)", MIX_A)} AS _y FROM {name}_a),
{name}_c AS (SELECT * EXCLUDE (_y), {mul("xor(_y, _y >> 27)", MIX_B)} AS _x FROM {name}_b),
{name} AS (SELECT * EXCLUDE (_x), xor(_x, _x >> 31) AS {out} FROM {name}_c)"""


def seed_ctes(name: str, source: str, index: str, seed: int, out: str = "stream") -> str:
    """Adds the seed of stream `index`."""
    return mix_ctes(name, source, f"{seed % (1 << 64)}::UHUGEINT + ({index} + 1)::UHUGEINT * {GOLDEN_GAMMA}::UHUGEINT", out)


def draw_ctes(name: str, source: str, step: str, out: str, stream: str = "stream") -> str:
    """Adds draw `step` of the stream as a uniform double."""
    inner = mix_ctes(f"{name}_m", source, f"{stream}::UHUGEINT + ({step})::UHUGEINT * {GOLDEN_GAMMA}::UHUGEINT", "_d")
    return f"{inner},\n{name} AS (SELECT * EXCLUDE (_d), (_d >> 11)::DOUBLE / 9007199254740992.0 AS {out} FROM {name}_m)"


def uniform_ctes(name: str, source: str, index: str, seed: int, out: str = "u", step: str = "1") -> str:
    """Adds stable_uniform(seed, index, step)."""
    return seed_ctes(f"{name}_s", source, index, seed, "_stream") + ",\n" + draw_ctes(f"{name}_d", f"{name}_s", step, out, "_stream") + f",\n{name} AS (SELECT * EXCLUDE (_stream) FROM {name}_d)"
