"""The registered queries of the series engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from convseries.functions import series as fs
from convseries.operators.transform import conv_features
from convseries.plans import base, ensemble_queries, evaluate_queries, series_queries  # noqa: F401  (they register)


FLAGSHIP_KERNELS = 50


def flagship(spark, sf_dir):
    """Mean maximum and mean positive share of 50 kernels over normalised series, by label."""
    s = base.series(spark, sf_dir).select("label", fs.normalize_series(F.col("values")).alias("values"))
    f = conv_features(s, "values", FLAGSHIP_KERNELS, series_queries.SEED)
    mean = lambda x: fs.array_mean(x(F.col("features")))
    return f.groupBy("label").agg(F.count("*").alias("n"), base.r6(F.avg(mean(fs.maxes))).alias("mean_max"), base.r6(F.avg(mean(fs.ppvs))).alias("mean_ppv"))


FLAGSHIP_SQL = f"""WITH {base.SERIES}, long AS (SELECT id, (unnest(range(len(vals))))::BIGINT AS t, unnest(list_transform(vals, lambda x: (x - list_avg(vals)) / CASE WHEN list_stddev_pop(vals) > 1e-12 THEN list_stddev_pop(vals) ELSE 1.0 END)) AS value FROM series),
{series_queries.conv_ctes(FLAGSHIP_KERNELS)}
SELECT label, count(DISTINCT id) AS n, round(avg(m), 6) AS mean_max, round(avg(p), 6) AS mean_ppv FROM (SELECT id, max(c) AS m, count_if(c > 0) / count(*)::DOUBLE AS p FROM conv GROUP BY id, kernel_id) JOIN series USING (id) GROUP BY label"""


def queries():
    """name -> callable(spark, sf_dir)."""
    return {**base.QUERIES, "flagship": flagship}


def oracle_sql():
    """name -> DuckDB SQL."""
    return {**base.SQL, "flagship": FLAGSHIP_SQL}
