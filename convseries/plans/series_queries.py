"""Queries of sources, deterministic columns, kernels, transforms and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from convseries.functions import prng
from convseries.functions import series as fs
from convseries.operators import kernels, statistics, transform
from convseries.operators.ranking import kept, new_folder
from convseries.plans.base import CUBE, LONG, RECORDS, SERIES, draw_ctes, group_cube, mix_ctes, query, r6, seed_ctes, series, supplier_records, table, uniform_ctes
from convseries.sources import series as src

SEED = 7


# -- S: sources and reshaping ------------------------------------------------------------------------------------------


@query("S1_read_series", f"WITH {SERIES} SELECT id, split, label, len(vals)::BIGINT AS n, round(list_sum(vals), 6) AS total FROM series")
def read_series(spark, sf_dir):
    path = new_folder(spark, "series")
    series(spark, sf_dir).write.parquet(path)
    return src.read_series(spark, path).select("id", "split", "label", F.size("values").cast("long").alias("n"), r6(fs.array_sum(F.col("values"))).alias("total"))


@query("S2_label_splits", f"WITH {SERIES} SELECT split, label, count(*) AS n FROM series GROUP BY ALL")
def label_splits(spark, sf_dir):
    s = series(spark, sf_dir).drop("split")
    return src.label_splits(s.where("id % 5 <> 0"), s.where("id % 5 = 0")).groupBy("split", "label").agg(F.count("*").alias("n"))


def user_series(spark, sf_dir):
    """Events as one ragged series per user, by time."""
    return src.assemble_series(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("S3_assemble_series", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, round(first(value ORDER BY ts, event_id), 6) AS head, round(last(value ORDER BY ts, event_id), 6) AS tail FROM events GROUP BY user_id")
def assemble_series(spark, sf_dir):
    x = F.col("values")
    return user_series(spark, sf_dir).select("user_id", F.size(x).cast("long").alias("n"), r6(fs.array_sum(x)).alias("total"), r6(F.get(x, F.lit(0))).alias("head"), r6(F.element_at(x, -1)).alias("tail"))


@query("S4_explode_series", f"WITH {LONG} SELECT id, t, round(value, 6) AS value FROM long")
def explode_series(spark, sf_dir):
    return src.explode_series(series(spark, sf_dir), ["id"]).select("id", F.col("t").cast("long").alias("t"), r6("value").alias("value"))


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def supplier_channels(spark, sf_dir):
    return src.assemble_channels(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINE_ORDER, ["l_quantity", "l_extendedprice", "l_discount"])


@query("S5_assemble_channels", f"SELECT l_suppkey, count(*) AS n, round(first(l_quantity ORDER BY {', '.join(LINE_ORDER)}, l_discount), 6) AS q0, round(sum(l_extendedprice), 2) AS price, round(last(l_quantity ORDER BY {', '.join(LINE_ORDER)}, l_discount), 6) AS q_last FROM lineitem GROUP BY l_suppkey")
def assemble_channels(spark, sf_dir):
    c = lambda k: F.get("values", F.lit(k))
    rows = src.check_channels(supplier_channels(spark, sf_dir))
    return rows.select("l_suppkey", F.size(c(0)).cast("long").alias("n"), r6(F.get(c(0), F.lit(0))).alias("q0"), F.round(fs.array_sum(c(1)), 2).alias("price"), r6(F.element_at(c(0), -1)).alias("q_last"))


@query("S6_features_to_wide", f"WITH {SERIES} SELECT id, round(vals[1], 6) AS f0, round(vals[2], 6) AS f1, round(vals[3], 6) AS f2, round(vals[4], 6) AS f3 FROM series")
def features_to_wide(spark, sf_dir):
    wide = src.features_to_wide(series(spark, sf_dir).select("id", F.col("values").alias("features")), 4)
    return wide.select("id", *[r6(f"f{k}").alias(f"f{k}") for k in range(4)])


@query("S7_group_features", f"WITH {SERIES}, g AS (SELECT unnest(range(8)) AS grp, split, label FROM series) SELECT grp::INTEGER AS grp, split, count(*) AS n, count(CASE WHEN split = 'train' THEN label END) AS labelled FROM g GROUP BY ALL")
def group_features(spark, sf_dir):
    g = src.group_features(series(spark, sf_dir).withColumnRenamed("values", "features"), 8, 8)
    return g.groupBy("grp", "split").agg(F.count("*").alias("n"), F.count("label").alias("labelled"))


@query("S7_written_groups", f"WITH {SERIES}, g AS (SELECT unnest([0, 3, 5]) AS grp, id, vals FROM series WHERE split = 'test') SELECT grp::INTEGER AS grp, id, round(list_sum(vals[grp * 8 + 1 : grp * 8 + 8]), 6) AS total FROM g")
def written_groups(spark, sf_dir):
    """All groups through the partitioned sink; three of them are read back for the test split, from their folders alone."""
    path = new_folder(spark, "groups")
    src.write_group_features(src.group_features(series(spark, sf_dir).withColumnRenamed("values", "features"), 8, 8), path)
    out = src.read_group_features(spark, path, [0, 3, 5], "test")
    return out.select("grp", "id", r6(fs.array_sum(F.col("features"))).alias("total"))


@query("S8_attach_features", f"WITH {SERIES} SELECT id, label, round(list_max(vals), 6) AS top FROM series")
def attach_features(spark, sf_dir):
    s = series(spark, sf_dir)
    return src.attach_features(s.select("id", "label"), s.select("id", r6(F.array_max("values")).alias("top")))


@query("S9_slice_group", f"WITH {SERIES} SELECT id, round(list_sum(vals[17:24]), 6) AS total FROM series")
def slice_group(spark, sf_dir):
    return series(spark, sf_dir).select("id", r6(fs.array_sum(fs.slice_group(F.col("values"), 2, 8))).alias("total"))


@query("S12_proba_maps", f"WITH {CUBE} SELECT id, cls, round(avg(p), 6) AS p FROM cube GROUP BY ALL")
def proba_maps(spark, sf_dir):
    mean = group_cube(spark, sf_dir).groupBy("id", "cls").agg(F.avg("p").alias("p"))
    return src.explode_proba(src.collect_proba(mean, ["id"])).select("id", "cls", r6("p").alias("p"))


@query("S13_proba_vector", f"WITH {CUBE}, k AS (SELECT grp, id, max(CASE WHEN cls = 'c0' THEN p END) AS a, max(CASE WHEN cls = 'c1' THEN p END) AS b, max(CASE WHEN cls = 'none' THEN p END) AS c FROM cube GROUP BY ALL) SELECT grp::INTEGER AS grp, id, round(coalesce(a, 0.0), 6) AS p0, round(coalesce(b, 0.0), 6) AS p1, round(coalesce(c, 0.0), 6) AS p2 FROM k")
def proba_vector(spark, sf_dir):
    v = src.proba_vector(group_cube(spark, sf_dir), ["grp", "id"], ["c0", "c1", "none"])
    return v.select("grp", "id", *[r6(F.get("proba", F.lit(k))).alias(f"p{k}") for k in range(3)])


@query("S14_describe_dataset", f"WITH {SERIES} SELECT count_if(split = 'train')::BIGINT AS n_train, count_if(split = 'test')::BIGINT AS n_test, min(len(vals))::BIGINT AS n_timepoints, 1::BIGINT AS n_channels, count(DISTINCT label) AS n_classes FROM series")
def describe_dataset(spark, sf_dir):
    return src.describe_dataset(series(spark, sf_dir))


@query("S14_eligible", f"WITH {SERIES}, d AS (SELECT 'd' || (id % 4)::VARCHAR AS dataset, count_if(split = 'test')::BIGINT AS n_test, count(DISTINCT label) AS n_classes FROM series GROUP BY ALL) SELECT * FROM d WHERE n_classes <= 10")
def eligible(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("dataset", F.concat(F.lit("d"), (F.col("id") % 4).cast("string")))
    return src.eligible(src.describe_dataset(s, by=["dataset"])).select("dataset", "n_test", "n_classes")


@query("S15_union_groups", f"WITH {CUBE} SELECT grp::INTEGER AS grp, count(*) AS n, round(sum(p), 6) AS total FROM cube GROUP BY ALL")
def union_groups(spark, sf_dir):
    cube = group_cube(spark, sf_dir)
    parts = [cube.where((F.col("grp") % 2) == k) for k in (0, 1)]
    return src.union_groups(*parts).groupBy("grp").agg(F.count("*").alias("n"), r6(F.sum("p")).alias("total"))


@query("S16_require_columns", f"WITH {SERIES} SELECT id, label FROM series")
def require_columns(spark, sf_dir):
    return src.require_columns(series(spark, sf_dir), ["ID", "label"]).select("id", "label")


@query("S16_missing_columns", "WITH o AS (SELECT o_custkey, list(DISTINCT lower(o_orderpriority)) AS have FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_filter(['1-urgent', '3-medium', '5-low'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM o")
def missing_columns(spark, sf_dir):
    """Which of three names each customer's orders lack."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("have"))
    return rows.select("o_custkey", F.concat_ws(",", src.missing_columns(F.col("have"), ["1-urgent", "3-medium", "5-low"])).alias("missing"))


@query("S17_preferred_runs", f"WITH {RECORDS} SELECT dataset, flag, setting, one FROM records WHERE size > 50 QUALIFY row_number() OVER (PARTITION BY dataset, flag ORDER BY setting) = 1")
def preferred_runs(spark, sf_dir):
    runs = supplier_records(spark, sf_dir).withColumn("failures", F.when(F.col("size") <= 50, F.array(F.lit("too small"))).otherwise(F.array().cast("array<string>")))
    path = new_folder(spark, "runs")
    src.write_run(runs, path)
    found = src.read_runs(spark, path, "dataset string, setting long, flag string, one double, failures array<string>")
    return src.preferred_runs(found, ["dataset", "flag"], F.col("setting")).select("dataset", "flag", "setting", "one")


# -- R: deterministic columns ------------------------------------------------------------------------------------------


@query("R1_splitmix64", f"WITH {mix_ctes('m', 'events', 'event_id::UHUGEINT', 'z')} SELECT event_id, (z >> 32)::BIGINT AS hi, (z % 4294967296)::BIGINT AS lo FROM m")
def splitmix64(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", prng.splitmix64(prng.u64_from(F.col("event_id"))).alias("z"))
    return e.select("event_id", F.col("z.hi").alias("hi"), F.col("z.lo").alias("lo"))


@query("R2_u64_algebra", "SELECT o_orderkey, ((o_orderkey::UHUGEINT * 11400714819323198485::UHUGEINT + 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::VARCHAR AS product FROM orders")
def u64_algebra(spark, sf_dir):
    z = prng.let(prng.u64_mul(prng.u64_from(F.col("o_orderkey")), prng.GOLDEN_GAMMA), lambda v: prng.u64_add(v, prng.u64_literal(prng.MIX_A)))
    out = table(spark, sf_dir, "orders").select("o_orderkey", z.alias("z"))
    whole = F.col("z.hi").cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(10,0)") + F.col("z.lo").cast("decimal(10,0)")
    return out.select("o_orderkey", whole.cast("decimal(20,0)").cast("string").alias("product"))


@query("R3_substream_seed", f"WITH {seed_ctes('s', 'orders', 'o_orderkey', SEED)} SELECT o_orderkey, (stream >> 32)::BIGINT AS hi, (stream % 4294967296)::BIGINT AS lo FROM s")
def substream_seed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", prng.substream_seed(SEED, F.col("o_orderkey")).alias("z"))
    return o.select("o_orderkey", F.col("z.hi").alias("hi"), F.col("z.lo").alias("lo"))


@query("R4_stable_uniform", f"WITH {uniform_ctes('x', 'events', 'event_id', SEED)} SELECT event_id, round(u, 9) AS u FROM x")
def stable_uniform(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(prng.stable_uniform(SEED, F.col("event_id")), 9).alias("u"))


@query("R5_stable_uniform_range", f"WITH {uniform_ctes('x', 'events', 'event_id', SEED, step='3')} SELECT event_id, round(-1.0 + 2.0 * u, 9) AS u FROM x")
def stable_uniform_range(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(prng.stable_uniform_range(SEED, F.col("event_id"), -1.0, 1.0, 3), 9).alias("u"))


@query("R6_stable_below", f"WITH {uniform_ctes('x', 'events', 'event_id', SEED, step='2')} SELECT floor(u * 10)::BIGINT AS k, count(*) AS n FROM x GROUP BY ALL")
def stable_below(spark, sf_dir):
    return table(spark, sf_dir, "events").select(prng.stable_below(SEED, F.col("event_id"), 10, 2).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


STREAMS = "parts0 AS (SELECT p_partkey AS kernel_id FROM part)"
PAIRS = f"""{STREAMS}, {seed_ctes('ps', 'parts0', 'kernel_id', SEED)},
grid AS (SELECT *, unnest(range(80))::BIGINT AS p FROM ps), grid2 AS (SELECT *, 2 + 2 * p AS step FROM grid),
{draw_ctes('du', 'grid2', 'step', 'u1')}, {draw_ctes('dv', 'du', 'step + 1', 'v1')},
pairs AS (SELECT kernel_id, p, step, 2 * u1 - 1 AS u, 2 * v1 - 1 AS v, (2 * u1 - 1) * (2 * u1 - 1) + (2 * v1 - 1) * (2 * v1 - 1) AS s FROM dv)"""


@query("R8_candidate_pairs", f"WITH {PAIRS} SELECT kernel_id, p, round(u, 9) AS u, round(v, 9) AS v, s > 0 AND s < 1 AS accepted FROM pairs")
def candidate_pairs(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("kernel_id"))
    out = prng.candidate_pairs(parts, SEED, "kernel_id", 80, 2)
    return out.select("kernel_id", "p", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"), ((F.col("s") > 0) & (F.col("s") < 1)).alias("accepted"))


@query("R7_stable_normals", f"WITH {PAIRS} SELECT kernel_id, row_number() OVER (PARTITION BY kernel_id ORDER BY p)::INTEGER AS k, round(u * sqrt(-2.0 * ln(s) / s), 6) AS normal FROM pairs WHERE s > 0 AND s < 1 QUALIFY k <= 5")
def stable_normals(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("kernel_id"))
    normals = prng.stable_normals(parts, SEED, "kernel_id", 5, 80, 2, enough=True)
    return normals.select("kernel_id", "k", r6("normal").alias("normal"))


# -- K: kernel banks ---------------------------------------------------------------------------------------------------


def bank_sql(source: str, n_ref: int, seed: int = SEED) -> str:
    """CTEs `params` (kernel_id, length, bias, dilation, padding) and `weights` (kernel_id, j, weight) for the kernels of a source with kernel_id."""
    return f"""{seed_ctes('ks', source, 'kernel_id', seed)}, {draw_ctes('kl', 'ks', '1', 'ul')},
kern AS (SELECT kernel_id, stream, [7, 9, 11][floor(ul * 3)::BIGINT + 1] AS length FROM kl),
kgrid AS (SELECT *, unnest(range(80))::BIGINT AS p FROM kern), kgrid2 AS (SELECT *, 2 + 2 * p AS step FROM kgrid),
{draw_ctes('kdu', 'kgrid2', 'step', 'u1')}, {draw_ctes('kdv', 'kdu', 'step + 1', 'v1')},
kpairs AS (SELECT *, 2 * u1 - 1 AS u, (2 * u1 - 1) * (2 * u1 - 1) + (2 * v1 - 1) * (2 * v1 - 1) AS s FROM kdv),
taps AS (SELECT kernel_id, length, stream, step, row_number() OVER (PARTITION BY kernel_id ORDER BY p) AS k, u * sqrt(-2.0 * ln(s) / s) AS normal FROM kpairs WHERE s > 0 AND s < 1 QUALIFY k <= length),
weights AS (SELECT kernel_id, (k - 1)::INTEGER AS j, normal - avg(normal) OVER (PARTITION BY kernel_id) AS weight FROM taps),
cur AS (SELECT kernel_id, length, stream, step + 1 AS cursor FROM taps WHERE k = length),
{draw_ctes('kb', 'cur', 'cursor + 1', 'ub')}, {draw_ctes('kd', 'kb', 'cursor + 2', 'ud')}, {draw_ctes('kp', 'kd', 'cursor + 3', 'up')},
params0 AS (SELECT *, floor(pow(2.0, ud * log2(({n_ref} - 1) / (length - 1)::DOUBLE)))::BIGINT AS dilation FROM kp),
params AS (SELECT kernel_id, length::INTEGER AS length, cursor::BIGINT AS cursor, -1.0 + 2.0 * ub AS bias, dilation, CASE WHEN floor(up * 2) = 1 THEN ((length - 1) * dilation) // 2 ELSE 0 END::BIGINT AS padding FROM params0)"""


def channel_bank_sql(source: str, n_ref: int | str, channels: int, seed: int = SEED, pairs: int = 240) -> str:
    """As bank_sql for several channels: CTEs `params` (kernel_id, length, n_sel, chosen, bias, dilation, padding) and `weights` (kernel_id, c, j, weight).

    Draw 2 says how many channels, the next ones swap them to the front of a list, then come the normals of one chosen
    channel after the other, bias, dilation and padding."""
    swaps, last = [], "mc0"
    for k in range(channels):
        swaps.append(draw_ctes(f"md{k}", last, str(3 + k), "uo"))
        moved = f"[CASE WHEN i = {k + 1} THEN ord[place] WHEN i = place THEN ord[{k + 1}] ELSE ord[i] END for i in range(1, {channels + 1})]"
        swaps.append(f"ma{k} AS (SELECT * EXCLUDE (uo), {k + 1} + CASE WHEN n_sel > {k} THEN floor(uo * {channels - k})::BIGINT ELSE 0 END AS place FROM md{k})")
        swaps.append(f"mc{k + 1} AS (SELECT * EXCLUDE (ord, place), {moved} AS ord FROM ma{k})")
        last = f"mc{k + 1}"
    return f"""{seed_ctes('ks', source, 'kernel_id', seed)}, {draw_ctes('kl', 'ks', '1', 'ul')}, {draw_ctes('kc', 'kl', '2', 'uc')},
mc0 AS (SELECT kernel_id, stream, [7, 9, 11][floor(ul * 3)::BIGINT + 1] AS length, greatest(1, least({channels}, floor(pow(2.0, uc * log2({channels} + 1)))))::BIGINT AS n_sel, range({channels}) AS ord FROM kc),
{', '.join(swaps)},
kern AS (SELECT * EXCLUDE (ord), list_sort(ord[1 : n_sel]) AS chosen FROM {last}),
kgrid AS (SELECT *, unnest(range({pairs}))::BIGINT AS p FROM kern), kgrid2 AS (SELECT *, 3 + n_sel + 2 * p AS step FROM kgrid),
{draw_ctes('kdu', 'kgrid2', 'step', 'u1')}, {draw_ctes('kdv', 'kdu', 'step + 1', 'v1')},
kpairs AS (SELECT *, 2 * u1 - 1 AS u, (2 * u1 - 1) * (2 * u1 - 1) + (2 * v1 - 1) * (2 * v1 - 1) AS s FROM kdv),
taps AS (SELECT kernel_id, length, n_sel, chosen, stream, step, row_number() OVER (PARTITION BY kernel_id ORDER BY p) - 1 AS k, u * sqrt(-2.0 * ln(s) / s) AS normal FROM kpairs WHERE s > 0 AND s < 1 QUALIFY k < length * n_sel),
weights AS (SELECT kernel_id, chosen[k // length + 1] AS c, (k % length)::INTEGER AS j, normal - avg(normal) OVER (PARTITION BY kernel_id, k // length) AS weight FROM taps),
cur AS (SELECT kernel_id, length, n_sel, chosen, stream, step + 1 AS cursor FROM taps WHERE k = length * n_sel - 1),
{draw_ctes('kb', 'cur', 'cursor + 1', 'ub')}, {draw_ctes('kd', 'kb', 'cursor + 2', 'ud')}, {draw_ctes('kp', 'kd', 'cursor + 3', 'up')},
params0 AS (SELECT *, floor(pow(2.0, ud * log2(({n_ref} - 1) / (length - 1)::DOUBLE)))::BIGINT AS dilation FROM kp),
params AS (SELECT kernel_id, length::INTEGER AS length, n_sel, chosen, -1.0 + 2.0 * ub AS bias, dilation, CASE WHEN floor(up * 2) = 1 THEN ((length - 1) * dilation) // 2 ELSE 0 END::BIGINT AS padding FROM params0)"""


SUPPLIERS = "kids AS (SELECT s_suppkey AS kernel_id FROM supplier)"


def supplier_kernels(spark, sf_dir):
    """One kernel per supplier: the bank grows with the table."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("kernel_id"))


@query("K1_kernel_params", f"WITH {SUPPLIERS}, {bank_sql('kids', 64)} SELECT kernel_id, length, cursor, round(bias, 9) AS bias, dilation, padding FROM params")
def kernel_params(spark, sf_dir):
    out = kernels.kernel_params(supplier_kernels(spark, sf_dir), SEED, 64)
    return out.select("kernel_id", "length", "cursor", F.round("bias", 9).alias("bias"), "dilation", "padding")


@query("K2_kernel_weights", f"WITH {SUPPLIERS}, {bank_sql('kids', 64)} SELECT kernel_id, j, round(weight, 6) AS weight FROM weights")
def kernel_weights(spark, sf_dir):
    return kernels.kernel_weights(supplier_kernels(spark, sf_dir), SEED).select("kernel_id", "j", r6("weight").alias("weight"))


@query("K3_kernel_bank", f"WITH {SUPPLIERS}, {bank_sql('kids', 64)}, w AS (SELECT kernel_id, round(max(weight), 6) AS top FROM weights GROUP BY ALL) SELECT kernel_id, length, round(bias, 9) AS bias, dilation, padding, top FROM params JOIN w USING (kernel_id)")
def kernel_bank(spark, sf_dir):
    """The NumPy bank of one kernel per supplier, against the relational form in SQL."""
    last = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    bank = kernels.kernel_bank(spark, SEED, 64, int(last) + 1)
    own = bank.join(supplier_kernels(spark, sf_dir), "kernel_id")
    return own.select("kernel_id", "length", F.round("bias", 9).alias("bias"), "dilation", "padding", r6(F.array_max(F.get("weights", F.lit(0)))).alias("top"))


@query("K4_multichannel_bank", f"WITH {SUPPLIERS}, {channel_bank_sql('kids', 64, 6)} SELECT kernel_id, length, round(bias, 6) AS bias, dilation, padding, n_sel::INTEGER AS n_channels, array_to_string(chosen, ',') AS channels FROM params")
def multichannel_bank(spark, sf_dir):
    last = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    bank = kernels.kernel_bank(spark, SEED, 64, int(last) + 1, channels=6).join(supplier_kernels(spark, sf_dir), "kernel_id")
    return bank.select("kernel_id", "length", r6("bias").alias("bias"), "dilation", "padding", F.size("channels").alias("n_channels"), F.concat_ws(",", F.transform("channels", lambda c: c.cast("string"))).alias("channels"))


@query("K5_bank_group", f"WITH {SUPPLIERS}, {bank_sql('kids', 64)} SELECT kernel_id // 25 AS grp, count(*) AS n, round(sum(bias), 6) AS bias FROM params GROUP BY ALL")
def bank_group(spark, sf_dir):
    grouped = kernels.with_group(kernels.kernel_params(supplier_kernels(spark, sf_dir), SEED, 64), 25)
    return grouped.groupBy("grp").agg(F.count("*").alias("n"), r6(F.sum("bias")).alias("bias"))


@query("K6_config_check", f"WITH {SERIES} SELECT count(*) AS n, 500::BIGINT AS features_per_group, (count(*) * 500)::BIGINT AS cells FROM series")
def config_check(spark, sf_dir):
    c = kernels.EnsembleConfig().validate()
    return series(spark, sf_dir).agg(F.count("*").alias("n")).withColumn("features_per_group", F.lit(c.features_per_group).cast("long")).withColumn("cells", F.col("n") * c.features_per_group)


@query("K6_config_report", "WITH c AS (SELECT p_size * 100 AS k, p_partkey % 13 - 1 AS g, p_partkey % 4 AS e FROM part), r AS (SELECT CASE WHEN k <= 0 OR g <= 0 OR e <= 0 THEN 'n_kernels, n_groups and estimators must be positive' WHEN k % g <> 0 THEN 'n_kernels ' || k || ' is not divisible by n_groups ' || g WHEN k // g * 2 > 2000 THEN (k // g * 2) || ' features per group exceed 2000' WHEN k // g * 2 > 500 * e THEN e || ' estimator(s) of 500 features do not cover ' || (k // g * 2) ELSE 'good' END AS problem FROM c) SELECT problem, count(*) AS n FROM r GROUP BY problem")
def config_report(spark, sf_dir):
    """The sizes of an ensemble for each part, and what is wrong with them."""
    c = table(spark, sf_dir, "part").select((F.col("p_size") * 100).alias("k"), (F.col("p_partkey") % 13 - 1).alias("g"), (F.col("p_partkey") % 4).alias("e"))
    problem = F.coalesce(kernels.config_problem(F.col("k"), F.col("g"), F.col("e")), F.lit("good"))
    return c.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


@query("K7_bank_fingerprints", f"WITH {SERIES}, g AS (SELECT unnest(range(8)) AS grp, vals FROM series) SELECT grp::INTEGER AS grp, round(sum(list_sum(vals[grp * 8 + 1 : grp * 8 + 8])), 4) AS fingerprint FROM g GROUP BY ALL")
def bank_fingerprints(spark, sf_dir):
    g = src.group_features(series(spark, sf_dir).withColumnRenamed("values", "features"), 8, 8)
    return kernels.bank_fingerprints(g).select("grp", F.round("fingerprint", 4).alias("fingerprint"))


@query("K8_bank_table", f"WITH {SUPPLIERS}, {bank_sql('kids', 64)}, k AS (SELECT unnest(['max', 'ppv']) AS kind, unnest([0, 1]) AS o, * FROM params) SELECT (2 * kernel_id + o)::BIGINT AS feature_id, kernel_id, kind, length, dilation FROM k")
def bank_table(spark, sf_dir):
    return kernels.bank_table(kernels.kernel_params(supplier_kernels(spark, sf_dir), SEED, 64)).select("feature_id", "kernel_id", "kind", "length", "dilation")


# -- T: transform ------------------------------------------------------------------------------------------------------

#: Kernels of the transform, and of its relational and lambda twins.
BANK, KERNELS = 100, 4


def conv_ctes(k: int, n_ref: int | str = 64) -> str:
    """CTE `conv` (id, kernel_id, o, c): the convolutions of `long` (id, t, value) with the first k kernels; n_ref may be a scalar subquery."""
    return f"""kids AS (SELECT unnest(range({k}))::BIGINT AS kernel_id), {bank_sql('kids', n_ref)},
shape AS (SELECT id, count(*) AS n FROM long GROUP BY id), bank AS MATERIALIZED (SELECT w.kernel_id, j, weight, length, bias, dilation, padding FROM weights w JOIN params p USING (kernel_id)),
places AS (SELECT id, kernel_id, bias, dilation, padding, unnest(range(n + 2 * padding - (length - 1) * dilation)) AS o FROM shape, (SELECT DISTINCT kernel_id, length, bias, dilation, padding FROM bank)),
terms AS (SELECT p.id, p.kernel_id, p.o, p.bias, b.weight, p.o + b.j * p.dilation - p.padding AS t FROM places p JOIN bank b USING (kernel_id)),
conv AS (SELECT x.id, x.kernel_id, x.o, any_value(x.bias) + sum(x.weight * l.value) AS c FROM terms x JOIN long l ON l.id = x.id AND l.t = x.t GROUP BY ALL)"""


FEATURES_SQL = "SELECT id, kernel_id, round(max(c), 6) AS max, round(count_if(c > 0) / count(*)::DOUBLE, 9) AS ppv FROM conv GROUP BY ALL"
CONV_SQL, BANK_SQL = (f"WITH {LONG}, {conv_ctes(k)} {FEATURES_SQL}" for k in (KERNELS, BANK))
EVENTS = "long AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events)"
SHORTEST = "(SELECT greatest(11, min(n)) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))"


def _flat(df):
    """(id, kernel_id, max, ppv) from interleaved features."""
    both = df.select("id", fs.maxes(F.col("features")).alias("m"), fs.ppvs(F.col("features")).alias("p"))
    rows = both.select("id", F.posexplode(F.arrays_zip("m", "p")).alias("k", "f"))
    return rows.select("id", F.col("k").cast("long").alias("kernel_id"), r6(F.col("f.m")).alias("max"), F.round(F.col("f.p"), 9).alias("ppv"))


@query("T1_conv_features", BANK_SQL)
def conv_features(spark, sf_dir):
    return _flat(transform.conv_features(series(spark, sf_dir).select("id", "values"), "values", BANK, SEED))


@query("T1_conv_features_sql", BANK_SQL)
def conv_features_sql(spark, sf_dir):
    """The transform as a SQL function."""
    transform.register(spark)
    series(spark, sf_dir).createOrReplaceTempView("convseries_series")
    found = spark.sql(f"SELECT id, conv_features(values, {BANK}, {SEED}, 0) AS features FROM convseries_series")
    return _flat(found)


@query("K3_kernel_bank_sql", f"WITH {SUPPLIERS}, {bank_sql('kids', 64)} SELECT kernel_id, p.length, j, round(weight, 6) AS weight, round(bias, 9) AS bias, dilation, padding FROM weights w JOIN params p USING (kernel_id)")
def kernel_bank_sql(spark, sf_dir):
    """Kernels by a table function that is called for every supplier."""
    transform.register(spark)
    supplier_kernels(spark, sf_dir).createOrReplaceTempView("convseries_kernels")
    return spark.sql(f"""SELECT b.kernel_id, length, j, round(weight, 6) AS weight, round(bias, 9) AS bias, dilation, padding
                         FROM convseries_kernels k, LATERAL kernel_bank({SEED}, 64, 1, k.kernel_id) b""")


LINES = f"""line AS (SELECT l_suppkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)}, l_quantity, l_extendedprice, l_discount) - 1 AS t, l_quantity, l_extendedprice, l_discount FROM lineitem),
long AS (SELECT id, t, 0 AS c, l_quantity::DOUBLE AS value FROM line UNION ALL SELECT id, t, 1, l_extendedprice::DOUBLE FROM line UNION ALL SELECT id, t, 2, l_discount::DOUBLE FROM line)"""
FEWEST_LINES = "(SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey))"
CHANNELS_SQL = f"""WITH {LINES}, kids AS (SELECT unnest(range(50))::BIGINT AS kernel_id), {channel_bank_sql('kids', FEWEST_LINES, 3)},
shape AS (SELECT id, count(*) AS n FROM line GROUP BY id), bank AS MATERIALIZED (SELECT w.kernel_id, c, j, weight, dilation, padding FROM weights w JOIN params p USING (kernel_id)),
places AS (SELECT id, kernel_id, bias, dilation, padding, unnest(range(n + 2 * padding - (length - 1) * dilation)) AS o FROM shape, params),
terms AS (SELECT p.id, p.kernel_id, p.o, p.bias, b.c, b.weight, p.o + b.j * b.dilation - b.padding AS t FROM places p JOIN bank b USING (kernel_id)),
conv AS (SELECT x.id, x.kernel_id, x.o, any_value(x.bias) + sum(x.weight * l.value) AS v FROM terms x JOIN long l ON l.id = x.id AND l.t = x.t AND l.c = x.c GROUP BY ALL)
SELECT id, kernel_id, round(max(v), 2) AS max, round(count_if(v > 0) / count(*)::DOUBLE, 9) AS ppv FROM conv GROUP BY ALL"""


@query("T2_conv_features_channels", CHANNELS_SQL)
def conv_features_channels(spark, sf_dir):
    """Three channels; the largest values are sums of prices, so two decimals tell as much as six elsewhere."""
    rows = supplier_channels(spark, sf_dir).withColumnRenamed("l_suppkey", "id")
    n_ref = transform.reference_length(rows).first()["n_ref"]
    return _flat(transform.conv_features(rows, "values", 50, SEED, 0, n_ref)).withColumn("max", F.round("max", 2))


@query("T3_conv_features_ragged", f"WITH {EVENTS}, {conv_ctes(100, SHORTEST)} {FEATURES_SQL}")
def conv_features_ragged(spark, sf_dir):
    rows = user_series(spark, sf_dir).withColumnRenamed("user_id", "id")
    n_ref = transform.reference_length(rows).first()["n_ref"]
    return _flat(transform.conv_features(rows, "values", 100, SEED, 0, max(11, n_ref)))


@query("T4_conv_features_relational", CONV_SQL)
def conv_features_relational(spark, sf_dir):
    bank = kernels.bank_long(spark.range(KERNELS).withColumnRenamed("id", "kernel_id"), SEED, 64)
    out = transform.conv_features_relational(src.explode_series(series(spark, sf_dir), ["id"]), kept(bank))
    return out.select("id", "kernel_id", r6("max").alias("max"), F.round("ppv", 9).alias("ppv"))


@query("T5_conv_features_hof", CONV_SQL)
def conv_features_hof(spark, sf_dir):
    out = transform.conv_features_hof(series(spark, sf_dir), kernels.kernel_bank(spark, SEED, 64, KERNELS))
    return out.select("id", "kernel_id", r6("max").alias("max"), F.round("ppv", 9).alias("ppv"))


@query("T6_output_length", f"WITH {SUPPLIERS}, {bank_sql('kids', 64)} SELECT kernel_id, (64 + 2 * padding - (length - 1) * dilation)::BIGINT AS positions FROM params")
def output_length(spark, sf_dir):
    p = kernels.kernel_params(supplier_kernels(spark, sf_dir), SEED, 64)
    return p.select("kernel_id", fs.output_length(F.lit(64), F.col("padding"), F.col("length"), F.col("dilation")).cast("long").alias("positions"))


@query("T7_max_and_ppv", f"WITH {SERIES} SELECT id, round(list_max(vals), 6) AS max, round(len(list_filter(vals, lambda x: x > 0)) / len(vals)::DOUBLE, 9) AS ppv FROM series")
def max_and_ppv(spark, sf_dir):
    return series(spark, sf_dir).select("id", r6(fs.conv_max(F.col("values"))).alias("max"), F.round(fs.ppv(F.col("values")), 9).alias("ppv"))


@query("T8_interleaved", f"WITH {LONG} SELECT id, round(sum(CASE WHEN t % 2 = 0 THEN value END), 6) AS evens, round(sum(CASE WHEN t % 2 = 1 THEN value END), 6) AS odds FROM long GROUP BY ALL")
def interleaved(spark, sf_dir):
    x = F.col("values")
    return series(spark, sf_dir).select("id", r6(fs.array_sum(fs.maxes(x))).alias("evens"), r6(fs.array_sum(fs.ppvs(x))).alias("odds"))


@query("T9_normalize_series", f"WITH {LONG}, m AS (SELECT id, avg(value) AS mean, stddev_pop(value) AS sd FROM long GROUP BY id) SELECT id, t, round((value - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1.0 END, 6) AS value FROM long JOIN m USING (id)")
def normalize_series(spark, sf_dir):
    n = series(spark, sf_dir).withColumn("values", fs.normalize_series(F.col("values")))
    return src.explode_series(n, ["id"]).select("id", F.col("t").cast("long").alias("t"), r6("value").alias("value"))


@query("T10_reference_length", "SELECT min(n)::BIGINT AS n_ref FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def reference_length(spark, sf_dir):
    return transform.reference_length(user_series(spark, sf_dir))


@query("T11_truncate_series", "SELECT user_id, round(sum(value), 6) AS total, count(*) AS n FROM (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 40) GROUP BY user_id")
def truncate_series(spark, sf_dir):
    cut = user_series(spark, sf_dir).withColumn("values", fs.truncate_series(F.col("values"), 40))
    return cut.select("user_id", r6(fs.array_sum(F.col("values"))).alias("total"), F.size("values").cast("long").alias("n"))


@query("T12_length_bias", f"WITH {EVENTS}, {conv_ctes(50, SHORTEST)}, f AS (SELECT id, max(c) AS m, count_if(c > 0) / count(*)::DOUBLE AS p FROM conv GROUP BY id, kernel_id) SELECT n::INTEGER AS n, round(avg(m), 6) AS mean_max, round(avg(p), 6) AS mean_ppv FROM f JOIN shape USING (id) GROUP BY n")
def length_bias(spark, sf_dir):
    rows = user_series(spark, sf_dir)
    n_ref = max(11, transform.reference_length(rows).first()["n_ref"])
    biased = transform.length_bias(transform.conv_features(rows, "values", 50, SEED, 0, n_ref))
    return biased.select("n", r6("mean_max").alias("mean_max"), r6("mean_ppv").alias("mean_ppv"))


@query("T13_validate_series", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN n < 11 THEN 'shorter than the longest kernel' WHEN n < 14 THEN 'below n_reference' ELSE 'good' END AS problem FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) GROUP BY ALL")
def validate_series(spark, sf_dir):
    rows = src.assemble_series(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    problem = F.coalesce(transform.series_problem(F.col("values"), 14), F.lit("good"))
    return rows.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


# -- F: statistics and families ----------------------------------------------------------------------------------------


@query(
    "F1_series_statistics",
    f"""WITH {LONG}, m AS (SELECT id, avg(value) AS mean, count(*) AS n FROM long GROUP BY id),
w AS (SELECT l.*, m.mean, m.n, lag(value) OVER o AS before, lead(value) OVER o AS after FROM long l JOIN m USING (id) WINDOW o AS (PARTITION BY id ORDER BY t)),
peaks AS (SELECT id, count_if(value > before AND value > after)::DOUBLE AS number_peaks, round(quantile_cont(value, 0.1), 6) AS quantile_q10, round(quantile_cont(value, 0.5), 6) AS quantile_q50, round(quantile_cont(value, 0.9), 6) AS quantile_q90,
  round(sqrt(pow(sum(value * cos(-2 * pi() * 6 * t / n)), 2) + pow(sum(value * sin(-2 * pi() * 6 * t / n)), 2)), 6) AS fft_coefficient_6_abs,
  round(sqrt(pow(sum(value * cos(-2 * pi() * 1 * t / n)), 2) + pow(sum(value * sin(-2 * pi() * 1 * t / n)), 2)), 6) AS fft_coefficient_1_abs,
  round(sqrt(pow(sum(value * cos(-2 * pi() * 5 * t / n)), 2) + pow(sum(value * sin(-2 * pi() * 5 * t / n)), 2)), 6) AS fft_coefficient_5_abs FROM w GROUP BY id),
isl AS (SELECT id, t - row_number() OVER (PARTITION BY id ORDER BY t) AS island FROM w WHERE value > mean),
runs AS (SELECT id, max(k)::DOUBLE AS longest_strike_above_mean FROM (SELECT id, island, count(*) AS k FROM isl GROUP BY ALL) GROUP BY id)
SELECT id, number_peaks, longest_strike_above_mean, quantile_q10, quantile_q50, quantile_q90, fft_coefficient_1_abs, fft_coefficient_5_abs, fft_coefficient_6_abs FROM peaks JOIN runs USING (id)""",
)
def series_statistics(spark, sf_dir):
    out = statistics.series_statistics(series(spark, sf_dir).select("id", "values"))
    return out.select("id", "number_peaks", "longest_strike_above_mean", *[r6(c).alias(c) for c in ("quantile_q10", "quantile_q50", "quantile_q90", "fft_coefficient_1_abs", "fft_coefficient_5_abs", "fft_coefficient_6_abs")])


ENTROPY = "-sum(k / s::DOUBLE * ln(k / s::DOUBLE))"
ENTROPIES = f"""{EVENTS}, m AS (SELECT id, count(*) AS n, min(value) AS lo, max(value) AS hi, 0.2 * stddev_pop(value) AS tol FROM long GROUP BY id),
x AS (SELECT l.id, l.t, l.value AS a, lead(value) OVER o AS b, lead(value, 2) OVER o AS c, n, lo, hi, tol FROM long l JOIN m USING (id) WINDOW o AS (PARTITION BY id ORDER BY t)),
perm AS (SELECT id, {ENTROPY} AS permutation_entropy FROM (SELECT id, k, sum(k) OVER (PARTITION BY id) AS s FROM (SELECT id, (a > b)::INTEGER * 4 + (a > c)::INTEGER * 2 + (b > c)::INTEGER AS code, count(*) AS k FROM x WHERE t < n - 2 GROUP BY ALL)) GROUP BY id),
bins AS (SELECT id, {ENTROPY} AS binned_entropy FROM (SELECT id, k, sum(k) OVER (PARTITION BY id) AS s FROM (SELECT id, CASE WHEN hi > lo THEN least(9, floor((a - lo) / ((hi - lo) / 10)))::INTEGER ELSE 0 END AS cell, count(*) AS k FROM x GROUP BY ALL)) GROUP BY id),
near AS (SELECT p.id, count_if(greatest(abs(p.a - q.a), abs(p.b - q.b)) <= p.tol) AS two, count_if(greatest(abs(p.a - q.a), abs(p.b - q.b), abs(p.c - q.c)) <= p.tol) AS three FROM x p JOIN x q ON p.id = q.id AND p.t < q.t WHERE q.t < q.n - 2 GROUP BY p.id)"""


@query("F1_series_entropies", f"WITH {ENTROPIES} SELECT id AS user_id, round(permutation_entropy, 6) AS permutation_entropy, round(binned_entropy, 6) AS binned_entropy, round(CASE WHEN two = 0 THEN 'nan'::DOUBLE WHEN three = 0 THEN 'inf'::DOUBLE ELSE -ln(three / two::DOUBLE) END, 6) AS sample_entropy FROM perm JOIN bins USING (id) JOIN near USING (id)")
def series_entropies(spark, sf_dir):
    out = statistics.series_statistics(user_series(spark, sf_dir))
    return out.select("user_id", *[r6(c).alias(c) for c in ("permutation_entropy", "binned_entropy", "sample_entropy")])


@query("F2_finite_guard", "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 3 = 0 THEN 'inf'::DOUBLE ELSE o_totalprice END AS x FROM orders) SELECT o_orderkey, CASE WHEN x IS NULL OR NOT isfinite(x) THEN 0.0 ELSE round(x, 2) END AS x, CASE WHEN x IS NOT NULL AND NOT isfinite(x) THEN 1 ELSE 0 END::INTEGER AS nonfinite FROM o")
def finite_guard(spark, sf_dir):
    k = F.col("o_orderkey")
    x = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.lit(float("nan"))).when(k % 3 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    out = statistics.finite_guard(table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")), ["x"])
    return out.select("o_orderkey", F.round("x", 2).alias("x"), "nonfinite")


@query("F3_combine_features", f"WITH {SERIES} SELECT id, (len(vals) + 2)::BIGINT AS n, round(list_sum(vals) + list_max(vals) + list_min(vals), 6) AS total FROM series")
def combine_features(spark, sf_dir):
    s = series(spark, sf_dir).select("id", F.col("values").alias("features"), F.array_max("values").alias("top"), F.array_min("values").alias("low"))
    out = statistics.combine_features(s, ["top", "low"])
    return out.select("id", F.size("features").cast("long").alias("n"), r6(fs.array_sum(F.col("features"))).alias("total"))


@query("F4_family_rules", f"WITH {SERIES} SELECT 'statistics' AS family, count(*) AS n FROM series")
def family_rules(spark, sf_dir):
    return series(spark, sf_dir).groupBy(F.lit(statistics.check_family("statistics", 1, 1)).alias("family")).agg(F.count("*").alias("n"))


@query("F4_family_report", "WITH c AS (SELECT ['kernels', 'statistics', 'both', 'other'][l_linenumber % 4 + 1] AS family, l_orderkey % 3 AS g, l_partkey % 2 + 1 AS ch FROM lineitem), r AS (SELECT CASE WHEN family = 'other' THEN 'unknown feature family other' WHEN family = 'statistics' AND g <> 1 THEN 'a family without a group axis needs n_groups = 1' WHEN family <> 'kernels' AND ch > 1 THEN 'statistics are defined for one channel' ELSE 'good' END AS problem FROM c) SELECT problem, count(*) AS n FROM r GROUP BY problem")
def family_report(spark, sf_dir):
    """Feature families asked for by the line items, and what is wrong with them."""
    l = table(spark, sf_dir, "lineitem")
    family = F.get(F.array(*map(F.lit, ("kernels", "statistics", "both", "other"))), (F.col("l_linenumber") % 4).cast("int"))
    problem = statistics.family_problem(family, F.col("l_orderkey") % 3, F.col("l_partkey") % 2 + 1)
    return l.groupBy(F.coalesce(problem, F.lit("good")).alias("problem")).agg(F.count("*").alias("n"))


WIDE = "w AS (SELECT id, split, vals[1] AS f0, vals[2] AS f1 FROM series)"


def _wide(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.select("id", "split", *[F.get("values", F.lit(k)).alias(f"f{k}") for k in range(2)])


@query("F5_standardize", f"WITH {SERIES}, {WIDE}, m AS (SELECT avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1 FROM w WHERE split = 'train') SELECT id, round((f0 - m0) / s0, 6) AS f0, round((f1 - m1) / s1, 6) AS f1 FROM w, m")
def standardize(spark, sf_dir):
    return statistics.standardize(_wide(spark, sf_dir), ["f0", "f1"]).select("id", r6("f0").alias("f0"), r6("f1").alias("f1"))


@query("F6_block_scale", f"WITH {SERIES}, {WIDE}, m AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1 FROM w WHERE split = 'train') SELECT id, round(sqrt(9.0) * (f1 - m1) / s1, 6) AS f1 FROM w, m")
def block_scale(spark, sf_dir):
    return statistics.block_scale(statistics.standardize(_wide(spark, sf_dir), ["f0", "f1"]), ["f1"], 9).select("id", r6("f1").alias("f1"))


@query("F7_stack_heads", f"WITH {SERIES}, d AS (SELECT id, split, label AS cls, vals[1] AS d1, vals[2] AS d2 FROM series), m AS (SELECT cls, avg(d1) AS m1, stddev_pop(d1) AS s1, avg(d2) AS m2, stddev_pop(d2) AS s2 FROM d WHERE split = 'train' GROUP BY cls) SELECT id, cls, round(0.75 * (d1 - m1) / s1 + 0.25 * (d2 - m2) / s2, 6) AS d FROM d JOIN m USING (cls)")
def stack_heads(spark, sf_dir):
    s = series(spark, sf_dir)
    d = s.select("id", "split", F.col("label").alias("cls"), F.get("values", F.lit(0)).alias("d1"), F.get("values", F.lit(1)).alias("d2"))
    return statistics.stack_heads(d, 0.25).select("id", "cls", r6("d").alias("d"))


IMPORTANCE = "imp AS (SELECT 's' || l_suppkey::VARCHAR AS dataset, 'f' || (l_partkey % 20)::VARCHAR AS name, round(sum(l_quantity), 6) AS value FROM lineitem GROUP BY ALL)"


def _importance(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dataset"), F.concat(F.lit("f"), (F.col("l_partkey") % 20).cast("string")).alias("name")).agg(r6(F.sum("l_quantity")).alias("value"))


def binom_sf_sql(k: str, n: str, p: str) -> str:
    """P(X >= k) in DuckDB: terms by log-gamma."""
    return f"CASE WHEN {k} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - ({p})))))) END"


def p_sql(wins: str, losses: str) -> str:
    """The two-sided sign test in DuckDB."""
    return f"CASE WHEN {wins} + {losses} = 0 THEN 1.0 ELSE least(1.0, 2 * {binom_sf_sql(f'greatest({wins}, {losses})', f'({wins} + {losses})', '0.5')}) END"


@query(
    "F10_select_features",
    f"""WITH {IMPORTANCE}, r AS (SELECT name, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, name) AS k FROM imp), n AS (SELECT count(DISTINCT dataset) AS d, count(DISTINCT name) AS f FROM imp),
c AS (SELECT name, count_if(k <= 3)::BIGINT AS n_top FROM r GROUP BY name), p AS (SELECT name, n_top, {binom_sf_sql('n_top', 'd', '3.0 / f')} AS p_value FROM c, n),
b AS (SELECT *, row_number() OVER (ORDER BY p_value, name) AS rank, count(*) OVER () AS m FROM p), q AS (SELECT *, max(CASE WHEN p_value <= 0.5 * rank / m THEN rank ELSE 0 END) OVER () AS cut FROM b)
SELECT name, n_top, round(p_value, 6) AS p_value, rank <= cut AS survives FROM q""",
)
def select_features(spark, sf_dir):
    return statistics.select_features(_importance(spark, sf_dir), 3, 0.5).select("name", "n_top", r6("p_value").alias("p_value"), "survives")


ARMS = f"{RECORDS}, arms AS (SELECT dataset, flag AS arm, round(avg(one), 6) AS accuracy FROM records GROUP BY ALL)"


def _arms(spark, sf_dir):
    return supplier_records(spark, sf_dir).groupBy("dataset", F.col("flag").alias("arm")).agg(r6(F.avg("one")).alias("accuracy"))


@query("F11_family_summary", f"WITH {ARMS}, d AS (SELECT a.arm, round(a.accuracy - b.accuracy, 6) AS d FROM arms a JOIN arms b ON a.dataset = b.dataset AND b.arm = 'A' WHERE a.arm <> 'A') SELECT arm, count(*) AS n, count_if(d > 0)::BIGINT AS wins, count_if(d = 0)::BIGINT AS ties, count_if(d < 0)::BIGINT AS losses, round(avg(d), 6) AS mean_delta, round(quantile_cont(d, 0.5), 6) AS median_delta, round(max(d), 6) AS best, round(min(d), 6) AS worst FROM d GROUP BY arm")
def family_summary(spark, sf_dir):
    out = statistics.family_summary(_arms(spark, sf_dir), "A")
    return out.select("arm", "n", "wins", "ties", "losses", *[r6(c).alias(c) for c in ("mean_delta", "median_delta", "best", "worst")])


@query("F11_oracle_arm", f"WITH {ARMS} SELECT dataset, arm, accuracy FROM arms QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, arm) = 1")
def oracle_arm(spark, sf_dir):
    return statistics.oracle_arm(_arms(spark, sf_dir))


@query("F11_accuracy_bands", f"WITH {ARMS}, d AS (SELECT (b.accuracy >= 0.45)::INTEGER + (b.accuracy >= 0.5)::INTEGER + (b.accuracy >= 0.55)::INTEGER AS band, a.arm, a.accuracy - b.accuracy AS d FROM arms a JOIN arms b ON a.dataset = b.dataset AND b.arm = 'A' WHERE a.arm <> 'A') SELECT band::INTEGER AS band, arm, count(*) AS n, round(avg(d), 6) AS mean_delta FROM d GROUP BY ALL")
def accuracy_bands(spark, sf_dir):
    return statistics.accuracy_bands(_arms(spark, sf_dir), "A", (0.45, 0.5, 0.55)).select("band", "arm", "n", r6("mean_delta").alias("mean_delta"))
