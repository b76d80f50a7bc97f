"""Kernels and the transform against a plain loop, and the three forms against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from convseries.functions import series as fs
from convseries.functions.prng import Streams
from convseries.operators import kernels, transform
from convseries.sources import series as src


def naive(x, kernel):
    """x: list of channels."""
    _, length, weights, bias, dilation, padding, channels = kernel
    n = len(x[0])
    conv = []
    for o in range(n + 2 * padding - (length - 1) * dilation):
        total = bias
        for c, own in zip(channels, weights):
            for j, w in enumerate(own):
                t = o + j * dilation - padding
                if 0 <= t < n:
                    total += w * x[c][t]
        conv.append(total)
    return [max(conv), sum(v > 0 for v in conv) / len(conv)]


def features(spark, series, kind, *args, **options):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(series)], f"id long, values {kind}")
    return [r.features for r in transform.conv_features(df, "values", *args, **options).orderBy("id").collect()]


def test_kernels_have_the_stated_form():
    for k in kernels.draw_kernels(3, np.arange(300), 64):
        assert k[1] in (7, 9, 11) and -1 <= k[3] < 1 and k[4] >= 1
        assert (k[1] - 1) * k[4] <= 63 and k[5] in (0, (k[1] - 1) * k[4] // 2)
        assert abs(sum(k[2][0])) < 1e-12 and len(k[2][0]) == k[1]


def test_known_dilations():
    at64, at65 = kernels.draw_kernels(0, np.arange(8), 64), kernels.draw_kernels(0, np.arange(8), 65)
    assert (at64[3][4], at64[5][4], at64[5][5]) == (8, 5, 15)
    assert (at65[3][4], at65[5][4], at65[5][5]) == (9, 6, 18)
    assert [k[2] for k in at64] == [k[2] for k in at65]


def test_slices_of_a_bank_and_one_channel_identity():
    whole = kernels.draw_kernels(7, np.arange(20), 40)
    assert kernels.draw_kernels(7, np.arange(10, 20), 40) == whole[10:]
    assert kernels.draw_kernels(7, np.arange(20), 40, channels=1) == whole
    many = kernels.draw_kernels(7, np.arange(50), 40, channels=6)
    for k in many:
        assert k[6] == sorted(set(k[6])) and 1 <= len(k[6]) <= 6 and len(k[2]) == len(k[6])
        assert all(abs(sum(w)) < 1e-12 for w in k[2])


def test_transform_equals_the_loop(spark):
    rng = np.random.default_rng(1)
    series = rng.normal(size=(3, 50)).tolist()
    bank = kernels.draw_kernels(5, np.arange(12), 50)
    for got, x in zip(features(spark, series, "array<double>", 12, 5), series):
        assert got == pytest.approx([v for k in bank for v in naive([x], k)], abs=1e-12)
    channels = rng.normal(size=(2, 4, 30)).tolist()
    bank = kernels.draw_kernels(5, np.arange(10), 30, 4)
    for got, x in zip(features(spark, channels, "array<array<double>>", 10, 5), channels):
        assert got == pytest.approx([v for k in bank for v in naive(x, k)], abs=1e-12)


def test_groups_null_and_reference_length(spark):
    x = list(map(float, range(1, 17)))
    whole, part = features(spark, [x], "array<double>", 8, 7)[0], features(spark, [x], "array<double>", 4, 7, 4)[0]
    assert whole[8:16] == part and len(whole) == 16 and all(0 <= v <= 1 for v in whole[1::2])
    assert features(spark, [None], "array<double>", 4, 0) == [None]
    assert features(spark, [[x]], "array<array<double>>", 8, 7)[0] == whole
    y = list(map(float, range(96)))
    assert features(spark, [y], "array<double>", 3, 0) != features(spark, [y], "array<double>", 3, 0, 0, 64)
    both = features(spark, [y[:64], y], "array<double>", 5, 0, 0, 64)
    assert [len(f) for f in both] == [10, 10]


def test_features_do_not_depend_on_what_is_computed_beside_them():
    """Bit for bit the same in any slice of a bank and any batch of series."""
    rng = np.random.default_rng(0)
    whole = lambda x, bank: transform.transform_block(x, transform.dilation_groups(bank, x.shape[2], x.shape[1]))
    for n, channels, rows in ((11, 1, 5), (64, 1, 30), (150, 3, 7), (299, 2, 40)):
        x, bank = rng.normal(size=(rows, channels, n)), kernels.draw_kernels(n, np.arange(90), n, channels)
        full = whole(x, bank)
        for a, b in ((0, 1), (3, 4), (10, 40), (60, 90)):
            for own in (slice(0, rows), slice(0, 1), slice(2, 5)):
                assert (whole(x[own], bank[a:b]) == full[own, 2 * a : 2 * b]).all()


@pytest.mark.parametrize(
    ("series", "args", "message"),
    [
        ([1.0, 2.0, 3.0], (4, 0), "shorter than the longest kernel"),
        ([1.0, None] * 10, (4, 0), "NULL"),
        ([1.0] * 32, (4, 0, 0, 64), "rejected rather than padded"),
    ],
)
def test_bad_series(spark, series, args, message):
    with pytest.raises(Exception, match=message):
        features(spark, [series], "array<double>", *args)


def test_bad_parameters(spark):
    df = spark.createDataFrame([([1.0] * 20,)], "values array<double>")
    for args, message in (((0, 0), "kernels_per_group"), ((4, 0, -1), "first_kernel"), ((4, 0, 0, 5), "n_reference 5")):
        with pytest.raises(ValueError, match=message):
            transform.conv_features(df, "values", *args)
    ragged = spark.createDataFrame([([[1.0] * 16, [1.0] * 3],)], "values array<array<double>>")
    with pytest.raises(Exception, match="same length"):
        src.check_channels(ragged).collect()
    with pytest.raises(Exception, match="shorter than the longest"):
        transform.validate_series(spark.createDataFrame([([1.0] * 4,)], "values array<double>")).collect()


def test_three_forms_agree(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=30).tolist()) for i in range(4)], "id long, values array<double>")
    arrow = {(r.id, k): (r.features[2 * k], r.features[2 * k + 1]) for r in transform.conv_features(df, "values", 6, 11).collect() for k in range(6)}
    hof = transform.conv_features_hof(df, kernels.kernel_bank(spark, 11, 30, 6)).collect()
    ids = spark.range(6).withColumnRenamed("id", "kernel_id")
    joined = transform.conv_features_relational(src.explode_series(df, ["id"]), kernels.bank_long(ids, 11, 30)).collect()
    for rows in (hof, joined):
        assert len(rows) == 24
        for r in rows:
            assert (r["max"], r.ppv) == pytest.approx(arrow[(r.id, r.kernel_id)], abs=1e-9)


def test_relational_kernels_equal_the_bank(spark):
    ids = spark.range(40).withColumnRenamed("id", "kernel_id")
    want = {k[0]: k for k in kernels.draw_kernels(4, np.arange(40), 64)}
    for r in kernels.kernel_params(ids, 4, 64).collect():
        k = want[r.kernel_id]
        assert (r.length, r.dilation, r.padding) == (k[1], k[4], k[5]) and r.bias == pytest.approx(k[3], abs=1e-15)
    for r in kernels.kernel_weights(ids, 4).collect():
        assert r.weight == pytest.approx(want[r.kernel_id][2][0][r.j], abs=1e-12)


def test_normalising(spark):
    rows = [(0, [4.2] * 128), (1, [1.0, 2.0, 3.0, 6.0]), (2, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, values array<double>").withColumn("z", fs.normalize_series(F.col("values")))
    got = {r.id: r.z for r in df.collect()}
    assert max(map(abs, got[0])) < 1e-12 and got[2] == [0.0] * 5
    assert np.mean(got[1]) == pytest.approx(0) and np.std(got[1]) == pytest.approx(1)
    for _, values in rows:
        assert transform.normalized(np.array(values)).tolist() == pytest.approx(got[_], abs=1e-12)


def test_config_and_export(spark):
    kernels.EnsembleConfig().validate()
    for bad in ({"n_groups": 7}, {"n_groups": 2}, {"n_kernels": 0}, {"n_groups": 10}):
        with pytest.raises(ValueError):
            kernels.EnsembleConfig(**bad).validate()
    table = kernels.bank_table(kernels.kernel_bank(spark, 0, 20, 3)).orderBy("feature_id").collect()
    assert [(r.feature_id, r.kind) for r in table] == [(k, ("max", "ppv")[k % 2]) for k in range(6)]


def test_sql_functions(spark):
    transform.register(spark)
    x = ", ".join(f"{v}D" for v in range(1, 17))
    row = spark.sql(f"SELECT conv_features(array({x}), 4, 7, 4) AS a, conv_features(array({x}), 8, 7, 0) AS b, conv_features_mv(array(array({x})), 4, 7, 4) AS c, conv_features(array({x}), 4, 7, 4, 16) AS d").first()
    assert row.a == row.b[8:16] == row.c == row.d
    assert math.isfinite(row.a[0])


def test_features_of_computed_series_in_lambdas(spark):
    """Neither what the series come from nor what is made of the features may reach into the workers' step."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=40).tolist(), "x", {"a": 1.0}) for k in range(6)]
    df = spark.createDataFrame(rows, "id long, values array<double>, features string, more map<string,double>")
    scaled = df.withColumn("values", fs.normalize_series(F.col("values")))
    wide = transform.conv_features(scaled, "values", 10, 7)
    assert wide.columns == ["id", "values", "more", "features"]
    got = wide.groupBy().agg(F.avg(fs.array_mean(fs.maxes(F.col("features")))).alias("m"), F.avg(fs.array_mean(fs.ppvs(F.col("features")))).alias("p")).collect()[0]
    want = np.array([r.features for r in transform.conv_features(df, "values", 10, 7, normalize=True).collect()])
    assert (got.m, got.p) == pytest.approx((want[:, ::2].mean(), want[:, 1::2].mean()), abs=1e-9)
    assert transform.conv_features(df.limit(0), "values", 4).collect() == []


def golden_series():
    """8 x 128 normals of one stream, row by row."""
    one = Streams(0, np.array([0]))
    one.state = np.array([0xC0FFEE], np.uint64)  # the seed itself, not a substream of it
    return np.array([one.normal()[0] for _ in range(8 * 128)]).reshape(8, 128)


@pytest.mark.parametrize(("first", "k"), [(0, 64), (9000, 16)])
def test_golden_banks(spark, first, k):
    """The reference banks (seed 20260811, 64 kernels from 0 and 16 from 9000) over the reference input, against the plain loop."""
    x = golden_series()
    bank = kernels.draw_kernels(20260811, np.arange(first, first + k), 128)
    got = np.array(features(spark, x.tolist(), "array<double>", k, 20260811, first))
    want = np.array([[v for kernel in bank for v in naive([row.tolist()], kernel)] for row in x])
    assert np.abs(got - want).max() < 1e-12 and (got[:, 1::2] == want[:, 1::2]).all()
    if first:
        assert bank == kernels.draw_kernels(20260811, np.arange(first + k), 128)[first:]
