"""Deterministic columns against published vectors and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from convseries.functions import prng

# Published outputs of SplitMix64 seeded with 0.
FIRST = [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F, 0xF88BB8A8724C81EC, 0x1B39896A51A8749B]


def mix(z):
    z &= prng.LOW64
    z = (z ^ (z >> 30)) * prng.MIX_A & prng.LOW64
    z = (z ^ (z >> 27)) * prng.MIX_B & prng.LOW64
    return z ^ (z >> 31)


def test_published_vectors_in_numpy_and_columns(spark):
    states = np.array([(k + 1) * prng.GOLDEN_GAMMA & prng.LOW64 for k in range(5)], np.uint64)
    assert prng.mix(states).tolist() == FIRST
    rows = spark.range(5).select(prng.draw(prng.u64_literal(0), F.col("id") + 1).alias("z")).collect()
    assert [(r.z.hi << 32) | r.z.lo for r in rows] == FIRST


def test_substreams_and_uniforms_agree_with_python(spark):
    got = spark.range(50).select("id", prng.substream_seed(-3, F.col("id")).alias("s"), prng.stable_uniform(-3, F.col("id"), 2).alias("u")).collect()
    for r in got:
        seed = mix(-3 + (r.id + 1) * prng.GOLDEN_GAMMA)
        assert (r.s.hi << 32) | r.s.lo == seed
        assert r.u == (mix(seed + 2 * prng.GOLDEN_GAMMA) >> 11) * 2.0**-53


def test_negative_stream_is_an_error(spark):
    with pytest.raises(Exception, match="non-negative"):
        spark.range(1).select(prng.stable_uniform(0, F.lit(-1).cast("long"))).collect()


def test_wrapping_arithmetic(spark):
    row = spark.range(1).select(prng.u64_mul(prng.u64_literal(-1), prng.MIX_A).alias("m"), prng.u64_add(prng.u64_literal(-1), prng.u64_literal(2)).alias("a"), prng.u64_from(F.lit(-1)).alias("n")).first()
    assert (row.m.hi << 32) | row.m.lo == (2**64 - 1) * prng.MIX_A % 2**64
    assert (row.a.hi, row.a.lo) == (0, 1)
    assert (row.n.hi, row.n.lo) == (prng.LOW32, prng.LOW32)


def test_independent_of_partitioning(spark):
    one = spark.range(100).repartition(1).select("id", prng.stable_uniform(1, F.col("id")).alias("u")).toPandas().set_index("id").u
    many = spark.range(100).repartition(7).select("id", prng.stable_uniform(1, F.col("id")).alias("u")).toPandas().set_index("id").u
    assert one.sort_index().equals(many.sort_index()) and one.between(0, 1, inclusive="left").all()


def test_stable_below_bounds(spark):
    ks = {r.k for r in spark.range(400).select(prng.stable_below(5, F.col("id"), 3).alias("k")).collect()}
    assert ks == {0, 1, 2}
    with pytest.raises(ValueError):
        prng.stable_below(5, F.col("id"), 0)


def test_normals_drop_the_spare_and_count_rejected_pairs(spark):
    state = mix(9 + 1 * prng.GOLDEN_GAMMA)

    def uniform():
        nonlocal state
        state = (state + prng.GOLDEN_GAMMA) & prng.LOW64
        return (mix(state) >> 11) * 2.0**-53

    want = []
    while len(want) < 6:
        u, v = 2 * uniform() - 1, 2 * uniform() - 1
        s = u * u + v * v
        if 0 < s < 1:
            want.append(u * math.sqrt(-2 * math.log(s) / s))
    numpy = prng.Streams(9, np.array([0]))
    assert [float(numpy.normal()[0]) for _ in range(6)] == pytest.approx(want, abs=1e-15)
    pairs = prng.candidate_pairs(spark.range(1), 9, "id", 40)
    rows = prng.accepted_normals(pairs, ["id"], 6).orderBy("k").collect()
    assert [r.normal for r in rows] == pytest.approx(want, abs=1e-12)
    with pytest.raises(Exception, match="too few"):
        prng.assert_enough(prng.accepted_normals(prng.candidate_pairs(spark.range(1), 9, "id", 6), ["id"], 6), ["id"], 6).collect()


def test_pairs_are_drawn_in_every_task_and_normals_without_a_window(spark):
    streams = spark.range(50).coalesce(1).withColumn("own", F.concat(F.lit("s"), F.col("id").cast("string")))
    pairs = prng.candidate_pairs(streams, 9, "id", 40, 2)
    assert pairs.rdd.getNumPartitions() == 4 and pairs.columns == ["id", "own", "p", "step", "u", "v", "s"]  # one file of streams, four tasks
    stream = prng.substream_seed(9, F.col("id"))
    u = 2 * prng.to_uniform(prng.draw(stream, F.col("step"))) - 1
    v = 2 * prng.to_uniform(prng.draw(stream, F.col("step") + 1)) - 1
    assert pairs.count() == 2000 and pairs.where((F.col("u") != u) | (F.col("v") != v) | (F.col("s") != u * u + v * v) | (F.col("step") != 2 + 2 * F.col("p")) | (F.col("own") != F.concat(F.lit("s"), F.col("id").cast("string")))).count() == 0
    normals = prng.stable_normals(streams, 9, "id", 3 + F.col("id") % 3, 40, 2)
    assert "Window" not in normals._jdf.queryExecution().executedPlan().toString()
    want = prng.accepted_normals(pairs, ["id"], 3 + F.col("id") % 3)
    key = lambda df: sorted((r.id, r.own, r.step, r.k, r.normal) for r in df.collect())
    assert key(normals) == key(want)
    with pytest.raises(Exception, match="too few"):
        prng.stable_normals(spark.range(1), 9, "id", 6, 6, enough=True).collect()
    with pytest.raises(Exception, match="non-negative"):
        prng.candidate_pairs(spark.range(-1, 1), 9, "id", 6).collect()
