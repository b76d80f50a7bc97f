"""Deterministic random columns: SplitMix64 as Column expressions, and its NumPy twin.

Draws depend on (seed, stream, step) only, never on partitions or row order. An unsigned 64-bit value is a struct of
two 32-bit halves, because bigint products overflow under ANSI arithmetic.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of SplitMix64.
GOLDEN_GAMMA = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB

LOW32, LOW16, LOW64 = 0xFFFFFFFF, 0xFFFF, 0xFFFFFFFFFFFFFFFF


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def u64(hi: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"))


def u64_literal(value: int) -> Column:
    """Any integer, modulo 2**64."""
    value &= LOW64
    return u64(F.lit(value >> 32).cast("long"), F.lit(value & LOW32).cast("long"))


def u64_from(col: Column) -> Column:
    """A bigint, modulo 2**64: negative values wrap."""
    col = col.cast("long")
    return u64(F.shiftrightunsigned(col, 32), col.bitwiseAND(F.lit(LOW32)))


def u64_xor(a: Column, b: Column) -> Column:
    return u64(a["hi"].bitwiseXOR(b["hi"]), a["lo"].bitwiseXOR(b["lo"]))


def u64_shr(a: Column, n: int) -> Column:
    """Logical shift to the right by 0 < n < 32."""
    carried = F.shiftleft(a["hi"].bitwiseAND(F.lit((1 << n) - 1)), 32 - n)
    return u64(F.shiftright(a["hi"], n), F.shiftright(a["lo"], n).bitwiseOR(carried))


def u64_add(a: Column, b: Column) -> Column:
    return let(a["lo"] + b["lo"], lambda low: u64((a["hi"] + b["hi"] + F.shiftright(low, 32)).bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))))


def u64_mul(a: Column, factor: int) -> Column:
    """Times a constant, modulo 2**64. Partial products take 16 bits of the constant, so that none passes 2**48."""
    limbs = [(factor >> s) & LOW16 for s in (0, 16, 32, 48)]
    x, y = a["lo"], a["hi"]
    low = F.struct((x * limbs[0]).alias("p0"), (x * limbs[1]).alias("p1"))

    def finish(p):
        t = p["p0"] + F.shiftleft(p["p1"].bitwiseAND(F.lit(LOW16)), 16)
        cross = x * limbs[2] + F.shiftleft((x * limbs[3]).bitwiseAND(F.lit(LOW16)), 16) + y * limbs[0] + F.shiftleft((y * limbs[1]).bitwiseAND(F.lit(LOW16)), 16)
        return u64((F.shiftright(t, 32) + F.shiftright(p["p1"], 16) + cross).bitwiseAND(F.lit(LOW32)), t.bitwiseAND(F.lit(LOW32)))

    return let(low, finish)


def splitmix64(z: Column) -> Column:
    """The mixing function on a struct (hi, lo)."""
    first = let(z, lambda v: u64_xor(v, u64_shr(v, 30)))
    first = let(first, lambda v: u64_mul(v, MIX_A))
    second = let(first, lambda v: u64_xor(v, u64_shr(v, 27)))
    second = let(second, lambda v: u64_mul(v, MIX_B))
    return let(second, lambda v: u64_xor(v, u64_shr(v, 31)))


def _times_gamma(n: Column) -> Column:
    return let(u64_from(n), lambda v: u64_mul(v, GOLDEN_GAMMA))


def substream_seed(seed: int, index: Column) -> Column:
    """Seed of stream `index`: mix(seed + (index + 1) * gamma). Negative indices are an error."""
    checked = F.when(index >= 0, index).otherwise(F.raise_error(F.lit("stream index must be non-negative")).cast("long"))
    return splitmix64(let(_times_gamma(checked + 1), lambda v: u64_add(v, u64_literal(seed))))


def draw(stream: Column, step: Column) -> Column:
    """The step-th value, from 1, of a stream given by its seed (hi, lo)."""
    return splitmix64(let(_times_gamma(step), lambda v: u64_add(v, stream)))


def to_uniform(value: Column) -> Column:
    """The top 53 bits as a double in [0, 1)."""
    return let(value, lambda v: (v["hi"] * 2097152 + F.shiftright(v["lo"], 11)).cast("double") / F.lit(float(1 << 53)))


def stable_uniform(seed: int, index: Column, step: Column | int = 1) -> Column:
    """Uniform on [0, 1): draw `step` of stream `index`."""
    step = F.lit(step).cast("long") if isinstance(step, int) else step
    return to_uniform(let(substream_seed(seed, index), lambda s: draw(s, step)))


def stable_uniform_range(seed: int, index: Column, lo: float, hi: float, step: Column | int = 1) -> Column:
    """Uniform on [lo, hi)."""
    return F.lit(lo) + F.lit(hi - lo) * stable_uniform(seed, index, step)


def stable_below(seed: int, index: Column, n: int, step: Column | int = 1) -> Column:
    """An integer in [0, n), by multiplying and rounding down."""
    if n <= 0:
        raise ValueError("n must be positive")
    return F.floor(stable_uniform(seed, index, step) * n).cast("long")


# -- normals as a relation ---------------------------------------------------------------------------------------------


#: Pairs that are drawn at a time.
DRAWN = 1 << 16


def _pairs_of(streams: DataFrame, seed: int, index_col: str, pairs: int, first_step: int, fields: str, rows) -> DataFrame:  # noqa: ANN001
    """streams plus `fields`: rows(u, v, s, batch), from matrices with a row for each stream of an Arrow batch, gives the stream of each new row and its columns. Streams are few beside their pairs, so they are dealt out first."""
    at, names = streams.columns.index(index_col), [c.split()[0] for c in fields.split(", ")]

    def drawn(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        steps = np.uint64(first_step) + np.arange(2 * pairs, dtype=np.uint64)
        step = max(1, DRAWN // pairs)
        for whole in batches:
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                index = batch.column(at)
                if index.null_count:
                    raise ValueError("stream index must be non-negative")
                state = Streams(seed, index.cast(pa.int64()).to_numpy(zero_copy_only=False)).state
                with np.errstate(over="ignore"):
                    draws = 2 * ((mix(state[:, None] + steps * np.uint64(GOLDEN_GAMMA)) >> np.uint64(11)).astype(np.float64) * 2.0**-53) - 1
                u, v = draws[:, 0::2], draws[:, 1::2]
                own, columns = rows(u, v, u * u + v * v, batch)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(own)).columns, *map(pa.array, columns)], names=[*batch.schema.names, *names])

    spark = streams.sparkSession
    dealt = streams.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(f"`{index_col}`"))
    return dealt.mapInArrow(drawn, T.StructType([*streams.schema.fields, *T.StructType.fromDDL(fields).fields]))


def candidate_pairs(streams: DataFrame, seed: int, index_col: str, pairs: int = 80, first_step: int = 1) -> DataFrame:
    """The first candidate pairs of the polar method for each stream: streams plus p, step, u, v, s. Pair p (from 0) takes draws first_step + 2p and the next."""

    def rows(u, v, s, batch):  # noqa: ANN001, ANN202
        p = np.tile(np.arange(pairs, dtype=np.int64), len(u))
        return np.repeat(np.arange(len(u)), pairs), [p, first_step + 2 * p, u.ravel(), v.ravel(), s.ravel()]

    return _pairs_of(streams, seed, index_col, pairs, first_step, "p long, step long, u double, v double, s double", rows)


def stable_normals(streams: DataFrame, seed: int, index_col: str, count: Column | int, pairs: int = 80, first_step: int = 1, enough: bool = False) -> DataFrame:
    """accepted_normals(candidate_pairs(...)) for streams with an index of their own, without a shuffle of pairs: streams plus step, k, normal. A stream with fewer than count has fewer rows, or fails with `enough`."""
    count = F.lit(count) if isinstance(count, int) else count

    def rows(u, v, s, batch):  # noqa: ANN001, ANN202
        ok = (s > 0) & (s < 1)
        k = np.cumsum(ok, axis=1, dtype=np.int32)
        wanted = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        if enough and (k[:, -1] < wanted).any():
            raise ValueError("too few accepted pairs")
        own, p = np.nonzero(ok & (k <= wanted[:, None]))
        return own, [first_step + 2 * p, k[own, p], u[own, p], s[own, p]]

    found = _pairs_of(streams.withColumn("_count", count.cast("int")), seed, index_col, pairs, first_step, "step long, k int, u double, s double", rows)
    return found.withColumn("normal", F.col("u") * F.sqrt(F.lit(-2.0) * F.log("s") / F.col("s"))).drop("_count", "u", "s")


def accepted_normals(pairs: DataFrame, by: list[str], count: Column | int) -> DataFrame:
    """The first `count` accepted pairs of each stream as (by, k from 1, step, normal). The second normal of a pair is not used. A stream that falls short has fewer rows: see `assert_enough`."""
    count = F.lit(count) if isinstance(count, int) else count
    ok = pairs.where((F.col("s") > 0) & (F.col("s") < 1))
    ranked = ok.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("p"))).where(F.col("k") <= count)
    return ranked.withColumn("normal", F.col("u") * F.sqrt(F.lit(-2.0) * F.log("s") / F.col("s"))).drop("u", "v", "s", "p")


def assert_enough(normals: DataFrame, by: list[str], count: int) -> DataFrame:
    """normals, failing at run time for a stream with fewer than count rows."""
    n = F.count("*").over(Window.partitionBy(*by))
    return normals.withColumn("k", F.when(n >= count, F.col("k")).otherwise(F.raise_error(F.lit("too few accepted pairs")).cast("int")))


# -- the NumPy twin ----------------------------------------------------------------------------------------------------


class Streams:
    """SplitMix64 streams `indices` of one seed, drawn in step: every call gives an array with a value for each stream."""

    def __init__(self, seed: int, indices: np.ndarray):
        indices = np.asarray(indices, np.int64)
        if (indices < 0).any():
            raise ValueError("stream index must be non-negative")
        with np.errstate(over="ignore"):
            self.state = mix(np.uint64(seed & LOW64) + (indices.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN_GAMMA))

    def uniform(self, where: np.ndarray | None = None) -> np.ndarray:
        """One uniform for each stream; with `where` only those streams move on (others give 0)."""
        if where is None:
            self.state = self.state + np.uint64(GOLDEN_GAMMA)
            return (mix(self.state) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        out = np.zeros(len(self.state))
        self.state[where] += np.uint64(GOLDEN_GAMMA)
        out[where] = (mix(self.state[where]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return out

    def normal(self, where: np.ndarray | None = None) -> np.ndarray:
        """One normal for each (chosen) stream by the polar method; a rejected pair takes two draws, the second normal is dropped."""
        todo = np.ones(len(self.state), bool) if where is None else where.copy()
        out = np.zeros(len(self.state))
        while todo.any():
            u, v = 2 * self.uniform(todo) - 1, 2 * self.uniform(todo) - 1
            s = u * u + v * v
            good = todo & (s > 0) & (s < 1)
            out[good] = [a * math.sqrt(-2.0 * math.log(b) / b) for a, b in zip(u[good], s[good])]
            todo &= ~good
        return out


def mix(z: np.ndarray) -> np.ndarray:
    """The mixing function on uint64 arrays."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))
