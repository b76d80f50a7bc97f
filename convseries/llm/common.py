"""What the corpus operators share: staged tables in the shared folder and byte-level array helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word contracts: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
#: A word: a longest run of characters other than WHITE (Java and DuckDB syntax).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a temporary one; a cluster must name it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="convseries-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):  # noqa: ANN201
    """Removes the folders that are made inside when it is left, but for those that are taken from the list it gives. What is computed from them must be written by then."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.pop()
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; not created."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later readers see one fixed result, and a lost executor costs no more than a reread."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_checkpoint(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder, for tables that loops reread."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most rows of a table of one row per key that is broadcast; larger ones meet salted rows instead.
BROADCAST_ROWS, SALTS = 50_000, 32


def per_key(rows: DataFrame, table: DataFrame, key: str, salt: F.Column, how: str = "inner") -> DataFrame:
    """rows with the columns of a table that has one row per key (nulls are equal): broadcast if the table is small, else by keys and salts, so that a frequent key does not meet in one task. salt is a column of rows; how is inner or left."""
    same = F.col(f"_l.{key}").eqNullSafe(F.col(f"_r.{key}"))
    more = [F.col(f"_r.`{c}`") for c in table.columns if c != key]
    if table.count() <= BROADCAST_ROWS:
        return rows.alias("_l").join(F.broadcast(table.alias("_r")), same, how).select("_l.*", *more)
    left = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.alias("_l").join(right.alias("_r"), same & (F.col("_l._salt") == F.col("_r._salt")), how).select("_l.*", *more).drop("_salt")


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, salt: F.Column, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with a written table of one row per key, in which n counts the key's rows: rows of the most frequent keys are dealt to SALTS by `salt`.

    Frequent are keys with more than 1,000 rows and more than the BROADCAST_ROWS-th part of all, so there are at most
    BROADCAST_ROWS of them, which are broadcast to the rows.
    """
    most = max(1000, (table.agg(F.sum(n)).first()[0] or 0) // BROADCAST_ROWS)
    often = F.col(n) > most
    hot = table.where(often).select(*keys, F.lit(True).alias("_hot"))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(salt, F.lit(SALTS))).otherwise(0)).drop("_hot")
    right = table.withColumn("_salt", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("shuffle_merge"), [*keys, "_salt"], how).drop("_salt")


def word_count(col) -> F.Column:
    """Words in a text column as long; null counts as none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


# -- arrays over the bytes of many texts ------------------------------------------------------------------------------

GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


#: A 64-bit value for each byte, from the finaliser.
BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD)
#: Two odd bases, and what a byte stands for in the sums of each.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BYTES = (BYTE_VALUES, mix(BYTE_VALUES + GOLD))


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < at least n."""
    return _powers(1 << max(20, int(n).bit_length()), BASES[which])


def prefix_sums(buf: np.ndarray, which: int = 0) -> np.ndarray:
    """s with s[j] - s[i] = sum of value(buf[t]) * base**t for i <= t < j, modulo 2**64."""
    up, _ = powers(len(buf) + 1, which)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTES[which][buf] * up[: len(buf)], dtype=np.uint64, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Mixed hashes of the ranges [start, end): equal for equal contents, wherever they stand. For ranges of up to a few hundred bytes: longer ones can be made to collide on purpose, in both sums."""
    _, down = powers(len(sums), which)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * GOLD)


def lowered(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[buf]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[9, 10, 11, 12, 13, 32]] = True


def text_chunks(column, chunk_bytes: int = 2_000_000):
    """Slices of an Arrow string column as (first row, bytes, offsets): whole texts, about chunk_bytes at a time; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + chunk_bytes, side="right")) - 1)
        last = min(last, n)
        yield row, raw[off[row] : off[last]], (off[row : last + 1] - off[row])
        row = last


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words never cross texts."""
    word = np.zeros(len(buf) + 2, bool)
    word[1:-1] = ~IS_WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets[:-1]] = True
    start = word[1:] & (~word[:-1] | edge)
    ends = np.zeros(len(buf) + 1, bool)
    ends[offsets[1:]] = True
    end = word[:-1] & (~word[1:] | ends)
    return np.flatnonzero(start), np.flatnonzero(end)


def word_strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: np.ndarray):  # noqa: ANN201
    """Arrow strings of sizes[i] words each, taken in turn from the words buf[start:end] and joined by one space."""
    import pyarrow as pa

    own = end - start
    step = own + 1
    upto = np.cumsum(sizes)
    step[upto[sizes > 0] - 1] -= 1
    after = np.cumsum(step)
    to = after - step
    out = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    at = np.repeat(to - np.cumsum(own) + own, own) + np.arange(own.sum())
    out[at] = buf[at + np.repeat(start - to, own)]
    offsets = np.zeros(len(sizes) + 1, np.int64)
    offsets[1:] = np.concatenate([[0], after])[upto]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(out))


def word_numbers(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same number, from 0, for equal words buf[start:end]."""
    words = word_strings(buf, start, end, np.ones(len(start), np.int64))
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
