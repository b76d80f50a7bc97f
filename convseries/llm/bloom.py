"""Bloom filters as rows of 64-bit words, built and read with SQL expressions only.

The bits of a filter are one array of words, cut into rows of at most PART_WORDS words, which the readers take as scalar
subqueries. A filter has at most MOST_PARTS rows, whatever its keys: with more of them it has fewer bits a key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convseries.llm.common import small_checkpoint

#: 64-bit words of one row (8 MB), and most rows of a filter (256 MB in all).
PART_WORDS, MOST_PARTS = 1 << 20, 32


def _positions(key: Column, seed: int, n_bits: int, n_hashes: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(n_bits))
    step = F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(n_bits))
    return [F.pmod(first + step * F.lit(i), F.lit(n_bits)) for i in range(n_hashes)]


@dataclass
class BloomFilter:
    """A filter: its seed, size, hashes, and one-row DataFrames with the words of each part."""

    seed: int
    n_bits: int
    n_hashes: int
    part_words: int
    parts: list[DataFrame]

    def holds(self, key: Column) -> Column:
        """Whether the filter lets the key through."""
        words = [p.scalar() for p in self.parts]
        found = F.lit(True)
        for p in _positions(key, self.seed, self.n_bits, self.n_hashes):
            word = F.shiftright(p, 6)
            part, at = F.floor(word / self.part_words), (word % self.part_words).cast("int")
            own = F.get(words[0], at)
            for k in range(1, len(words)):
                own = F.when(part == k, F.get(words[k], at)).otherwise(own)
            found = found & (F.getbit(own, (p % 64).cast("int")) == 1)
        return found


def most_bits(part_words: int = PART_WORDS, most_parts: int = MOST_PARTS) -> int:
    """Bits of the largest filter."""
    return 64 * part_words * most_parts


def bloom_filter(keys: DataFrame, n_keys: int, seed: int, bits_per_key: int = 10, part_words: int = PART_WORDS, most_parts: int = MOST_PARTS) -> BloomFilter:
    """A filter of the column `key`, which has n_keys values. Bits are set by bit_or over words, combined on the map side."""
    n_words = min(part_words * most_parts, max(1, math.ceil(n_keys * bits_per_key / 64)))
    n_bits = 64 * n_words
    n_hashes = max(1, round(min(bits_per_key, n_bits / max(1, n_keys)) * math.log(2)))
    position = F.explode(F.array(*_positions(F.col("key"), seed, n_bits, n_hashes)))
    set_bits = keys.select(position.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p % 64 AS INT))").alias("bits"))
    empty = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    part = F.floor(F.col("word") / part_words).alias("part")
    rows = small_checkpoint(words.groupBy(part).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")))
    return BloomFilter(seed, n_bits, n_hashes, part_words, [rows.where(F.col("part") == k).select("words") for k in range(-(-n_words // part_words))])
