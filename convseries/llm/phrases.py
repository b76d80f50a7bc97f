"""Phrase collocation mining with mergeable Misra-Gries summaries.

The first pass counts the n-grams of a few megabytes of text at a time and cuts the counts by hash partition: a summary
each. The summaries of a partition are merged one after another into one with a bounded number of counters, more than
the partition's mass divided by the threshold. When it overflows, all counts are lowered by the largest that does not fit,
so that what was taken from any n-gram stays below the threshold and every frequent one survives. The survivors set bits
in a bitmap of bounded size; the second pass counts the n-grams that it lets through exactly, as text, and drops those
that are too rare. Parts of a frequent phrase are as frequent, so the same table has the counts of all parts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convseries.llm.common import GOLD, mix, per_key, prefix_sums, range_hashes, small_checkpoint, staged, text_chunks, word_numbers, word_strings

#: What ends a piece, what stands between words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(ENDS)] = 2

#: Counters of a summary; a partition of the hash range is given half as much mass as they can hold.
COUNTERS = 1_000_000
#: Bytes of text that are counted at a time; whole texts.
CHUNK = 2_000_000
#: Rows of a batch that are copied at a time.
ROWS = 500
#: Counters in a row of a summary: an Arrow batch has up to 10,000 rows, and both sides of a worker hold one.
PIECE = 128
#: Bits of the bitmap of survivors: 16 for each, 2**20 to 2**30 (128 MB). Beyond 2**26 survivors it lets more n-grams through to the second pass, which counts them all the same.
LEAST_BITS, MOST_BITS, SLICE_BITS = 20, 30, 20
#: Scores (0 to 1,000,000) that are counted together where the best of a language are looked for.
SCORE_BIN = 1000


class Words:
    """The lower-cased words of many texts: hashes, bounds and what n-grams they start. lang: a number for the language of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> None:
        buf = buf.copy()
        buf[(buf >= 65) & (buf <= 90)] += 32
        kind = _KIND[buf]
        word = np.zeros(len(buf) + 2, bool)
        word[1:-1] = kind == 0
        inner = offsets[1:-1]
        edge = np.zeros(len(buf) + 1, bool)
        edge[inner] = True
        self.start = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        self.end = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        self.buf = buf
        # words of one piece have the same number of ends and texts before them
        breaks = np.zeros(len(buf) + 1, np.int32)
        breaks[:-1] = kind == 2
        np.add.at(breaks, inner, 1)
        self.piece = np.cumsum(breaks, dtype=np.int32)[self.start] if len(self.start) else np.zeros(0, np.int32)
        self.hash = range_hashes(prefix_sums(buf), self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.lang = lang[np.searchsorted(offsets, self.start, side="right") - 1]

    def grams(self, n: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and 64-bit key of every n-gram within a piece; seeds: one for each language."""
        count = max(0, len(self.start) - n + 1)
        first = np.flatnonzero(self.piece[:count] == self.piece[n - 1 :][:count])
        key = seeds[self.lang[first]]
        for k in range(n):
            key = mix(key * GOLD + self.hash[first + k])
        return first, key

    def texts(self, first: np.ndarray, n: int):  # noqa: ANN201
        """The n-grams that start at the words `first`, their words joined by one space, as an Arrow array."""
        own = (first[:, None] + np.arange(n)).ravel()
        return word_strings(self.buf, self.start[own], self.end[own], np.full(len(first), n))


def _chunks(batches):
    """(languages, a seed for each, Words) for a few megabytes of the texts of batches (text, lang) at a time."""
    from hashlib import blake2b

    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        coded = batch.column(1).dictionary_encode()
        langs, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "big") for x in langs], np.uint64)
        for row, buf, offsets in text_chunks(batch.column(0), CHUNK):
            yield langs, seeds, Words(buf, offsets, codes[row : row + len(offsets) - 1])


class Summary:
    """A Misra-Gries summary: sorted keys with their counts. `taken` is what was taken from any key at most; it stays below the threshold: where the next step would reach it, the counters are doubled instead, which can only happen if their number is below mass / threshold."""

    def __init__(self, counters: int, threshold: int) -> None:
        self.counters, self.threshold, self.taken = counters, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Takes the counters of another summary in."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > self.counters // 2:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[new], np.add.reduceat(counts[order], new) if len(new) else counts
        self.waiting, self.n_waiting = [], 0
        while len(self.keys) > self.counters:
            largest_out = np.partition(self.counts, len(self.counts) - self.counters - 1)[len(self.counts) - self.counters - 1]
            if self.taken + largest_out >= self.threshold:
                self.counters *= 2
                continue
            self.taken += int(largest_out)
            stays = self.counts > largest_out
            self.keys, self.counts = self.keys[stays], self.counts[stays] - largest_out

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold; all that have are among them."""
        self.merge()
        return self.keys[self.counts + self.taken >= self.threshold]


def part_summaries(texts: DataFrame, parts: int, longest: int) -> DataFrame:
    """(part, keys, counts) of texts (text, lang): the n-grams of up to `longest` words of a chunk of text, cut by hash partition, PIECE at most in a row; keys are sorted unsigned longs, counts unsigned ints."""

    def count(batches):
        import pyarrow as pa

        for _, seeds, words in _chunks(batches):
            keys, counts = np.unique(np.concatenate([words.grams(n, seeds)[1] for n in range(1, longest + 1)]), return_counts=True)
            # the upper half of the key times parts, so that a partition is a range of keys
            part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            new = np.concatenate([[True], part[1:] != part[:-1]]) if len(keys) else np.zeros(0, bool)
            new[::PIECE] = True
            cut = np.flatnonzero(new)
            bounds = np.append(cut, len(keys))
            counts = counts.astype(np.uint32)  # a chunk has fewer words than that
            slices = [pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int64)), *slices], names=["part", "keys", "counts"])

    return texts.mapInArrow(count, "part long, keys binary, counts binary")


def surviving_keys(summaries: DataFrame, counters: int, threshold: int) -> DataFrame:
    """(key): the keys that the merged summaries of every partition let through. Rows of a partition are sorted together and streamed, so a task holds one summary and a batch."""

    def merge(batches):
        import pyarrow as pa

        def out(summary: Summary):
            return pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], names=["key"])

        def values(column, a: int, b: int, kind) -> np.ndarray:  # noqa: ANN001
            """Rows a to b of a binary column, which stand one after another."""
            _, ends, data = column.buffers()
            ends = np.frombuffer(ends, np.int32)[column.offset :]
            return np.frombuffer(data, np.uint8)[ends[a] : ends[b]].view(kind)

        part, summary = None, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]]) if len(parts) else []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if parts[a] != part:
                    if summary is not None:
                        yield out(summary)
                    part, summary = parts[a], Summary(counters, threshold)
                # copies, so that no batch is held for a few of its rows
                summary.add(values(batch.column(1), a, b, np.uint64).copy(), values(batch.column(2), a, b, np.uint32).astype(np.int64))
        if summary is not None:
            yield out(summary)

    return summaries.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "key long")


def bitmap(keys: DataFrame) -> tuple[int, np.ndarray]:
    """Bits and bytes of a bitmap with the bit of the top `bits` bits of every key set. It is built in slices of 128 kB by the executors; the driver joins them, 128 MB at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, keys.count())))))
    slice_bits = min(bits, SLICE_BITS)

    def fill(group):
        import pandas as pd

        slots = group["slot"].to_numpy()
        own = np.zeros(1 << slice_bits, bool)
        own[slots & ((1 << slice_bits) - 1)] = True
        return pd.DataFrame({"slice": [int(slots[0]) >> slice_bits], "bytes": [np.packbits(own).tobytes()]})

    # a slice has at most 2**SLICE_BITS distinct slots
    slots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")).distinct()
    found = np.zeros(1 << bits - 3, np.uint8)
    width = 1 << slice_bits - 3
    for row in slots.groupBy(F.shiftright("slot", slice_bits).alias("slice")).applyInPandas(fill, "slice long, bytes binary").toLocalIterator():
        found[row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.bytes, np.uint8)
    return bits, found


def exact_counts(texts: DataFrame, bits: int, bitmap_: np.ndarray, longest: int, threshold: int) -> DataFrame:
    """(lang, phrase, len, f) of all n-grams of texts (text, lang) that occur `threshold` times or more in their language, and for each language one row of len 0 and no phrase: f is the number of its words."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap_)

    def count(batches):
        import pyarrow as pa

        for langs, seeds, words in _chunks(batches):
            langs = pa.array(langs, pa.string())
            n_words = np.bincount(words.lang, minlength=len(langs))
            found = [(0, np.arange(len(langs)), pa.nulls(len(langs), pa.large_string()), n_words)]
            # words by number, so that n-grams of a chunk are told apart exactly
            number = word_numbers(words.buf, words.start, words.end)
            width = int(number.max()) + 1 if len(number) else 1
            for n in range(1, longest + 1):
                first, key = words.grams(n, seeds)
                slot = key >> np.uint64(64 - bits)
                first = first[sent.value[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
                ids = words.lang[first].astype(np.int64)
                for k in range(n):
                    _, ids = np.unique(ids * width + number[first + k], return_inverse=True)
                _, at, counts = np.unique(ids, return_index=True, return_counts=True)
                found.append((n, words.lang[first[at]], words.texts(first[at], n), counts))
            for n, lang, phrases, counts in found:
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), phrases.cast(pa.string()), pa.array(np.full(len(counts), n, np.int32)), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "len", "f"])

    rows = texts.mapInArrow(count, "lang string, phrase string, len int, f long")
    return rows.groupBy("lang", "phrase", "len").agg(F.sum("f").alias("f")).where((F.col("f") >= threshold) | (F.col("len") == 0))


def frequent_ngrams(docs: DataFrame, threshold: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang", counters: int = COUNTERS) -> DataFrame:
    """(lang, phrase, len, f), written once: every n-gram of one to `longest` words that occurs `threshold` times or more in its language (null: `und`), with its exact count, and the number of words of each language as a row of len 0. Null texts are empty."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    # an upper bound of the number of words: words are parted by one byte at least
    mass = longest * (texts.agg(F.sum((F.octet_length("text") + 1) / 2).cast("long")).first()[0] or 0)
    parts = max(1, math.ceil(2 * mass / (counters * threshold)))
    survivors = staged(surviving_keys(part_summaries(texts, parts, longest), counters, threshold), "survivors")
    bits, found = bitmap(survivors)
    return staged(exact_counts(texts, bits, found, longest, threshold), "ngrams")


def _cut_scores(grams: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, len, a, l, r, score): every candidate with its lowest-scoring cut."""
    words = F.split("phrase", " ", -1)
    cuts = grams.where("len > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.select("lang", "phrase", "len", F.col("f").alias("a"), "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("len") - F.col("k")), " ").alias("rest"))
    counts = grams.where(F.col("len").between(1, longest - 1))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")).hint("shuffle_merge"), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")).hint("shuffle_merge"), ["lang", "rest"])
    wide = "cast({} as decimal(19,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {wide.format('a')} * {wide.format('a')}) div ({wide.format('l')} * {wide.format('r')})")
    return cuts.withColumn("score", score).groupBy("lang", "phrase", "len", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "len", "a", "x.l", "x.r", "x.score")


def _covered(grams: DataFrame, longest: int, percent: int) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer candidate that has the phrase inside."""
    words = F.split("phrase", " ", -1)
    found = grams.where("len > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("len") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("m") + 1)))
    return found.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("m")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, top: int = 2000, threshold: int = 10, longest: int = 3, inside_percent: int = 50, text_col: str = "text", lang_col: str = "lang", counters: int = COUNTERS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two to `longest` words of each language by score.

    A-Z are lower-cased; pieces end at `.,;:!?`, line feeds and the like; words are what blanks and tabs leave. A phrase
    is a candidate if it occurs `threshold` times or more. Its score is floor(1000000 a^2 / (l r)) at the cut into two
    parts (l and r their counts) where that is lowest, the first of equal ones. Candidates inside a longer one with
    `inside_percent` of their count or more are dropped. Order: score and count falling, then phrase by UTF-8 bytes. A null
    language is `und`, null texts are empty; repeated rows count as often as they stand; other columns are not read. An
    empty table, and languages without a candidate, give no rows. Products are decimals of 38 digits, enough for counts up
    to 3e15; larger ones are an error.
    """
    grams = frequent_ngrams(docs, threshold, longest, text_col, lang_col, counters)
    scored, covered = _cut_scores(grams, longest), _covered(grams, longest, inside_percent)
    free = scored.join(covered.hint("shuffle_merge"), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside_percent * F.col("a"))).drop("most", "len")
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each of some parts of a language, of these the score bins that hold the first `top`, and then their order
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = free.withColumns({"salt": F.pmod(F.hash("phrase"), F.lit(salts)), "bin": F.floor(F.col("score") / SCORE_BIN)})
    best = staged(salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank"), "best")
    bins = best.groupBy("lang", "bin").agg(F.count("*").alias("rows"))  # at most 1,000,000 / SCORE_BIN + 1 a language
    upto = F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("bin")))
    least = small_checkpoint(bins.withColumn("upto", upto).groupBy("lang").agg(F.max(F.when(F.col("upto") >= top, F.col("bin"))).alias("least")))
    best = per_key(best, least, "lang", F.hash("phrase")).where(F.col("bin") >= F.coalesce("least", F.lit(0))).drop("bin", "least")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    sizes = small_checkpoint(grams.where("len = 0").select("lang", F.col("f").alias("n")))
    return per_key(best, sizes, "lang", F.hash("phrase")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
