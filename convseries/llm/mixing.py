"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash of 36 bits of its id. The words of each source are summed by source and hash bucket
(12 bits), the bucket in which a source's budget ends is refined by the next 12 bits, and that one again: three small
histograms replace a sort. A document is taken when its hash lies below its source's threshold, so larger budgets
take supersets. A target above the source's size takes every document once and a thresholded part of it a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convseries.llm.common import per_key, small_checkpoint, staged, word_count

#: Bits of the hash that one histogram resolves, and the number of histograms.
BUCKET_BITS, LEVELS = 12, 3


def hash36(col: Column) -> Column:
    """36 bits of the MD5 of a value as text: stable across engines and runs."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size) plus weight and target.

    Weights repeat over the sources by code point, null last. The targets share share_percent of all sizes by weight;
    a target stops at `most` times its source's size and the excess goes to the others by weight, until none is above.
    That is one water level: with r = most * size / weight ascending, the sources that stop are those whose r is at
    most the level left for the rest. The windows run over one row per source in one task (about 100 bytes each, so
    ten million sources take a gigabyte).
    """
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    at = F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights)))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), at).cast("long")
    rows = sources.withColumn("weight", weight)
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"full": F.sum("source_size").over(up), "w_upto": F.sum("weight").over(up), "all_size": F.sum("source_size").over(every), "all_w": F.sum("weight").over(every)})
    # this source stops if, with all before it stopped, its share of what is left is at least its limit
    left = F.lit(share_percent) * F.col("all_size") - F.lit(100 * most) * (F.col("full") - F.col("source_size"))
    w_left = F.col("all_w") - (F.col("w_upto") - F.col("weight"))
    rows = rows.withColumn("stops", F.col("weight") * left >= F.lit(100 * most) * F.col("source_size") * w_left)
    kept = F.lit(share_percent) * F.col("all_size") - F.lit(100 * most) * F.coalesce(F.sum(F.when(F.col("stops"), F.col("source_size"))).over(every), F.lit(0))
    w_kept = F.coalesce(F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every), F.lit(0))
    share = (F.col("weight") * kept).cast("double") / F.when(w_kept > 0, F.lit(100) * w_kept).cast("double")
    target = F.when(F.col("stops"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(share)
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("h", BUCKET_BITS * (LEVELS - level))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, limit) for documents (source, h, size) and budgets (source, budget): documents with h < limit are taken.

    A level sums sizes by source and bucket and keeps the one bucket in which the budget ends. At the last level the
    bucket itself is taken if its middle is within the budget. Where the budget is not reached, all are taken.
    """
    open_at = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.col("budget"))
    done = None
    for level in range(1, LEVELS + 1):
        last = level == LEVELS
        inside = per_key(sized, open_at, "source", F.col("h")).where(_bucket(level - 1) == F.col("prefix"))
        sums = inside.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("budget").alias("budget"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(w))
        below = F.col("upto") + F.col("upto") - F.col("words") > 2 * F.col("budget") if last else F.col("upto") > F.col("budget")
        first = sums.where(below).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "budget"), "bucket").alias("x"))
        ends = small_checkpoint(first.select("source", F.col("x.bucket").alias("prefix"), F.col("x.before").alias("before"), F.col("x.budget").alias("budget")))
        # where no bucket ends the budget, the rest of the open bucket is taken whole
        past = open_at.alias("o").join(ends.alias("e"), F.col("o.source").eqNullSafe(F.col("e.source")), "left_anti")
        past = past.select("source", F.shiftleft(F.col("prefix") + 1, BUCKET_BITS * (LEVELS - level + 1)).alias("limit"))
        done = past if done is None else done.unionByName(past)
        open_at = ends
    return small_checkpoint(done.unionByName(open_at.select("source", F.col("prefix").alias("limit"))))


def mix_table(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_percent: int = 150, most: int = 2) -> DataFrame:
    """One row per source for documents (source, h, size): source_size, target, whole (times that all its documents are taken) and limit (documents with a lower hash are taken once more)."""
    totals = small_checkpoint(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = small_checkpoint(source_targets(totals, weights, share_percent, most).withColumn("whole", F.when(F.col("target") >= F.col("source_size"), F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")))
    limits = thresholds(sized, targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    table = targets.alias("t").join(limits.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select("t.source", "source_size", "target", "whole", F.coalesce("limit", F.lit(0)).alias("limit"))
    return small_checkpoint(table)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), hash36(F.col(id_col)).alias("h"))
    return staged(sized, "sizes")


def _copies(most: int) -> Column:
    return F.least(F.lit(most).cast("long"), F.col("whole") + (F.col("h") < F.col("limit")).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share_percent: int = 150, most: int = 2) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted), copies.

    Null texts have size 0; a null source is a source of its own, the last. Rows that repeat an id in a source share its
    fate. An empty table gives an empty result.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    out = per_key(sized, mix_table(sized, weights, share_percent, most), "source", F.col("h"))
    copies = _copies(most)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share_percent: int = 150, most: int = 2) -> DataFrame:
    """The documents as the mix takes them, with all their columns: those that are taken twice are repeated, others dropped. A document's source and hash decide, so no text is shuffled. Wordless texts stay if their hash is taken."""
    table = mix_table(_sized(docs, id_col, text_col, source_col), weights, share_percent, most)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = per_key(docs.select(row, F.col(source_col).cast("string").alias("source"), hash36(F.col(id_col)).alias("h")), table, "source", F.col("h"))
    taken = rows.withColumn("copies", _copies(most)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
