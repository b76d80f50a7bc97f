"""Exact deduplication by a log-structured merge index of text digests.

Every document gives one index entry: the digest of its normalised text, its rank (code points, then id) and its id.
Memtables are slices of the entries by a hash of the id, as many as their row bound asks for; each is combined on the
map side and flushed as a run sorted by digest. Compaction merges FAN_IN runs of a level at a time, keeping for each
digest the entry that stays and the number of entries, until one run is left. Only that run is looked up, so it is the
one with a filter: a Bloom filter of the digests that it holds more than once. Documents that the filter stops are their
own groups; neither their entries nor their texts move. The others look up the run, and hits are compared byte for byte
with the text that stays; rows that differ, though their digests are equal, are grouped by their whole text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convseries.llm.bloom import bloom_filter
from convseries.llm.common import WHITE, salted_join, staged

#: Entries of a memtable (about 20 MB), and runs that are merged at a time.
MEMTABLE_ROWS, FAN_IN = 100_000, 16


def normalised(text: Column) -> Column:
    """The text without white space."""
    out = text
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _flush(entries: DataFrame, run: Column, name: str) -> DataFrame:
    """Runs sorted by digest: for each digest of a run the smallest rank and the number of rows. Digests of many rows are combined before they are shuffled."""
    runs = entries.withColumn("run", run).groupBy("run", "digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return staged(runs.repartition("run", "digest").sortWithinPartitions("run", "digest"), name)


def build_index(entries: DataFrame, rows: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """The last run of the index over `rows` entries (digest, first): one row per digest as (digest, first, n)."""
    runs = max(1, -(-rows // memtable_rows))
    slots = F.pmod(F.xxhash64(F.col("first")["id"]), F.lit(runs)).cast("int")
    level = _flush(entries.withColumn("n", F.lit(1).cast("long")), slots, "run-0")
    depth = 1
    while runs > 1:
        level, runs = _flush(level, F.floor(F.col("run") / FAN_IN).cast("int"), f"run-{depth}"), -(-runs // FAN_IN)
        depth += 1
    return level.select("digest", "first", "n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; null is the empty text. Of equal texts the row with the most
    code points stays, then the smallest id (null ids last). Repeated rows with one id form one group with it and are all
    marked kept when that id stays. Only digest_hex hexadecimal digits of SHA-256 enter the index (tests shorten it to
    force collisions); whatever the digests, texts decide. Other columns do not matter; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rank = F.struct((-F.length("text")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    plain = base.select(rank.alias("first"), normalised(F.col("text")).alias("norm"))
    hashed = plain.select("first", "norm", F.sha2("norm", 256).alias("sha"))
    entries = staged(hashed.withColumn("digest", F.substring("sha", 1, digest_hex)), "entries")
    index = build_index(entries.select("digest", "first"), entries.count(), memtable_rows)
    hits = staged(index.where("n > 1").select("digest", F.col("first").alias("keep"), "n"), "hits")
    may_hit = bloom_filter(hits.select(F.col("digest").alias("key")), hits.count(), 1).holds(F.col("digest"))

    # byte verification of the hits: the text that stays against each other text of its digest
    own_salt = F.xxhash64("first")
    texts = staged(salted_join(entries.where(may_hit).select("digest", "first", "norm"), hits, ["digest"], "n", own_salt), "hit-texts")
    stays = F.col("first").eqNullSafe(F.col("keep"))
    kept_texts = staged(texts.where(stays).groupBy("digest").agg(F.min("norm").alias("kept_norm"), F.first("n").alias("n")), "kept-texts")
    others = texts.where(~stays).select("digest", "first", "norm")
    wrong = staged(salted_join(others, kept_texts, ["digest"], "n", own_salt).where("norm != kept_norm").select("digest", "first", "norm"), "collisions")

    alone = entries.where(~may_hit).select("first", "sha", F.col("first").alias("keep"), F.lit(1).cast("long").alias("n"))
    found = salted_join(entries.where(may_hit).select("digest", "first", "sha"), hits, ["digest"], "n", own_salt, "left")
    if not wrong.isEmpty():
        own = wrong.groupBy("digest", "norm").agg(F.min("first").alias("own_keep"), F.count("*").alias("own_n"))
        rows = wrong.join(own, ["digest", "norm"]).select("digest", "first", "own_keep", "own_n").distinct()
        lost = wrong.groupBy("digest").agg(F.count("*").alias("lost"))
        found = found.join(rows, ["digest", "first"], "left").join(lost, "digest", "left")
        found = found.withColumns({
            "n": F.coalesce(F.col("own_n"), F.col("n") - F.coalesce(F.col("lost"), F.lit(0))),
            "keep": F.coalesce(F.col("own_keep"), F.col("keep")),
        })
    found = found.select("first", "sha", F.coalesce("keep", "first").alias("keep"), F.coalesce("n", F.lit(1)).alias("n")).unionByName(alone)
    return found.select(
        F.col("first")["id"].alias(id_col),
        F.col("keep")["id"].alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("first")["id"].eqNullSafe(F.col("keep")["id"]).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id stays, with all their columns. A Bloom filter of the ids that go lets most documents stay where they are; the others are compared with the list."""
    groups = staged(exact_groups(docs, id_col, text_col, **options).where("NOT kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).distinct(), "copies")
    own_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    may_go = bloom_filter(groups.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key")), groups.count(), 2).holds(own_id)
    same = F.col(f"_docs.{id_col}").eqNullSafe(F.col("_out.id")) & (F.sha2(normalised(F.coalesce(F.col(f"_docs.{text_col}"), F.lit(""))), 256) == F.col("_out.sha"))
    checked = docs.where(may_go).alias("_docs").join(groups.alias("_out").hint("shuffle_merge"), same, "left_anti")
    return docs.where(~may_go).unionByName(checked)
