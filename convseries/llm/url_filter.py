"""URL filter: host and path rules, then a Bloom filter cascade for exact membership of listed hosts.

The cascade alternates levels. Level 1 is a Bloom filter of the listed keys; level 2 holds the other keys of the
corpus that level 1 lets through; level 3 the listed keys that level 2 lets through, and so on until a level lets
none of the other side through. Every key of the corpus is known when the levels are built, so the walk through the
levels decides membership exactly, with no join over the pages. Pages read the levels' words as scalar subqueries of a
few rows (see `bloom`), whose size has a bound: lists too long for it get fewer bits a key and more levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convseries.llm.bloom import BloomFilter, bloom_filter, most_bits
from convseries.llm.common import per_key, small_checkpoint, staged


@dataclass(frozen=True)
class UrlRule:
    """verdict for host and its subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty for null or no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null where none does. Ties go to the earlier rule."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


class BloomCascade:
    """Exact membership of listed keys over a complete universe of keys: filters, and where the keys of a level are too many for one, a table of the listed keys that are left there."""

    def __init__(self, levels: list[BloomFilter], rest: DataFrame | None = None):
        self.levels, self.rest = levels, rest

    def contains(self, key: Column, rest: Column | None = None) -> Column:
        """True for listed keys. The first level that stops a key decides: an odd level stops other keys, an even one listed keys. rest says it of keys that no level stops, where there is such a table."""
        out = F.lit(len(self.levels) % 2 == 1) if rest is None else rest
        for level in reversed(self.levels):
            out = F.when(~level.holds(key), F.lit(level.seed % 2 == 0)).otherwise(out)
        return out

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows plus a column that says whether the key is listed. Rows that a level stops stay where they are; others meet the table, if there is one."""
        if self.rest is None:
            return rows.withColumn(name, self.contains(key))
        passes = F.lit(True)
        for level in self.levels:
            passes = passes & level.holds(key)
        stopped = rows.where(~passes).withColumn(name, self.contains(key))
        table = self.rest.select(F.col("key").alias("_key"), F.lit(True).alias("_listed"))
        met = per_key(rows.where(passes).withColumn("_key", key), table, "_key", F.spark_partition_id(), "left")
        return stopped.unionByName(met.withColumn(name, F.coalesce("_listed", F.lit(False))).drop("_key", "_listed"))

    @staticmethod
    def build(universe: DataFrame, bits_per_key: int = 10, **sizes: int) -> BloomCascade:
        """From a table (key, listed) with each key of the corpus once. sizes: bounds of the filters, as bloom_filter takes them. A level's keys (listed ones at odd levels, others at even ones) that pass even one bit each end the cascade in a table."""
        levels: list[BloomFilter] = []
        inside, outside = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
        n = inside.count()
        while True:
            if n > most_bits(**sizes):
                return BloomCascade(levels, staged(inside if len(levels) % 2 == 0 else outside, "listed-keys"))
            level = bloom_filter(inside, n, len(levels) + 1, bits_per_key, **sizes)
            levels.append(level)
            outside = small_checkpoint(outside.where(level.holds(F.col("key"))))
            n = outside.count()
            if n == 0:
                return BloomCascade(levels)
            inside, outside = outside, inside


def host_universe(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Each host of the pages once, as (key, listed); listed is a table with the column `key`, of which only hosts of the pages are taken."""
    hosts = pages.select(url_host(F.col(url_col)).alias("key"), F.lit(True).alias("here"), F.lit(False).alias("listed"))
    marked = listed.select(F.col("key").cast("string").alias("key"), F.lit(False).alias("here"), F.lit(True).alias("listed"))
    both = hosts.unionByName(marked).groupBy("key").agg(F.bool_or("here").alias("here"), F.bool_or("listed").alias("listed"))
    return small_checkpoint(both.where("here").select("key", "listed"))


def filter_urls(pages: DataFrame, rules: list[UrlRule], listed: DataFrame, url_col: str = "url", bits_per_key: int = 10, **sizes: int) -> DataFrame:
    """pages plus host, path, rule and verdict: the longest rule's, else block for hosts in the column `key` of listed and allow for others.

    Null urls and those without '://' have an empty host and path; the empty host is listed only if the list has it.
    Repeated and null keys of the list do not matter, nor do null page ids or urls of any length. Repeated rows stay
    repeated; an empty table gives an empty one. Columns of the pages named host, path, rule or verdict are replaced.
    """
    cascade = BloomCascade.build(host_universe(pages, listed, url_col), bits_per_key, **sizes)
    url = F.col(url_col)
    text, verdict = rule_for(url_host(url), url_path(url), rules)
    rows = cascade.mark(pages, url_host(url), "_on_list")
    verdict = F.coalesce(verdict, F.when(F.col("_on_list"), "block").otherwise("allow"))
    return rows.withColumns({"host": url_host(url), "path": url_path(url), "rule": text, "verdict": verdict}).drop("_on_list")
