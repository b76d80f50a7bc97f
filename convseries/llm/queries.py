"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convseries.llm import exact_dedup, html_text, mixing, near_dedup, packing, periodic, phrases, quality, repeats, sharding, token_files, toxicity, url_filter
from convseries.llm.common import WORD


def tokenizer_path(name: str) -> str:
    """The path of a public tokenizer file; CONVSERIES_TOKENIZERS names another folder."""
    if folder := os.environ.get("CONVSERIES_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the risk-controlled verdict of every document."""
    out = quality.quality_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("removed")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_grammar(docs, _table(spark, sf_dir, "labels")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from its token files."""
    return token_files.token_file_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


#: Rules of the URL filter, and the words that put a host of the pages on the list of this query.
RULES = [
    url_filter.UrlRule("allow", "org", "/"),
    url_filter.UrlRule("block", "example.org", "/es/"),
    url_filter.UrlRule("block", "example.org", "/en/1"),
    url_filter.UrlRule("allow", "com", "/fr/"),
    url_filter.UrlRule("block", "com", "/de/"),
]
LISTED_HOSTS = r"(^|[.-])(casino|bets|pills|spam|adult|ads)([.-]|$)"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    pages = _table(spark, sf_dir, "pages")
    listed = pages.select(url_filter.url_host(F.col("url")).alias("key")).where(F.col("key").rlike(LISTED_HOSTS)).distinct()
    out = url_filter.filter_urls(pages, RULES, listed)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, along a Hilbert curve through language, source and length."""
    dimensions = [sharding.Dimension("lang"), sharding.Dimension("source"), sharding.Dimension("n_chars", amount=True)]
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents"), dimensions).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one of ten documents, by the checksum h of its id, the n words from a = h/10 % n on become repetitions of the first p of them, p = 1 + (n - a) / (3 + h/10 % 8). Null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string)) div 10").alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    tails = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("words"), at(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, tails).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of every document and digests of its runs and of what is left without their repetitions."""
    out = periodic.periodic_runs(repeated_tails(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    out = out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), "runs_sha256", "collapsed_sha256")
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))


def queries() -> dict:
    """name -> callable(spark, sf_dir)."""
    return {f.__name__: f for f in (op1_quality_rules, op2_source_mix, op3_repeats, op4_html_text, op5_exact_dedup, op6_toxicity, op7_near_dedup, op8_packing, op9_token_files, op10_url_filter, op11_phrases, op12_shards, op13_periodic_runs)}


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
u AS (SELECT *, sum(source_size) OVER o AS full_size, sum(weight) OVER o AS w_upto, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_w
      FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, weight * (150 * all_size - 200 * (full_size - source_size)) >= 200 * source_size * (all_w - (w_upto - weight)) AS stops FROM u),
k AS (SELECT *, 150 * all_size - 200 * coalesce(sum(CASE WHEN stops THEN source_size END) OVER (), 0) AS rest, sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS w_rest FROM v),
t AS (SELECT source, source_size, CASE WHEN stops THEN (2 * source_size)::DOUBLE ELSE (weight * rest)::DOUBLE / (100 * w_rest)::DOUBLE END AS target FROM k),
b AS (SELECT *, CASE WHEN target >= source_size THEN floor(target / greatest(source_size, 1)) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(d.size) OVER (PARTITION BY d.source, h) AS cell
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * least(2, whole + CASE WHEN 2 * upto - cell <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

URL_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages),
q AS (SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                     WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                     WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                     WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
       WHEN regexp_matches(host, '(^|[.-])(casino|bets|pills|spam|adult|ads)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

PHRASE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT lang, len, unnest([ws[i : i + len - 1] for i in range(1, len(ws) - len + 2)]) AS words FROM w CROSS JOIN (VALUES (1), (2), (3)) AS v(len)),
g AS (SELECT lang, len, array_to_string(words, ' ') AS phrase, count(*) AS f FROM u GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM g WHERE len > 1 AND f >= 10),
k AS (SELECT c.*, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 :], ' ') AS rest FROM c JOIN (VALUES (1), (2)) AS v(k) ON k < len),
s AS (SELECT k.lang, k.phrase, k.f AS a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.f * k.f // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM k JOIN g AS x ON x.lang = k.lang AND x.phrase = k.head JOIN g AS y ON y.lang = k.lang AND y.phrase = k.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([array_to_string(words[1 : 2], ' '), array_to_string(words[2 : 3], ' ')]) AS phrase, f FROM c WHERE len = 3),
t AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
      FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 50 * b.a))
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL, where SQL can express the query."""
    return {"op2_source_mix": MIX_SQL, "op5_exact_dedup": EXACT_SQL, "op10_url_filter": URL_SQL, "op11_phrases": PHRASE_SQL}
