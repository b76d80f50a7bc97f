"""Phrases, Hilbert shards and periodic runs against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convseries.llm import periodic, phrases, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, x long, part int, runs string"


def prose(seed, n, words, marks=" .,\n\t"):
    rng = random.Random(seed)
    return "".join(rng.choice(words) + (rng.choice(marks) if rng.random() < 0.2 else "") + " " for _ in range(n))


def corpus():
    few, many = ["the", "The", "of", "é", "x"], [f"w{k}" for k in range(60)]
    texts = [prose(k, 30 + k, few + many[: 5 + k]) for k in range(40)] + [prose(99, 9000, few + many)]
    texts += [None, "", " \t", ".,;", "one", "a  b\ta b.a b\x0ba b", "\x1c a b", texts[3], texts[3]]
    return [(k if k != 7 else None, t, ["en", "de", None, "und"][k % 4], ["s1", "s2", None][k % 3], len(t or ""), "k", 1, 2, 3, "r") for k, t in enumerate(texts)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 11 ----------------------------------------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_phrases(rows, top, threshold, longest, percent):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = []
    often = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= threshold}
    inside = Counter()
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                key = (lang, p[i : i + m])
                inside[key] = max(inside[key], a)
    for (lang, p), a in often.items():
        if inside[lang, p] and 100 * inside[lang, p] >= percent * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out = []
    for lang, own in itertools.groupby(sorted(found), key=lambda x: x[0]):
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (_, s, a, p, l, r, n) in enumerate(itertools.islice(own, top), 1)]
    return out


@pytest.mark.parametrize("threshold,longest,percent,counters,top", [(10, 3, 50, phrases.COUNTERS, 2000), (4, 4, 70, 40, 30), (2, 2, 50, 7, 5)])
def test_phrases(docs, threshold, longest, percent, counters, top):
    out = phrases.collocations(docs, top, threshold, longest, percent, counters=counters)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_phrases([(r[1], r[2]) for r in corpus()], top, threshold, longest, percent)
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 3


def test_phrases_of_nothing(spark, empty):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "x")], "text string, lang string")).count() == 0


@pytest.mark.parametrize("counters", [3, 50, 400])
def test_summaries_keep_what_is_frequent(counters):
    rng = np.random.default_rng(counters)
    keys = rng.zipf(1.3, 20_000).astype(np.uint64) % np.uint64(3000)
    summary, true = phrases.Summary(counters, 40), Counter(keys.tolist())
    for part in np.array_split(keys, 37):
        summary.add(*np.unique(part, return_counts=True))
    left = summary.survivors().tolist()
    assert {k for k, f in true.items() if f >= 40} <= set(left) and summary.taken < 40
    assert all(true[k] - summary.taken <= c <= true[k] for k, c in zip(summary.keys.tolist(), summary.counts.tolist()))
    if counters == 400:  # fewer counters than mass / threshold are doubled, as many or more never
        assert summary.counters == counters or counters * 40 < len(keys)
    roomy = phrases.Summary(len(keys) // 40 + 1, 40)
    for part in np.array_split(keys, 37):
        roomy.add(*np.unique(part, return_counts=True))
    assert {k for k, f in true.items() if f >= 40} <= set(roomy.survivors().tolist()) and roomy.counters == len(keys) // 40 + 1


def test_bitmap_has_all_keys(spark):
    rng = random.Random(1)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(500)] + [-1, 0, 2**63 - 1]
    bits, found = phrases.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    slots = {(k % 2**64) >> (64 - bits) for k in keys}
    assert {s for s in range(1 << bits) if found[s >> 3] >> (7 - (s & 7)) & 1} == slots


def test_exact_products(spark):
    """Counts whose products pass 64 bits."""
    a, l, r = 3 * 10**14, 10**15, 7 * 10**14
    grams = spark.createDataFrame([("en", "p q", 2, a), ("en", "p", 1, l), ("en", "q", 1, r)], "lang string, phrase string, len int, f long")
    assert phrases._cut_scores(grams, 3).first().score == 10**6 * a * a // (l * r)


# -- 12 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,bits", [(1, 5), (2, 5), (3, 3), (4, 2), (5, 2)])
def test_hilbert_curve(spark, n, bits):
    """Every cell once, and each next to the one before."""
    axis = spark.range(1 << bits)
    cells = axis.select(F.col("id").alias("c0"))
    for k in range(1, n):
        cells = cells.crossJoin(axis.select(F.col("id").alias(f"c{k}")))
    rows = sorted((r[0], r[1:]) for r in cells.select(sharding.curve_index([F.col(f"c{k}") for k in range(n)], bits), *cells.columns).collect())
    assert [i for i, _ in rows] == list(range(1 << bits * n)) and rows[0][1] == (0,) * n
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(rows, rows[1:]))


def test_shards(spark, docs, empty):
    dims = [sharding.Dimension("lang"), sharding.Dimension("source"), sharding.Dimension("n_chars", True)]
    for shards, table in ((8, docs), (3, docs), (8, docs.where("doc_id < 3")), (8, empty)):
        out, rows = sharding.hilbert_shards(table, dims, shards).collect(), table.collect()
        key = lambda i, t: (i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        assert Counter((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in out) == Counter(key(r.doc_id, r.text) for r in rows)
        sizes = Counter(r.shard for r in out)
        full = [sizes[k] for k in range(shards)]
        assert sum(full) == len(rows) and max(full) - min(full) <= 1 and set(sizes) <= set(range(shards))
        assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(shards) for k in range(sizes[s])]
        in_order = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
        assert in_order == sorted(in_order) and {(r.law, r.grown_shard) for r in out} <= {("rows", None)}


def test_cells_hold_equal_parts(spark):
    rows = spark.range(40_000).select(F.floor(F.exp(F.rand(3) * 9)).alias("n_chars"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 500)).alias("source"))
    keyed = rows.select(sharding._key(sharding.Dimension("n_chars", True)).alias("k0"), sharding._key(sharding.Dimension("source")).alias("k1"))
    amounts, values = (t.collect() for t in sharding.dimension_cells(keyed, ["k0", "k1"]))
    assert [r.cell for r in sorted(amounts)] == sorted(r.cell for r in amounts) and max(r.cell for r in amounts) > 240
    assert len(values) == 501 and len({r.cell for r in values}) > 150


def test_written_shards_are_pruned(spark):
    dims = [sharding.Dimension("lang"), sharding.Dimension("source"), sharding.Dimension("n_chars", True)]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/shards"
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang"), F.concat(F.lit("s"), F.floor(F.rand(1) * 20)).alias("source"), F.floor(F.exp(F.rand(2) * 9)).alias("n_chars"))
    table = spark.createDataFrame(table.collect(), table.schema)
    sharding.write_shards(table, path, dims, 32)
    for bounds in ({"lang": ("l2", "l2")}, {"n_chars": (3000, 4000)}, {"source": ("s11", "s12"), "lang": ("l1", "l1")}, {"source": ("zz", "zz")}):
        out = sharding.read_shards(spark, path, dims, bounds)
        want = [tuple(r) for r in table.collect() if all(low <= r[c] <= high for c, (low, high) in bounds.items())]
        assert sorted(map(tuple, out.select(*table.columns).collect())) == sorted(want)
        shards = spark.read.parquet(f"{path}/manifest")
        may = F.lit(True)
        for c, (low, high) in bounds.items():
            i = [d.column for d in dims].index(c)
            may = may & (F.col(f"max_{i}") >= low) & (F.col(f"min_{i}") <= high)
        assert shards.where(may).count() <= 20
    plan = sharding.read_shards(spark, path, dims, {"lang": ("l2", "l2")})._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*shard#\d+ (IN|INSET)", plan)


def test_shards_of_the_given_table(spark, sf):
    out = queries.op12_shards(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)


# -- 13 ----------------------------------------------------------------------------------------------------------------


def plain_runs(words, exponent=4, shortest=6):
    """Every maximal stretch at each lag, longest periods included; a stretch that a smaller lag explains is not one of its own."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((start, length, q) for (start, length), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(3)
    out = [None, "", " \n", "x", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", ("a b c " * 4 + "z ") * 5, "ab ab ab ab ab ab é é é é é é"]
    for k in range(150):
        letters, parts = "abcdefg"[: 2 + k % 6], []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            parts += unit * rng.randint(1, 7) + [rng.choice(letters) for _ in range(rng.randint(0, 12))]
        out.append("".join(w + rng.choice([" ", "\n", "  \t", "\x0b"]) for w in parts))
    unit = [f"u{rng.randrange(900)}" for _ in range(700)]
    return [*out, " ".join(unit * 4 + ["end"] + unit), " ".join(rng.choice("ab") for _ in range(3000))]


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (3, 3), (5, 20)])
def test_runs(spark, exponent, shortest):
    texts = periodic_texts()
    rows = [(k if k != 5 else None, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[20]], "doc_id long, text string, runs string").repartition(2)
    out = periodic.periodic_runs(docs, exponent=exponent, shortest=shortest).collect()
    want = []
    for i, t, _ in [*rows, rows[20]]:
        words = WORD.findall(t or "")
        runs = plain_runs(words, exponent, shortest)
        want.append((i is None, i, runs, plain_collapsed(words, runs)))
    assert sorted((r.doc_id is None, r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out) == sorted(want)
    assert sum(len(w[2]) for w in want) > 30


def test_splitting_leaves_only_frequent_words():
    rng = np.random.default_rng(0)
    word, text = rng.integers(0, 40, 5000), np.repeat(np.arange(50), 100)
    place, segment = periodic.split_segments(word, text, 4, 6)
    for s in np.unique(segment):
        own = word[place[segment == s]]
        assert len(own) >= 6 and np.unique(own, return_counts=True)[1].min() >= 4
    nothing = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in periodic.split_segments(nothing, nothing, 4, 6))


def test_runs_of_the_given_table(spark, sf, empty):
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, exponent=2)
    out = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    changed = 0
    for r in rows:
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
            changed += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        got = out[r.doc_id]
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *(best or (None, None, None)))
        assert got.exponent_milli == (best and 1000 * best[1] // best[2])
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert changed > 5


def test_rows_of_summaries_are_small(spark):
    """A worker holds 10,000 rows at a time, whatever number of partitions the n-grams are cut into."""
    texts = spark.createDataFrame([(" ".join(f"w{i % 997}x{i % 31}" for i in range(k, k + 4000)), "en") for k in range(3)], "text string, lang string").coalesce(1)
    rows = phrases.part_summaries(texts, 2, 3).collect()
    assert max(len(r["keys"]) for r in rows) <= 8 * phrases.PIECE and all(2 * len(r["counts"]) == len(r["keys"]) for r in rows)
    found = Counter()
    for r in rows:
        keys = np.frombuffer(r["keys"], np.uint64)
        assert (keys >> np.uint64(63) == r["part"]).all()
        found.update(dict(zip(keys.tolist(), np.frombuffer(r["counts"], np.uint32).tolist())))
    assert sum(found.values()) == 3 * (4000 + 3999 + 3998)
    got = phrases.surviving_keys(phrases.part_summaries(texts, 2, 3), 100_000, 10)
    assert sorted(r.key for r in got.collect()) == sorted(int(np.uint64(k).view(np.int64)) for k, n in found.items() if n >= 10)
