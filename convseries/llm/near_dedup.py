"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A signature has BANDS * ROWS values. SuperMinHash gives every shingle a random permutation of the places, drawn a step at
a time: at step j the shingle offers j plus a fraction at the place that its permutation puts j-th. Offers of one
shingle thus differ in their whole part, which lowers the variance, and once every place of a document holds a value
below j + 1 no later step can change it, so most documents stop after a few steps.

Documents with the same set are one class; sets are the same where a cryptographic digest of 128 bits of all their
shingles is, which are made of such digests of their words. Classes are the vertices, under numbers of their own, for an
id may stand on rows with several texts; the classes of one id are joined. Classes meet in the buckets of their bands. In a bucket everyone is compared with its head, the member that shares most buckets, and the links found are
joined into components: large groups of copies cost one comparison each. What this leaves are heads whose buckets
hold several components. Where a head has few members, members of different components are compared with each other.
Where it has many, the differences to the head tell who can be linked: two sets differ by what their differences to the
head do not share, so a set that is not linked with the head needs a partner that shares a known number of differing
shingles with it, and one of them is among the first of both in a fixed order (a prefix filter). So no link between classes that share a
bucket is lost, and no bucket is compared all with all.

Where sets are compared, a head's text travels once for HEAD_MEMBERS members, ahead of their texts.

Tables that a skewed key meets in a join are written first: Spark splits a skewed join only where both sides come
straight from a shuffle.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convseries.llm.common import GOLD, lowered, mix, small_checkpoint, staged, text_chunks, word_bounds
from convseries.llm.graphs import components

#: With these, two sets of similarity 0.85 share no band with probability 4e-6.
BANDS, ROWS = 32, 7
SHINGLE = 5
_SALTS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


def word_digests(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each word as two columns, and the first word of each text (one more at the end)."""
    import pyarrow as pa

    start, end = word_bounds(buf, offsets)
    if not len(start):
        return np.zeros((0, 2), np.uint64), np.zeros(len(offsets), np.int64)
    bounds = np.column_stack([start, end]).ravel().astype(np.int64)  # words and the gaps between them by turns
    pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = pieces.dictionary_encode()
    digests = np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist()), "<u8").reshape(-1, 2)
    return digests[coded.indices.to_numpy(zero_copy_only=False)[::2]], np.searchsorted(start, offsets)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The distinct shingle hashes of each text, sorted, one text after another; where each text's begin; and a 128-bit digest of each whole set, over 128 bits of each shingle."""
    words, first = word_digests(lowered(buf), offsets)  # the words of text i are first[i] .. first[i + 1]
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    found = np.tile(_SALTS, (len(doc), 1))
    for k in range(width):
        live = slice(None) if count.sum() == 0 or n[doc].min() > k else n[doc] > k
        found[live] = mix((found[live] + words[at[live] + k]) * GOLD)
    bounds = np.concatenate([[0], np.cumsum(count)])
    order = np.lexsort((found[:, 0], doc))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]).any(axis=1) | (doc[1:] != doc[:-1])
    found = np.ascontiguousarray(found[new])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))])
    raw = memoryview(found).cast("B") if len(found) else memoryview(b"")
    return np.ascontiguousarray(found[:, 0]), bounds, [blake2b(raw[16 * a : 16 * b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]


def _draw(k: int) -> np.uint64:
    return np.uint64(k * int(GOLD) % (1 << 64))


def super_minhash(elements: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """Signatures (a row for each text) of the element hashes between bounds; rows of empty sets hold the largest value."""
    n = len(bounds) - 1
    signature = np.full(n * places, np.uint64(2**64 - 1))
    doc = np.repeat(np.arange(n), np.diff(bounds))
    order = np.tile(np.arange(places, dtype=np.uint8), (len(elements), 1))
    row = np.arange(len(elements))
    for j in range(places):
        if not len(row):
            break
        own = elements[row]
        fraction = mix(own + _draw(2 * j + 1)) >> np.uint64(16)
        draw = mix(own + _draw(2 * j + 2)) >> np.uint64(32)
        k = j + ((draw * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        place = order[row, k]
        order[row, k] = order[row, j]
        np.minimum.at(signature, doc[row] * places + place, (np.uint64(j) << np.uint64(48)) | fraction)
        live = np.unique(doc[row])
        done = np.zeros(n, bool)
        done[live] = signature.reshape(n, places)[live].max(axis=1) < np.uint64(j + 1) << np.uint64(48)
        row = row[~done[doc[row]]]
    return signature.reshape(n, places)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature; bands never share a key but by chance."""
    cells = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLD), cells.shape[:2])
    for r in range(rows):
        keys = mix(keys * GOLD + cells[:, :, r])
    return keys


def set_keys(rows: DataFrame) -> DataFrame:
    """(id, n, k1, k2, text) for rows (id, text): size and digest of the whole set."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            for row, buf, offsets in text_chunks(batch.column(1), 300_000):
                _, bounds, digests = shingle_sets(buf, offsets)
                k1, k2 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
                ids, texts = (batch.column(k).slice(row, len(digests)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds), pa.int64()), pa.array(np.ascontiguousarray(k1)), pa.array(np.ascontiguousarray(k2)), texts], names=["id", "n", "k1", "k2", "text"])

    return rows.mapInArrow(sign, "id long, n long, k1 long, k2 long, text string")


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, k1, k2, bands): set size, a 128-bit digest of the whole set, band keys (none for an empty set)."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            for row, buf, offsets in text_chunks(batch.column(1), 300_000):
                sets, bounds, digests = shingle_sets(buf, offsets)
                n = np.diff(bounds)
                k1, k2 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
                keys = band_keys(super_minhash(sets, bounds, BANDS * ROWS)).view(np.int64)
                size = np.where(n > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(k1)), pa.array(np.ascontiguousarray(k2)), lists], names=["id", "n", "k1", "k2", "bands"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(sign, "id long, n long, k1 long, k2 long, bands array<long>")


def _shingles(text: str, width: int = SHINGLE) -> set:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower changes A-Z only; bytes.split cuts at the six white-space characters
    return set(zip(*(words[k:] for k in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


#: Members for which a head's text is sent once.
HEAD_MEMBERS = 200


def _beside_heads(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (b, part, member, a, text, other columns of pairs (a, b, ...)), in the order of b and part: the text of the head b, then those of its members a. Heads with many members have several parts."""
    pairs = staged(pairs, "pairs")
    sizes = staged(pairs.groupBy("b").agg(F.ceil(F.count("*") / HEAD_MEMBERS).alias("parts")), "head-sizes")
    dealt = staged(pairs.join(sizes.hint("shuffle_merge"), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts"), "dealt")
    others = [c for c in pairs.columns if c not in ("a", "b")]
    kinds = dict(pairs.dtypes)
    members = dealt.join(texts.select(F.col("id").alias("a"), "text").hint("shuffle_merge"), "a").select("b", "part", F.lit(True).alias("member"), "a", "text", *others)
    heads = dealt.select("b", "part").distinct().join(texts.select(F.col("id").alias("b"), "text").hint("shuffle_merge"), "b")
    heads = heads.select("b", "part", F.lit(False).alias("member"), F.col("b").alias("a"), "text", *[F.lit(0).cast(kinds[c]).alias(c) for c in others])
    return members.union(heads).repartition("b", "part").sortWithinPartitions("b", "part", "member")


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, both) for pairs (a, b): the sizes of the full sets and of their intersection."""

    def measure(batches):
        import pandas as pd

        held: set = set()
        for rows in batches:
            out = []
            for b, member, a, text in zip(rows["b"], rows["member"], rows["a"], rows["text"]):
                own = _shingles(text)
                if member:
                    out.append((a, b, len(own), len(held), len(own & held)))
                else:
                    held = own
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "size_a", "size_b", "both"], dtype="int64")

    return _beside_heads(pairs.select("a", "b"), texts).mapInPandas(measure, "a long, b long, size_a long, size_b long, both long")


def links(pairs: DataFrame, percent: int) -> DataFrame:
    """The measured pairs with at least percent similarity."""
    return pairs.where(100 * F.col("both") >= percent * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b")


def prefix_differences(pairs: DataFrame, texts: DataFrame, c: float) -> DataFrame:
    """(b, e, a, component, apart, to_apart, to_near, k, d, size): of the shingles (hashed) that are in only one of the sets a and b, those of the prefixes of a, for partners that are apart and for those that are near; k is the place of e among the d differences.

    The order is fixed: shingles that b lacks come first, for they are rare, then by hash."""

    def differ(batches):
        import pandas as pd

        held: set = set()
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                own = _shingles(r.text)
                if not r.member:
                    held = own
                    continue
                room = c * (r.size_a + r.most)
                to_apart, to_near = (r.d - max(1, math.ceil((r.d + partner - room) / 2 - 1e-9)) + 1 for partner in (c * (r.least + r.size_b), r.nearest))
                last = max(to_apart, to_near if r.apart else 0)
                if last > 0:
                    order = sorted((words in held, int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)) for words in own ^ held)
                    out += [(r.b, e, r.a, r.component, r.apart, k < to_apart, k < to_near, k, r.d, r.size_a) for k, (_, e) in enumerate(order[:last])]
            if out:
                yield pd.DataFrame(out, columns=["b", "e", "a", "component", "apart", "to_apart", "to_near", "k", "d", "size"])

    columns = ["a", "b", "component", "apart", "d", "size_a", "size_b", "least", "most", "nearest"]
    return _beside_heads(pairs.select(*columns), texts).mapInPandas(differ, "b long, e long, a long, component long, apart boolean, to_apart boolean, to_near boolean, k long, d long, size long")


def _few_members(family: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (head, id, n, component) of different components, neither of them the head."""
    left = family.select("head", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a")).where("a != head")
    right = family.select("head", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b")).where("b != head")
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return left.join(right.hint("shuffle_merge"), "head").where((F.col("c_a") < F.col("c_b")) & alike).select("a", "b").distinct()


def _many_members(family: DataFrame, stars: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components that can be linked, by the prefix filter on their differences to the head.

    With c = (100 - percent) / (100 + percent), sets x and y are linked if at most c (|x| + |y|) shingles are in one of
    them only, which is |dx| + |dy| - 2 shared for their differences dx, dy to the head. Members not linked with the head
    (apart) have |dx| > c (|x| + |head|). The least number of shared differences follows from the smallest and largest
    values in the head's family, and a set that must share m of its d differences has one of them among the first d - m + 1
    of a fixed order.
    """
    c = (100 - percent) / (100 + percent)
    own = family.where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b"), "component")
    known = staged(own.join(stars.hint("shuffle_merge"), ["a", "b"]).withColumn("d", F.col("size_a") + F.col("size_b") - 2 * F.col("both")), "family")
    known = known.withColumn("apart", 100 * F.col("both") < percent * (F.col("size_a") + F.col("size_b") - F.col("both")))
    bounds = staged(known.groupBy("b").agg(F.min("size_a").alias("least"), F.max("size_a").alias("most"), F.min("d").alias("nearest"), F.bool_or("apart").alias("any_apart")).where("any_apart"), "bounds")
    posted = staged(prefix_differences(known.join(bounds.hint("shuffle_merge"), "b"), texts, c), "posted")
    left = posted.where("apart").select("b", "e", F.col("a").alias("x"), F.col("component").alias("cx"), F.col("to_apart").alias("xa"), F.col("to_near").alias("xn"), F.col("k").alias("kx"), F.col("d").alias("dx"), F.col("size").alias("sx"))
    right = posted.where("to_apart").select("b", "e", F.col("a").alias("y"), F.col("component").alias("cy"), F.col("apart").alias("ya"), F.col("k").alias("ky"), F.col("d").alias("dy"), F.col("size").alias("sy"))
    fits = (F.col("ya") & F.col("xa") & (F.col("x") < F.col("y"))) | (~F.col("ya") & F.col("xn"))
    # the first shared difference leaves no more to share than stand behind it
    behind = F.least(F.col("dx") - F.col("kx"), F.col("dy") - F.col("ky"))
    fits = fits & (behind >= (F.col("dx") + F.col("dy") - c * (F.col("sx") + F.col("sy"))) / 2 - 1e-9)
    return left.join(right.hint("shuffle_merge"), ["b", "e"]).where(fits & (F.col("cx") != F.col("cy"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


#: Members of a head up to which they are compared with each other without a filter.
FEW = 48


KEYS = ["k1", "k2", "n"]


def class_texts(docs: DataFrame, classes: DataFrame, several: DataFrame | None) -> DataFrame:
    """(id, text): a text for each class (id, rep, keys) from docs (id, text). `several` are the ids with more than one set: their texts are told apart by their keys."""
    texts = classes.select(F.col("id").alias("class"), F.col("rep").alias("id"), *KEYS)
    if several is None:
        found = docs.join(texts.select("id", "class").hint("shuffle_merge"), "id").select("class", "text")
    else:
        plain = texts.join(several.hint("shuffle_merge"), "id", "left_anti").select("id", "class")
        found = docs.join(plain.hint("shuffle_merge"), "id").select("class", "text")
        keyed = set_keys(docs.join(several.hint("shuffle_merge"), "id", "left_semi").select("id", "text"))
        mixed = texts.join(several.hint("shuffle_merge"), "id", "left_semi").drop("id")
        found = found.union(keyed.drop("id").join(mixed.hint("shuffle_merge"), KEYS).select("class", "text"))
    return found.dropDuplicates(["class"]).withColumnRenamed("class", "id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and split at white space; a set holds the distinct five-word shingles, or the whole
    sequence if there are fewer words. Null and wordless texts have an empty set, are linked with nothing and are kept.
    Rows of one id are one document: the id is linked with whatever any of its texts is linked with, and all its rows have
    the same component. Rows with a null id are kept and have a null component. An empty table gives an empty result.
    """
    rows = staged(signed(docs, id_col, text_col), "signed")
    known = rows.where("id IS NOT NULL")
    # a class's number stands in the written table, so that every reader finds the same
    classes = known.where("n > 0").groupBy(*KEYS).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    several = staged(known.groupBy("id").agg(F.min(F.struct(*KEYS)).alias("lo"), F.max(F.struct(*KEYS)).alias("hi")).where("lo < hi").select("id"), "several")
    several = None if several.isEmpty() else several

    spread = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = staged(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = staged(spread.join(shared.hint("shuffle_merge"), "key"), "members")
    scores = members.groupBy("id").agg(F.sum("size").alias("score"))
    members = staged(members.drop("size").join(scores.hint("shuffle_merge"), "id"), "scored")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = staged(class_texts(own, classes.drop("bands").join(scores.select("id").hint("shuffle_merge"), "id"), several), "candidates")

    # everyone of each bucket with its head, each pair once
    heads = small_checkpoint(members.groupBy("key").agg(F.max_by(F.col("id"), F.struct("score", -F.col("id"))).alias("head")))
    headed = staged(members.join(heads.hint("shuffle_merge"), "key").select("key", "id", "n", "head"), "headed")
    stars = staged(measured(headed.where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), texts), "stars")
    edges = links(stars, percent)
    if several is not None:
        of_id = staged(known.where("n > 0").join(several.hint("shuffle_merge"), "id", "left_semi").withColumnRenamed("id", "doc").join(classes.select(*KEYS, "id").hint("shuffle_merge"), KEYS).select("doc", "id").distinct(), "classes-of-ids")
        hubs = staged(of_id.groupBy("doc").agg(F.min("id").alias("hub")), "hubs")
        edges = edges.union(of_id.join(hubs.hint("shuffle_merge"), "doc").where("id != hub").select("id", "hub"))
    edges = staged(edges, "links")
    found = components(edges)

    # heads whose buckets hold several components
    labelled = staged(headed.join(found.hint("shuffle_merge"), "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    mixed = staged(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "mixed")
    family = staged(labelled.join(mixed.hint("shuffle_merge"), "key").select("head", "id", "n", "component").distinct(), "families")
    sizes = staged(family.groupBy("head").agg(F.count("*").alias("members")).where("members > 2"), "sizes")
    family = staged(family.join(sizes.hint("shuffle_merge"), "head"), "families")
    if not family.isEmpty():
        more = _few_members(family.where(F.col("members") <= FEW), percent)
        many = family.where(F.col("members") > FEW)
        if not many.isEmpty():
            more = more.union(_many_members(many, stars, texts, percent)).distinct()
        tried = stars.select("a", "b")
        more = staged(more.join(tried.union(tried.select("b", "a")).hint("shuffle_merge"), ["a", "b"], "left_anti"), "pairs")
        edges = staged(edges.union(links(measured(more, texts), percent)), "links")
        found = components(edges)

    # components by their smallest document; a class that is linked with nothing is its own
    linked = staged(found.join(classes.select("id", "rep").hint("shuffle_merge"), "id"), "linked")
    least = staged(linked.groupBy("component").agg(F.min("rep").alias("least")), "components")
    named = staged(linked.join(least.hint("shuffle_merge"), "component").select("id", "least"), "named")
    groups = classes.join(named.hint("shuffle_merge"), "id", "left").select("k1", "k2", F.col("n").alias("class_n"), F.coalesce("least", "rep").alias("component"))
    groups = staged(groups, "groups")
    out = rows.join(groups.hint("shuffle_merge"), (rows["k1"] == groups["k1"]) & (rows["k2"] == groups["k2"]) & (rows["n"] == F.col("class_n")), "left")
    component = F.coalesce("component", "id")
    if several is not None:  # an empty text of an id that has others
        of_others = staged(of_id.join(named.hint("shuffle_merge"), "id", "left").join(classes.select("id", "rep").hint("shuffle_merge"), "id").groupBy("doc").agg(F.min(F.coalesce("least", "rep")).alias("of_id")), "of-ids")
        out = out.join(of_others.hint("shuffle_merge"), out["id"] == F.col("doc"), "left")
        component = F.coalesce("component", "of_id", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The documents whose id stands for its group, with all their columns; null ids stay."""
    gone = near_groups(docs, id_col, text_col, percent).where("NOT kept").select(F.col(id_col).alias("gone")).distinct()
    return docs.alias("_docs").join(gone.alias("_out"), F.col(f"_docs.{id_col}") == F.col("_out.gone"), "left_anti")
