"""Repeated byte strings: a run-length index over the passages that can repeat.

A string of `length` bytes that starts at two places of the corpus holds the same anchor at both: the leftmost of its
K-byte substrings with the smallest hash. The strings that share an anchor begin side by side, so an anchor stands for a
span of the text, with all of them. Spark counts anchors over the whole corpus. Spans whose anchor is rare need no
look; spans that are equal as a whole (by 128 bits of hashes beside the anchor's 64) are repeated as a whole. What is left are spans that share an anchor but differ
somewhere: one of each kind goes, dealt by anchor, to a run-length index.

The index sorts the suffixes of a block of spans, forms the Burrows-Wheeler transform and keeps only the ends of its
runs, with their text positions and the match with the neighbour there. Streaming over the text from left to right, the
sampled run ends give the longest match of each place with any other one (inside a run the match shrinks by one byte
per step), and places with at least `length` bytes are marked. Anchors with very many different spans would make a
block too large. Their spans are halved: the strings that start in the same half (by the distance from the anchor) have
more bytes in common than the anchor, so the halves are dealt anew by these bytes, and halves that are equal or alone are
settled; what is left goes to the index or is halved again.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convseries.llm.common import GOLD, mix, powers, prefix_sums, range_hashes, salted_join, staged, text_chunks

LENGTH = 200
#: Bytes of an anchor.
K = 32
#: Low bits of a place in the keys that choose anchors: texts have less than 4 GB.
_PLACE_BITS = np.uint64(32)
#: Most different spans of one anchor in the index, and about the bytes of a block.
MOST_SPANS, BLOCK_BYTES = 1500, 2_000_000
SEPARATOR = 0xFF  # never in UTF-8


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has so many."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_spans(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, two span hashes, first, more, rel) of the spans of texts: the strings of `length` bytes that start at first and the next `more` bytes share the anchor, which stands rel bytes after first."""
    none = (np.zeros(0, np.int64),) * 7
    if len(buf) < length:
        return none
    width = length - K + 1
    sums = prefix_sums(buf)
    at = np.arange(len(buf) - K + 1)
    _, down = powers(len(sums))
    keys = ((sums[K:] - sums[:-K]) * down[: len(at)] * GOLD) >> _PLACE_BITS << _PLACE_BITS | at.astype(np.uint64)
    place = (sliding_min(keys, width) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    begins = np.zeros(len(place) + 1, bool)
    begins[1:-1] = place[1:] != place[:-1]
    begins[0] = begins[-1] = True
    ends_of_text = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(place))]
    begins[ends_of_text] = True
    first = np.flatnonzero(begins)
    last = first[1:] - 1
    first = first[:-1]
    text = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(last, offsets[text + 1] - length)
    ok = first <= last
    text, first, last = text[ok], first[ok], last[ok]
    anchor = place[first]
    # where the anchor stands in the span is part of what makes spans equal
    spans = [mix(range_hashes(x, first, last + length, k) + (anchor - first).astype(np.uint64)).view(np.int64) for k, x in enumerate((sums, prefix_sums(buf, 1)))]
    return text, range_hashes(sums, anchor, anchor + K).view(np.int64), *spans, first - offsets[text], last - first, anchor - first


def span_table(docs: DataFrame, length: int) -> DataFrame:
    """(a, s, s2, d, first, more, rel): every span of every text (d, text)."""

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            for row, buf, offsets in text_chunks(batch.column(1), 1_000_000):
                text, a, s, s2, first, more, rel = anchor_spans(buf, offsets, length)
                take = pa.array(row + text)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(s), pa.array(s2), batch.column(0).take(take), pa.array(first, pa.int64()), pa.array(more.astype(np.int16)), pa.array(rel.astype(np.int16))], names=["a", "s", "s2", "d", "first", "more", "rel"])

    return docs.mapInArrow(find, "a long, s long, s2 long, d binary, first long, more short, rel short")


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes and the 8-byte words at each place. Prefix doubling; only places that still tie are sorted again."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text.astype(np.uint64) + np.uint64(1)
    wide = np.minimum(wide, np.uint64(255))
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | wide[k : k + n]
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    new = np.ones(n, bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group + 1
    rank[n] = 0
    h = 8
    while True:
        tied = np.zeros(n, bool)
        tied[:-1] = ~new[1:]
        tied |= ~new
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order, words
        places = order[slots]
        key = rank[places] * np.int64(n + 1) + rank[np.minimum(places + h, n)]
        by = np.argsort(key, kind="stable")
        key, places = key[by], places[by]
        order[slots] = places
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        rank[places] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))] + 1
        h *= 2


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to about most, from the 8-byte words."""
    n, out, live, step = len(words), np.zeros(len(a), np.int64), np.arange(len(a)), 0
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    while len(live) and step < most:
        x, y = np.minimum(a[live] + step, n), np.minimum(b[live] + step, n)
        differ = padded[x] ^ padded[y]
        same = (differ == 0) & (x < n) & (y < n)
        stop = ~same
        lead = np.zeros(int(stop.sum()), np.int64)
        d = differ[stop]
        for k in range(1, 8):  # whole bytes in front that agree
            lead += (d >> np.uint64(64 - 8 * k)) == 0
        out[live[stop]] = step + lead
        out[live[same]] = step + 8
        live, step = live[same], step + 8
    return out


def longest_matches(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place of a block of spans [starts, ends) the longest match with another place, cut at the span's end; by run ends of the transform."""
    order, words = suffix_array(text)
    n = len(text)
    before = text[order - 1]  # the transform; the first suffix takes the last byte
    span_end = np.full(n, 0, np.int64)
    span_end[starts] = ends
    span_end = np.maximum.accumulate(span_end)
    changes = before[1:] != before[:-1]
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    reach = np.zeros(n, np.int64)
    most = int((ends - starts).max()) + 8
    for up in (True, False):  # heads of runs with the suffix above, tails with the one below
        sampled = np.zeros(n, bool)
        sampled[1:] |= changes if up else False
        sampled[:-1] |= False if up else changes
        sampled[place_of[starts]] = True
        sampled[0 if up else n - 1] = True
        rows = np.flatnonzero(sampled)
        other = rows - 1 if up else rows + 1
        inside = (other >= 0) & (other < n)
        at = order[rows]
        match = np.zeros(len(rows), np.int64)
        match[inside] = common_prefix(words, at[inside], order[other[inside]], most)
        ending = np.zeros(n, np.int64)
        ending[at] = np.minimum(at + match, span_end[at])
        last = np.zeros(n, np.int64)
        last[at] = at
        last = np.maximum.accumulate(last)
        reach = np.maximum(reach, ending[last] - np.arange(n))
    return np.maximum(reach, 0)


def mark_block(spans: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each span the ranges of its bytes that are covered by strings of `length` bytes found elsewhere in the block."""
    sizes = np.array([len(s) for s in spans])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    text = np.frombuffer(b"\xff".join(spans) + b"\xff", np.uint8)
    long = longest_matches(text, starts, ends) >= length
    place = np.flatnonzero(long)
    out: list[list[tuple[int, int]]] = [[] for _ in spans]
    if len(place):
        cut = np.flatnonzero(np.diff(place) > 1) + 1
        owner = np.searchsorted(starts, place, side="right") - 1
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])):
            k = owner[a]
            out[k].append((int(place[a] - starts[k]), int(place[b - 1] - starts[k] + length)))
    return out


def _indexed_marks(spans: DataFrame, length: int) -> DataFrame:
    """Marks (d, start, end) of the spans (PIECE) that occur once, each anchor within one block."""

    def mark(batches):
        import pandas as pd

        held: list = []

        def flush(rows):
            found = mark_block([r[4] for r in rows], length)
            out = [(r[1], r[2] + a, r[2] + b) for r, marks in zip(rows, found) if r[3] == 1 for a, b in marks]
            return pd.DataFrame(out, columns=["d", "start", "end"]).astype({"d": object, "start": "int64", "end": "int64"})

        size = 0
        for batch in batches:
            for r in batch[["a", "d", "first", "n", "bytes"]].itertuples(index=False, name=None):
                if size >= BLOCK_BYTES and held[-1][0] != r[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield flush(held)

    return spans.repartition("a").sortWithinPartitions("a", "s", "s2").mapInPandas(mark, "d binary, start long, end long")


#: A span of one kind: its anchor and span keys, place, number of occurrences, the distances (lo, hi) from the anchor at which its strings may start, and its bytes.
PIECE = "a long, s long, s2 long, d binary, first long, more int, rel int, n long, lo int, hi int, bytes binary"


def _halves(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece cut into the strings of the lower and of the upper half of [lo, hi], with keys of the bytes that all strings of a half share."""

    def halve(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for a, d, first, more, rel, n, lo, hi, raw in batch[["a", "d", "first", "more", "rel", "n", "lo", "hi", "bytes"]].itertuples(index=False, name=None):
                middle = (lo + hi) // 2
                for low, high in ((lo, middle), (middle + 1, hi)):
                    x, y = max(low, -rel), min(high, more - rel)
                    if x > y:
                        continue
                    skip = x + rel  # strings of the piece before this half
                    core = raw[rel + high : rel + low + length]
                    part = raw[skip : rel + y + length]
                    key, own = (hashlib.blake2b(b, digest_size=16, salt=f"{low},{high}".encode()).digest() for b in (a.to_bytes(8, "little", signed=True) + core, part + bytes([(rel - skip) & 0xFF])))
                    out.append((*np.frombuffer(key[:8] + own, "<i8").tolist(), d, first + skip, y - x, rel - skip, n, low, high, part))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])

    return pieces.mapInPandas(halve, PIECE)


def _crowded_marks(pieces: DataFrame, length: int) -> DataFrame | None:
    """Marks of pieces whose anchors have very many kinds; None for no pieces. At one string a piece, equal cores are equal pieces, so the halving ends."""
    marks = None
    while not pieces.isEmpty():
        parts = staged(_halves(pieces, length), "halves")
        fields = ["d", "first", "more", "rel", "lo", "hi", "bytes"]
        kinds = staged(parts.groupBy("a", "s", "s2").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.min(F.struct(*fields)).alias("one")), "kinds")
        often = staged(kinds.where("n > 1").select("a", "s", "s2", "parts"), "often")
        found = salted_join(parts.where("n = 1").drop("n"), often, ["a", "s", "s2"], "parts", F.xxhash64("d", "first")).select("d", F.col("first").alias("start"), (F.col("first") + F.col("more") + length).alias("end"))
        groups = staged(kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("a", "kinds"), "open")
        left = staged(salted_join(kinds.drop("parts"), groups, ["a"], "kinds", F.col("s")).select("a", "s", "s2", "n", "kinds", "one.*"), "pieces")
        found = found.union(_indexed_marks(left.where(F.col("kinds") <= MOST_SPANS), length))
        marks = found if marks is None else marks.union(found)
        pieces = left.where(F.col("kinds") > MOST_SPANS)
    return marks


def repeated_marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, start, end): ranges of bytes of the texts (d, text) covered by strings that also start elsewhere; ranges may overlap. Equal rows have equal keys d."""
    spans, kind, place = span_table(docs, length), ["a", "s", "s2"], F.xxhash64("d", "first")
    anchors = spans.groupBy("a").agg(F.count("*").alias("times"), *[f(c).alias(f"{n}_{c}") for c in ("s", "s2") for n, f in (("lo", F.min), ("hi", F.max))]).where("times > 1")
    shared = staged(anchors.select("a", "times", ((F.col("lo_s") != F.col("hi_s")) | (F.col("lo_s2") != F.col("hi_s2"))).alias("differ")), "shared")
    rows = staged(salted_join(spans, shared, ["a"], "times", place).drop("times"), "spans")
    end = F.col("first") + F.col("more") + length
    same = rows.where("NOT differ").select("d", F.col("first").alias("start"), end.alias("end"))

    kinds = staged(rows.where("differ").groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("d", "first", "more", "rel")).alias("one")), "kinds")
    repeated = kinds.where("n > 1").select(*kind, "n")
    whole = salted_join(rows.where("differ"), repeated, kind, "n", place).select("d", F.col("first").alias("start"), end.alias("end"))

    # one span of each kind, for anchors with a kind that occurs once
    open_anchors = staged(kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("least = 1").select("a", "kinds"), "open")
    wanted = salted_join(kinds, open_anchors, ["a"], "kinds", F.col("s")).select(*kind, "n", "kinds", "one.*")
    wanted = wanted.groupBy("d").agg(F.collect_list(F.struct(*kind, "n", "kinds", "first", "more", "rel")).alias("spans"))

    def cut(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for d, text, spans_of in zip(batch["d"], batch["text"], batch["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(x["a"], x["s"], x["s2"], d, x["first"], x["more"], x["rel"], x["n"], K - length, 0, raw[x["first"] : x["first"] + x["more"] + length], x["kinds"]) for x in spans_of]
            if out:
                yield pd.DataFrame(out, columns=[*(c.split()[0] for c in PIECE.split(", ")), "kinds"])

    pieces = docs.join(wanted.hint("shuffle_merge"), "d").select("d", "text", "spans").mapInPandas(cut, f"{PIECE}, kinds long")
    pieces = staged(pieces.dropDuplicates(kind), "pieces")
    marks = _indexed_marks(pieces.where(F.col("kinds") <= MOST_SPANS), length)
    crowded = _crowded_marks(pieces.where(F.col("kinds") > MOST_SPANS), length)
    return same.union(whole).union(marks) if crowded is None else same.union(whole).union(marks).union(crowded)


def _merged(ranges) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and `removed`, the maximal ranges as array<struct<start,end>>.

    Texts are UTF-8 bytes, null is empty; texts shorter than `length` lose nothing. Two rows with one id, or without,
    are two documents; if their texts are equal each repeats the other. Other columns do not matter. An empty table
    gives an empty result. Inside, a document is known by a 128-bit digest of its id and text, so that rows without id
    are searched like others and equal rows share their ranges.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    base = own.select(F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(" "), F.col("text")).cast("binary"))).alias("d"), "id", "text")
    marks = repeated_marks(base.select("d", "text").where(F.octet_length("text") >= length), length)
    by_doc = marks.distinct().groupBy("d").agg(F.collect_list(F.struct("start", "end")).alias("marks"))

    def cut(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for i, text, ranges in zip(batch["id"], batch["text"], batch["marks"]):
                raw = text.encode("utf-8", "surrogatepass")
                gone = _merged(ranges) if ranges is not None else []
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((None if i is None or i != i else int(i), len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            if out:
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]).astype({"id": "Int64"})

    out = base.join(by_doc.hint("shuffle_merge"), "d", "left").select(F.col("id").cast("string").alias("id"), "text", "marks")  # as text: pandas would make nulls of integers floats
    return out.mapInPandas(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)
