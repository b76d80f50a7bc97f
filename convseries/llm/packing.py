"""Packing documents into sequences of a fixed number of tokens: dominance reduction, then best fit.

Only the number of pieces of each length matters for the packing, so the instance is a histogram with at most
`capacity` rows, whatever the corpus. Sets of up to three lengths that provably dominate all alternatives for their
largest piece (Martello and Toth's criterion) are fixed, as many times as the counts allow; best fit by decreasing
length packs the rest, again whole classes of equal sequences at a time. The plan is a list of slots (length, first
rank, number, first sequence, offset). Spark numbers the pieces of each length, salted, and every piece looks its slot
up by its number.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convseries.llm.common import staged
from convseries.llm.tokens import encoded_texts


def dominant_sets(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets and takes them out of counts (counts[x]: pieces of length x). Returns (lengths, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...]) -> None:
        kinds = {x: lengths.count(x) for x in lengths}
        times = min(int(counts[x]) // k for x, k in kinds.items())
        for x, k in kinds.items():
            counts[x] -= k * times
        fixed.append((lengths, times))

    for size in range(capacity, 0, -1):
        while counts[size] > 0:
            room = capacity - size
            left = counts[: room + 1].copy()
            if size <= room:
                left[size] -= 1
            there = np.flatnonzero(left)
            if not len(there):  # nothing fits beside it
                fix((size,))
                continue
            largest = int(there[-1])
            smallest = np.repeat(there[:3], np.minimum(left[there[:3]], 3))[:3]
            if largest == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:  # it fills up, or only one fits
                fix((size, largest))
                continue
            if len(smallest) > 2 and smallest[:3].sum() <= room:  # more than two fit: no proof with small sets
                break
            pairs = [(int(a + b), int(a), int(b)) for a in there for b in [_partner(left, there, int(a), room)] if b]
            best = max(pairs)
            if largest >= best[0]:
                fix((size, largest))
            elif best[1] == largest and max(b for _, _, b in pairs) <= best[2]:
                fix((size, best[1], best[2]))
            else:
                break
    return fixed


def _partner(left: np.ndarray, there: np.ndarray, a: int, room: int) -> int:
    """The largest length up to a that fits beside a, or 0."""
    fits = there[(there <= min(a, room - a)) & ((there != a) | (left[there] > 1))]
    return int(fits[-1]) if len(fits) else 0


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit by decreasing length over classes of equal sequences. Returns (((length, copies), ...), times).

    A length changes at most one class beyond those that it fills completely, so there are at most about four classes
    for each length."""
    bins: dict[int, list] = {}  # room left -> [[contents, times], ...]
    rooms = np.zeros(capacity + 1, np.int64)  # sequences with that room

    def add(room: int, contents: tuple, times: int) -> None:
        if times:
            bins.setdefault(room, []).append([contents, times])
            rooms[room] += times

    for size in range(capacity, 0, -1):
        n = int(counts[size])
        counts[size] = 0
        while n:
            fits = np.flatnonzero(rooms[size:])
            room = size + int(fits[0]) if len(fits) else capacity
            if len(fits):
                contents, times = bins[room][-1]
            else:
                contents, times = (), n
            each = room // size
            full, rest = min(times, n // each), 0
            if full < times and (n - full * each) > 0:
                rest = n - full * each
            if len(fits):
                bins[room].pop()
                rooms[room] -= times
                add(room, contents, times - full - (rest > 0))
            add(room - each * size, contents + ((size, each),), full)
            if rest:
                add(room - rest * size, contents + ((size, rest),), 1)
            n -= full * each + rest
    return [(contents, times) for classes in bins.values() for contents, times in classes]


def plan_slots(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Slots sorted by (length, rank): pieces number rank .. rank + number - 1 of a length go to sequences from `sequence` on, at `offset`. Also `fixed` and `sequences`, two totals."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    fixed = dominant_sets(counts, capacity)
    classes = [(tuple((x, 1) for x in lengths), times) for lengths, times in fixed] + best_fit(counts, capacity)
    rows, ranks, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for contents, times in classes:
        offset = 0
        for length, copies in contents:
            for _ in range(copies):
                rows.append((length, int(ranks[length]), sequence, offset))
                ranks[length] += times
                offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "fixed": np.int64(sum(t for _, t in fixed)), "sequences": np.int64(sequence)}


def token_pieces(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every text with end_id, cut into pieces of capacity: (id, piece, start, length, ids_crc32)."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            ids = np.asarray(batch.column(0).is_null()), np.asarray(batch.column(0).fill_null(0))
            for row, flat, first in encoded_texts(batch.column(1), tokenizer, kind, end_id):
                size = np.diff(first)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                at = first[doc] + start
                raw = memoryview(flat.astype("<u4", copy=False)).cast("B") if len(flat) else memoryview(b"")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at + length)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[1][row + doc], pa.int64(), mask=ids[0][row + doc]), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces plus rank: their numbers from 0 within each length. A length's pieces are dealt to salts, numbered within each and moved up by the salts before."""
    salts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    sizes = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    placed = rows.withColumn("at", F.row_number().over(own) - 1).join(bases, ["length", "salt"])
    return placed.withColumn("rank", F.col("base") + F.col("at")).drop("salt", "base", "at")


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and give a piece with end_id alone. Repeated rows and ids are packed as often as they occur.
    An empty table gives an empty result. The histogram that the driver reads has at most `capacity` rows.
    """
    pieces = staged(token_pieces(docs, tokenizer, kind, end_id, capacity, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(plan_slots(histogram, capacity))

    def place(batches):
        slots = plan.value
        keys = slots["length"] << 44 | slots["rank"]
        for rows in batches:
            length, rank = rows["length"].to_numpy(), rows["rank"].to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            rows["sequence_id"] = slots["sequence"][at] + rank - slots["rank"][at]
            rows["offset"] = slots["offset"][at]
            yield rows.drop(columns="rank")

    out = numbered(pieces).select("id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInPandas(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
