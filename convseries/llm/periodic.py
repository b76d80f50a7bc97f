"""Periodic run detection by recursive frequency splitting.

A run of smallest period q and at least `exponent` periods holds each of its words `exponent` times or more. So a word that
is rarer in its segment is in no run, and splits it; the pieces, in which words are rarer still, are split again until no
word is too rare. A lag scan then finds the runs of the segments that are left. It looks at windows of 1, 2, 4, ... words
and the distance of each window to its next occurrence: in a run of period q, that is q for every window of q words or more
(a period that is the smallest one occurs in its own repetition only at multiples of itself), so each run is one stretch of
windows with the same lag q at the window length W with q <= W < 2 q. Windows that stand once in their segment, and those
that begin with one, are left out from there on; a text of n words takes time in n log(n)^2, whatever its periods.

All texts of a chunk are split and scanned together; texts never meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convseries.llm.common import text_chunks, word_bounds, word_numbers, word_strings

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def split_segments(word: np.ndarray, text: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and segment numbers of the words that are left when no segment has a word that is rarer than `exponent` and none is shorter than `shortest`. word: a number for each word; text: which text it stands in."""
    place, segment = np.arange(len(word)), text
    done: list[np.ndarray] = []
    width = int(word.max()) + 1 if len(word) else 1
    while len(place):
        _, which, counts = np.unique(segment * width + word[place], return_inverse=True, return_counts=True)
        often = counts[which] >= exponent
        # segments that lose no word are stable
        loses = np.zeros(int(segment[-1]) + 1, bool)
        loses[segment[~often]] = True
        if len(stable := place[~loses[segment]]):
            done.append(stable)
        left = often & loses[segment]
        place, segment = _pieces(place[left], segment[left], shortest)
    if not done:
        return place, place
    place = np.sort(np.concatenate(done))
    return _pieces(place, text[place], shortest)


def _pieces(place: np.ndarray, segment: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the unbroken pieces of segments that have `shortest` words or more, with their numbers from 0."""
    if not len(place):
        return place, place
    begins = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])])
    piece = np.cumsum(begins) - 1
    long_enough = np.bincount(piece)[piece] >= shortest
    return place[long_enough], np.unique(piece[long_enough], return_inverse=True)[1]


def scan_lags(word: np.ndarray, place: np.ndarray, segment: np.ndarray, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (a place), length and period of every run of the segments, by start, then period."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, window = len(place), 1
    # window[i] is a number for the words i to i + window - 1 of the segment, -1 where it stands once or would cross its end
    number = np.unique(segment * (int(word.max()) + 1 if len(word) else 1) + word[place], return_inverse=True)[1]
    active = np.arange(n)
    while len(active):
        order = active[np.argsort(number[active], kind="stable")]
        again = np.flatnonzero(number[order[1:]] == number[order[:-1]])
        at, lag = order[again], order[again + 1] - order[again]
        fits = (lag <= window) & (2 * lag > window)
        by_place = np.argsort(at[fits])
        at, lag = at[fits][by_place], lag[fits][by_place]
        begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1]) | (segment[at[1:]] != segment[at[:-1]])])) if len(at) else at
        start, period = at[begins], lag[begins]
        length = np.diff(np.append(begins, len(at))) + window - 1 + period
        ok = length >= np.maximum(shortest, exponent * period)
        found.append((place[start[ok]], length[ok], period[ok]))
        # windows twice as long, where both halves stand in the segment more than once
        repeated = np.zeros(n, bool)
        repeated[order[again]] = repeated[order[again + 1]] = True
        active = np.flatnonzero(repeated)
        other = active + window
        inside = other < n
        active, other = active[inside], other[inside]
        both = repeated[other] & (segment[other] == segment[active])
        active, other = active[both], other[both]
        pairs = np.unique(number[active] * (int(number.max()) + 1) + number[other], return_inverse=True)[1]
        number = np.full(n, -1)
        number[active] = pairs
        window *= 2
    start, length, period = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """One row per document: id, runs (start, length, period; in words, by start, then period), collapsed.

    Words are what white space (blank, \\t to \\r) leaves. A run is a stretch of words with smallest period q, at least
    `exponent` * q and `shortest` words long, that no neighbour extends; exponent is 3 at least. The collapsed text has
    the words that no run contains after its first q words, joined by one space. Null and wordless texts have no runs and
    an empty collapsed text. Rows are handled one by one: null and repeated ids stay as they are; other columns are not
    read. An empty table gives an empty result.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            for row, buf, offsets in text_chunks(batch.column(1)):
                starts, ends = word_bounds(buf, offsets)
                first = np.searchsorted(starts, offsets)  # of each text
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                word = word_numbers(buf, starts, ends)
                place, segment = split_segments(word, text, exponent, shortest)
                start, length, period = scan_lags(word, place, segment, exponent, shortest)
                # how many runs drop a word
                drops = np.zeros(len(word) + 1, np.int64)
                np.add.at(drops, start + period, 1)
                np.add.at(drops, start + length, -1)
                stays = np.cumsum(drops)[:-1] == 0
                sizes = np.diff(np.concatenate([[0], np.cumsum(stays)])[first])
                of = np.searchsorted(first, start, side="right") - 1
                runs = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first).astype(np.int32)), runs)
                collapsed = word_strings(buf, starts[stays], ends[stays], sizes).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), runs, collapsed], names=["id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(find, f"id long, runs {RUNS}, collapsed string").select(F.col("id").alias(id_col), "runs", "collapsed")
