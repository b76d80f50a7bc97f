"""Quality rules with risk-controlled thresholds.

Each document has five signals. A rule is a cutoff for each of them and rejects what is at or above any. Each stratum
(language) has one sequence of rules, mild to strict, each with one cutoff a grid cell lower than the one before; it is
ordered by the bad labelled rows (label 0) and the documents without label, so it does not depend on the good rows
(label 1) that it is tested on. An exact binomial bound says how likely so few false rejections (good rows that a rule
rejects by any signal) would be if the true rate exceeded the allowed one; rules are tried in their order and the last
before the first failure is taken (fixed-sequence testing), with Bonferroni's correction over strata. With probability
of at least 1 - delta, every stratum then rejects at most `risk` of its good documents, over all signals together.
Good rows with one text are one trial, for they share their fate; near copies still count as trials of their own.
Strata with too few good rows (217 with four strata) reject nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convseries.llm.common import WHITE, per_key, small_checkpoint, staged

SIGNALS = ("symbols", "dup_lines", "repeats", "short_words", "long_words")
SYMBOLS = "#*$%&|<>"
#: Cells of the cutoff grid of each signal, which runs from 0 to 1.
GRID = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class RiskControl:
    """risk: most good documents falsely rejected in a stratum; delta: probability that any bound fails."""

    risk: float = 0.02
    delta: float = 0.05


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated three-word windows, lines with a word; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split cuts at exactly the six white-space characters
    chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen, last = Counter(windows), -1
        for k, window in enumerate(windows):
            if seen[window] > 1:
                repeats += k + 2 - max(k - 1, last)
                last = k + 2
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in COUNTS]))
def counts_udf(texts):  # noqa: ANN001, ANN201
    import pandas as pd

    return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS), dtype="int64")


# not to be run again for each expression that uses its result
counts_udf = counts_udf.asNondeterministic()


def counted(rows: DataFrame, name: str = "quality") -> DataFrame:
    """rows (id, stratum, text, ...) with the base counts, base_failed and a digest of the text in its place, written once: the counting runs once for each row."""
    found = rows.withColumn("counts", counts_udf(F.col("text"))).withColumn("text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).drop("text")
    failed = (F.col("counts.n_words") < 50) | (100 * F.col("counts.n_repeat_words") > 50 * F.col("counts.n_words"))
    return staged(found.withColumn("base_failed", failed), name)


def signals() -> dict[str, Column]:
    """The signals from the base counts, each from 0 (good) to 1."""
    c = lambda n: F.col(f"counts.{n}").cast("double")
    part = lambda a, b: F.least(F.lit(1.0), a / F.greatest(b, F.lit(1.0)))
    mean = c("word_chars") / F.greatest(c("n_words"), F.lit(1.0))
    return {
        "symbols": part(c("n_symbols") * 2, c("word_chars")),
        "dup_lines": part(c("n_dup_lines"), c("n_lines")),
        "repeats": part(c("n_repeat_words"), c("n_words")),
        "short_words": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(5.0) - mean) / 5.0)),
        "long_words": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean - F.lit(5.0)) / 20.0)),
    }


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial, summed exactly in logarithms."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    steps = np.concatenate([[0.0], np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1.0)))])
    terms = steps + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def choose_cutoff(cells: np.ndarray, good: np.ndarray, risk: float, delta: float, grid: int = GRID) -> float:
    """The strictest cutoff (a cell of the grid) that passes with all milder ones; grid + 1 (none) if none does.

    cells and good: grid cells with good rows and their numbers. A cutoff c rejects the cells >= c."""
    per_cell = np.zeros(grid + 2, np.int64)
    np.add.at(per_cell, cells, good)
    n, above, best = int(per_cell.sum()), 0, grid + 1
    for c in range(grid, 0, -1):
        above += int(per_cell[c])
        if not n or log_binomial_cdf(above, n, risk) > math.log(delta):
            break
        best = c
    return float(best)


def rule_steps(bad: np.ndarray, free: np.ndarray, weight: float = 0.02) -> list[tuple[int, int]]:
    """The sequence of joint rules as steps (signal, its new cutoff), mild to strict.

    bad and free: rows by signal and cell, labelled bad and without label. For each signal, the shares of both at or
    above a cutoff give a curve, which is cut into the pieces that gain most bad rows for a document; `weight` is added
    to both shares, so that a few rows do not come before many. Pieces are taken best first over all signals, as long
    as bad rows are caught more often than others. Without rows of either kind all cutoffs go down together."""
    if not bad[0].sum() or not free[0].sum():
        return [(s, c) for c in range(GRID, 0, -1) for s in range(len(bad))]
    pieces = []
    for s in range(len(bad)):
        y, x = (np.concatenate([[0.0], np.cumsum(v[s][:0:-1]) / v[s].sum()]) for v in (bad, free))  # at cutoffs GRID + 1, GRID, ..., 1
        at, slope = 0, np.inf
        while at < GRID:
            gain = (y[at + 1 :] - y[at] + weight) / (x[at + 1 :] - x[at] + weight)
            if gain.max() <= 1:
                break
            end, slope = at + 1 + int(gain.argmax()), min(slope, gain.max())
            pieces += [(-slope, s, GRID + 1 - k) for k in range(at + 1, end + 1)]
            at = end
    return [(s, c) for _, s, c in sorted(pieces, key=lambda piece: piece[0])]


def calibrate(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", control: RiskControl = RiskControl()) -> DataFrame:
    """Cutoffs as (stratum, signal, cutoff) from all counted rows that pass the base rules.

    Null labels and ids are left out; of repeated ids, and of good rows with one text, the smallest label counts. The
    histogram that rules are ordered by has at most GRID + 1 rows for each stratum and signal, the one they are tested on
    a row for each step, and each stratum is its own group.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("_label"))
    cell = lambda x: F.floor(x * GRID).cast("int")
    rows = staged(rows.where("NOT base_failed").select("id", "stratum", "text_key", *[cell(x).alias(s) for s, x in signals().items()]), "quality-cells")
    labelled = rows.join(known, "id")
    long = lambda df, *more: df.select("stratum", *more, F.posexplode(F.array(*map(F.col, SIGNALS))).alias("signal", "cell"))
    keys = ["stratum", "signal", "cell"]
    every = long(rows).groupBy(*keys).agg(F.count("*").alias("n"))
    marked = long(labelled, "_label").groupBy(*keys).agg(F.count("*").alias("labelled"), F.count_if(F.col("_label") == 0).alias("bad"))
    grid = every.join(marked, keys, "left").select(*keys, F.coalesce("bad", F.lit(0)).alias("bad"), (F.col("n") - F.coalesce("labelled", F.lit(0))).alias("free"))

    def order(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        bad, free = np.zeros((2, len(SIGNALS), GRID + 1), np.int64)
        bad[pdf["signal"], pdf["cell"]] = pdf["bad"]
        free[pdf["signal"], pdf["cell"]] = pdf["free"]
        steps = rule_steps(bad, free)
        first = np.full((len(SIGNALS), GRID + 1), len(steps) + 1)  # the step from which on a cell is rejected
        for k, (s, c) in enumerate(steps):
            first[s, c] = k + 1
        return pd.DataFrame({"stratum": [pdf["stratum"][0]], "signals": [[s for s, _ in steps]], "cutoffs": [[c for _, c in steps]], "first": [first.tolist()]})

    paths = small_checkpoint(grid.groupBy("stratum").applyInPandas(order, "stratum string, signals array<int>, cutoffs array<int>, first array<array<int>>"))
    step = F.least(*[F.get(F.get("first", F.lit(k)), F.col(s)) for k, s in enumerate(SIGNALS)])
    trials = labelled.groupBy("stratum", "text_key", *SIGNALS).agg(F.min("_label").alias("_label")).where("_label = 1")
    good = per_key(trials, paths.select("stratum", "first"), "stratum", F.xxhash64("text_key")).groupBy("stratum", step.alias("step")).agg(F.count("*").alias("good"))
    tested = small_checkpoint(good.groupBy("stratum").agg(F.collect_list(F.struct("step", "good")).alias("found")).join(paths.drop("first"), "stratum"))
    strata = max(1, tested.count())

    def choose(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        row = pdf.iloc[0]
        n_steps = len(row["signals"])
        at = np.array([n_steps + 1 - f["step"] for f in row["found"]])  # strict to mild, 0 for what no rule rejects
        best = choose_cutoff(at, np.array([f["good"] for f in row["found"]]), control.risk, control.delta / strata, n_steps)
        cut = np.full(len(SIGNALS), GRID + 1.0)
        for s, c in list(zip(row["signals"], row["cutoffs"]))[: n_steps + 1 - int(best)]:
            cut[s] = c
        return pd.DataFrame({"stratum": row["stratum"], "signal": SIGNALS, "cutoff": cut})

    return small_checkpoint(tested.groupBy("stratum").applyInPandas(choose, "stratum string, signal string, cutoff double"))


def judge(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The counted rows plus kept: false if the base failed or any signal is at or above its stratum's cutoff. Strata without cutoffs keep all. One row per stratum is joined, by broadcast unless there are very many."""
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("cutoffs"))
    found = per_key(rows, small_checkpoint(wide), "stratum", F.xxhash64("text_key"), "left")
    bad = F.col("base_failed")
    for name, x in signals().items():
        bad = bad | F.coalesce(F.floor(x * GRID) >= F.try_element_at("cutoffs", F.lit(name)), F.lit(False))
    return found.withColumn("kept", ~bad).drop("cutoffs")


def _stratum(stratum_col: str) -> Column:
    return F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")


def quality_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", control: RiskControl = RiskControl()) -> DataFrame:
    """One row per document: id, stratum, base counts, base_failed, kept. Null texts have no words and fail; a null stratum is the empty one; other columns of the documents do not matter; an empty table gives an empty result."""
    rows = counted(docs.select(F.col(id_col).alias("id"), _stratum(stratum_col), F.col(text_col).cast("string").alias("text")))
    out = judge(rows, calibrate(rows, labels, id_col, control=control))
    return out.select(F.col("id").alias(id_col), F.col("stratum").alias(stratum_col), *[F.col(f"counts.{n}").alias(n) for n in COUNTS], "base_failed", "kept")


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", control: RiskControl = RiskControl()) -> DataFrame:
    """The documents that are kept, with all their columns. They are written once with their counts, so that neither the counting nor a shuffle of texts is repeated for the verdict."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = counted(docs.select(row, F.col(id_col).alias("id"), _stratum(stratum_col), F.col(text_col).cast("string").alias("text")))
    return judge(rows, calibrate(rows, labels, id_col, control=control)).where("kept").select("row.*")
