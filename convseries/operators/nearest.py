"""An exact k-nearest-neighbour join over pivots.

Pivots are context rows. Both sides go to the cell of their nearest pivot. The context's k smallest distances in each cell
bound how far the k nearest of any asked row of a cell can be, and the triangle inequality says which context rows can be
that near: only they are sent to the cell. Inside a cell, rows are sorted by their distance to the pivot, and only those
are compared that this distance leaves possible. Cells with many rows are cut into chunks and blocks, so a task holds at
most about ROWS of each side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convseries.operators.ranking import kept

#: Rows of each side that a task holds, and the most pivots (their features go to every task; a matrix of their distances stays on the driver).
ROWS, MOST_PIVOTS = 5_000, 512
#: Asked rows that are compared at a time, and rows that meet the pivots at a time.
STEP, PLACED = 128, 1_000
#: Rounding of distances, in parts of their size.
SLACK = 1e-9


def matrix(column) -> np.ndarray:  # noqa: ANN001
    """A column of lists as a matrix of doubles."""
    return np.vstack(column.to_numpy()).astype(float)


def squared_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By products; exact to rounding of the squared lengths."""
    return np.maximum(0.0, (x**2).sum(axis=1)[None, :] - 2 * q @ x.T + (q**2).sum(axis=1)[:, None])


def nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of x for each of q and their squared distances, ties by position. Products find the candidates; their distances are then summed up point by point, so that equal rows tie in any block."""
    d = squared_distances(q, x)
    k = min(k, len(x))
    if np.isnan(d).any():
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        return near, np.take_along_axis(d, near, axis=1)
    size = (x**2).sum(axis=1).max(initial=0.0) + (q**2).sum(axis=1)
    rows, cols = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + (1e-13 * size)[:, None])
    exact = ((q[rows] - x[cols]) ** 2).sum(axis=1)
    order = np.lexsort((cols, exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    at = np.searchsorted(rows, np.arange(len(q)))[:, None] + np.arange(k)
    return cols[at], exact[at]


def choose_pivots(context: DataFrame, n: int) -> np.ndarray:
    """About sqrt(n) context rows, MOST_PIVOTS at most, by the hash of their id."""
    most = min(MOST_PIVOTS, max(1, int(np.sqrt(n))))
    return np.array([r[0] for r in context.orderBy(F.xxhash64("id"), "id").limit(most).select("features").collect()], float)


def _parts(batches):  # noqa: ANN001, ANN202
    """The rows of pandas batches, PLACED at a time, so that a worker holds no more than PLACED x MOST_PIVOTS distances."""
    return (batch.iloc[at : at + PLACED] for batch in batches for at in range(0, len(batch), PLACED))


def with_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """df (..., features) plus cell, the nearest pivot, and reach, the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):  # noqa: ANN001, ANN202
        for batch in _parts(batches):
            near, d = nearest(matrix(batch["features"]), shared.value, 1)
            yield batch.assign(cell=near[:, 0].astype(np.int32), reach=np.sqrt(d[:, 0]))

    return df.mapInPandas(place, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())]))


def cell_bounds(context: DataFrame, asked: DataFrame, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most reach with which a context row of cell j can be among the k nearest of an asked row of cell i: two pivots x pivots matrices. Cells without asked rows take nothing."""
    from pyspark.sql import Window

    n = len(pivots)
    apart = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) if pivots.shape[1] * n * n < 1 << 26 else np.sqrt(squared_distances(pivots, pivots))
    first = context.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("reach"))).where(F.col("r") <= k)
    reaches, radius = np.full((n, k), np.inf), np.full(n, -np.inf)
    for r in first.select("cell", "r", "reach").collect():  # pivots x k rows
        reaches[r.cell, r.r - 1] = r.reach
    for r in asked.groupBy("cell").agg(F.max("reach").alias("reach")).collect():
        radius[r.cell] = r.reach
    least, most = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    for i in np.flatnonzero(radius != -np.inf):
        far = (radius[i] + apart[i][:, None] + reaches).ravel()
        limit = np.partition(far, min(k, len(far)) - 1)[min(k, len(far)) - 1]
        slack = SLACK * (apart[i] + radius[i] + (limit if np.isfinite(limit) else 0.0) + 1.0)
        least[i], most[i] = apart[i] - radius[i] - limit - slack, apart[i] + radius[i] + limit + slack
    return least, most


def _targets(cells: np.ndarray, reach: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and asked cell of each place that context rows are sent to."""
    return np.nonzero(~((reach[:, None] < least[:, cells].T) | (reach[:, None] > most[:, cells].T)))


def _in_cell(own, block, k: int, pivot: np.ndarray):  # noqa: ANN001, ANN202
    """(row, other, d, label, compared) for the asked and the context rows of one cell."""
    import pandas as pd

    x = matrix(block["features"])
    a = np.sqrt(((x - pivot) ** 2).sum(axis=1))
    order = np.lexsort((block["id"].to_numpy(), a))
    x, a, ids, labels = x[order], a[order], block["id"].to_numpy()[order], block["label"].to_numpy()[order]
    own = own.iloc[np.argsort(own["reach"].to_numpy(), kind="stable")]
    found = []
    for at in range(0, len(own), STEP):
        part = own.iloc[at : at + STEP]
        q, reach = matrix(part["features"]), part["reach"].to_numpy()
        # rows whose distance to the pivot is alike give a first bound
        mid = np.searchsorted(a, np.median(reach))
        lo, hi = max(0, mid - 2 * k - 8), min(len(a), mid + 2 * k + 8)
        compared = (hi - lo) * len(q)
        bound = np.sqrt(nearest(q, x[lo:hi], k)[1][:, -1]) if hi - lo >= k else np.full(len(q), np.inf)
        slack = SLACK * (bound + reach + 1.0)
        lo, hi = (int(np.searchsorted(a, np.min(reach - bound - slack))), int(np.searchsorted(a, np.max(reach + bound + slack), side="right"))) if np.isfinite(bound).all() and np.isfinite(a).all() else (0, len(a))
        # by id, so that ties go to the smallest
        by_id = lo + np.argsort(ids[lo:hi], kind="stable")
        near, d = nearest(q, x[by_id], k)
        compared += (hi - lo) * len(q)
        m, near = near.shape[1], by_id[near]
        counts = np.zeros(len(q) * m, np.int64)
        counts[:1] = compared
        found.append(pd.DataFrame({"row": np.repeat(part["row"].to_numpy(), m), "other": ids[near.ravel()], "d": d.ravel(), "label": labels[near.ravel()], "compared": counts}))
    return pd.concat(found)


NEAR = "row long, other long, d double, label string, compared long"


def near_rows(context: DataFrame, asked: DataFrame, k: int, n_context: int) -> DataFrame:
    """(row, other, d, label, compared): among others the k nearest context rows (id, label, features) of every asked row (row, features), with squared distances; compared counts the pairs that were looked at."""
    import pandas as pd

    pivots = choose_pivots(context, n_context)
    context, asked = kept(with_cells(context, pivots)), kept(with_cells(asked, pivots))
    least, most = cell_bounds(context, asked, pivots, k)
    bounds = context.sparkSession.sparkContext.broadcast((least, most))

    def counts(batches):  # noqa: ANN001, ANN202
        total = np.zeros(len(pivots), np.int64)
        for batch in _parts(batches):
            total += np.bincount(_targets(batch["cell"].to_numpy(), batch["reach"].to_numpy(), *bounds.value)[1], minlength=len(pivots))
        yield pd.DataFrame({"to": np.arange(len(pivots)), "n": total})

    def send(batches):  # noqa: ANN001, ANN202
        for batch in _parts(batches):
            rows, to = _targets(batch["cell"].to_numpy(), batch["reach"].to_numpy(), *bounds.value)
            for at in range(0, len(rows), PLACED):
                yield batch.iloc[rows[at : at + PLACED]].drop(columns=["cell", "reach"]).assign(to=to[at : at + PLACED].astype(np.int32))

    parts = lambda table, key: {r[key]: max(1, -(-r["n"] // ROWS)) for r in table.collect()}  # noqa: E731  a row per pivot
    blocks = parts(context.select("cell", "reach").mapInPandas(counts, "to int, n long").groupBy("to").agg(F.sum("n").alias("n")), "to")
    chunks = parts(asked.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    of = lambda found, cell: F.get(F.array(*[F.lit(found.get(i, 1)) for i in range(len(pivots))]), cell)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), of(chunks, F.col("cell"))).cast("int")).withColumn("block", each(of(blocks, F.col("cell"))))
    right = context.mapInPandas(send, "id long, label string, features array<double>, to int").withColumnRenamed("to", "cell")
    right = right.withColumn("block", F.pmod(F.xxhash64("id"), of(blocks, F.col("cell"))).cast("int")).withColumn("chunk", each(of(chunks, F.col("cell"))))
    shared = context.sparkSession.sparkContext.broadcast(pivots)

    def near(own, block):  # noqa: ANN001, ANN202
        if not len(own) or not len(block):
            return pd.DataFrame({c.split()[0]: pd.Series(dtype="object" if c.endswith("string") else "float64" if c.endswith("double") else "int64") for c in NEAR.split(", ")})
        return _in_cell(own, block, k, shared.value[int(own["cell"].iloc[0])])

    keys = ["cell", "chunk", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(near, NEAR)


def nearest_join(context: DataFrame, asked: DataFrame, k: int, n_context: int) -> DataFrame:
    """(row, near): for each asked row (row, features) the k nearest context rows (id, label, features) as structs (d, other, label), by squared distance, then id; fewer only if the context has fewer."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("d", "other", "label"))), 1, k)  # k rows for each block
    return near_rows(context, asked, k, n_context).groupBy("row").agg(best.alias("near"))
