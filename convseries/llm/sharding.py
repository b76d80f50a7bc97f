"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to 2**BITS cells of about equal numbers of rows: amounts over a grid of their binary length and
next four bits, values by their order where they are frequent (one in 65,536 rows or more, so that the table of them is
bounded) and by a hash where they are not. Cells are looked up, never shuffled for. The curve's index comes from a finite
automaton: at each bit of the cells, its state and the cell's corner give the next digit and state. Rows are sorted by
index over a range partitioning, numbered there, and the order is cut into runs whose row counts differ by one at most.
Rows that are alike in all dimensions stand together, so a shard spans small ranges of every dimension, and a filter on
any of them leaves most shards unread. Only built-in functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convseries.llm.common import small_checkpoint, staged
from convseries.operators.ranking import global_rank

#: Cells of a dimension are 2**BITS.
BITS = 8
#: Values in at least this part of the rows have a cell by order.
FREQUENT = 65_536


@dataclass(frozen=True)
class Dimension:
    """A column to shard by: an amount (a whole number; below 0 counts as 0) or a value of any other kind."""

    column: str
    amount: bool = False


def _grid(x: Column) -> Column:
    """The cell of an amount in a grid with 16 cells for each doubling: its bits and the next four behind the first; at most 1,024."""
    x = F.greatest(x.cast("long"), F.lit(0).cast("long"))
    bits = F.length(F.bin(x))
    return bits * 16 + F.call_function("shiftright", x, F.greatest(bits - 5, F.lit(0))).bitwiseAND(15).cast("int")


def _key(d: Dimension) -> Column:
    col = F.col(f"`{d.column}`")
    return F.format_string("%05d", _grid(col)) if d.amount else col.cast("string")


def curve_automaton(n: int) -> tuple[list[int], int]:
    """The Hilbert curve in n dimensions as a table, and the bits of a state: entry (state << n | corner) holds digit << state bits | next state.

    A state is the corner at which the curve enters a cube and the axis along which it leaves it. Turned to the standard
    cube, the corners are passed in the order of the binary-reflected Gray code; each part is entered and left where its
    neighbours are.
    """
    full = (1 << n) - 1
    left = lambda b, k: (b << k % n | b >> (n - k % n)) & full
    gray = lambda i: i ^ i >> 1
    ones = lambda i: (~i & i + 1).bit_length() - 1
    order = {gray(i): i for i in range(1 << n)}
    entry = [0 if w == 0 else gray((w - 1) // 2 * 2) for w in range(1 << n)]
    axis = [0 if w == 0 else ones(w - 1 + w % 2) % n for w in range(1 << n)]
    bits = (n * (full + 1) - 1).bit_length()
    table = [0] * (1 << bits + n)
    for enter in range(1 << n):
        for along in range(n):
            for corner in range(1 << n):
                digit = order[left(corner ^ enter, n - (along + 1) % n)]
                state = (enter ^ left(entry[digit], along + 1)) * n + (along + axis[digit] + 1) % n
                table[enter * n + along << n | corner] = digit << bits | state
    return table, bits


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of cells of `bits` bits each, as a long; one to six dimensions."""
    n = len(cells)
    table, state_bits = curve_automaton(n)
    steps = F.array(*[F.lit(x) for x in table])

    def step(seen: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for k, cell in enumerate(cells):
            corner = corner.bitwiseOR(F.shiftleft(F.call_function("shiftright", cell.cast("int"), bit).bitwiseAND(1), k))
        at = F.shiftleft(seen.bitwiseAND((1 << state_bits) - 1), n).cast("int").bitwiseOR(corner)
        return F.shiftleft(F.shiftright(seen, state_bits), state_bits + n).bitwiseOR(F.get(steps, at).cast("long"))

    found = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), step)
    return F.shiftright(found, state_bits)


def dimension_cells(rows: DataFrame, keys: list[str]) -> list[DataFrame]:
    """For each key column of rows, (key, cell) of its frequent values: cells of equal weight in the order of the keys, null first. At most FREQUENT rows each."""
    pairs = F.array(*[F.struct(F.lit(i).alias("d"), F.col(k).alias("key")) for i, k in enumerate(keys)])
    counts = small_checkpoint(rows.select(F.explode(pairs).alias("x")).groupBy("x.d", "x.key").agg(F.count("*").alias("n")))
    total = counts.where("d = 0").agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") * FREQUENT >= total)
    cell = F.expr(f"(sum(n) over (partition by d order by key) * 2 - n) * {1 << BITS} div (2 * sum(n) over (partition by d))").cast("int")
    found = small_checkpoint(frequent.select("d", "key", cell.alias("cell")))
    return [found.where(F.col("d") == i).select("key", "cell") for i in range(len(keys))]


def with_curve(rows: DataFrame, keys: list[str], name: str = "curve") -> DataFrame:
    """rows with the Hilbert index of their key columns. Infrequent values have the cell of their hash."""
    out = rows
    for i, (key, table) in enumerate(zip(keys, dimension_cells(rows, keys))):
        table = table.select(F.col("key").alias(f"_v{i}"), F.col("cell").alias(f"_c{i}"))
        out = out.join(F.broadcast(table), F.col(key).eqNullSafe(F.col(f"_v{i}")), "left")  # at most FREQUENT rows
        out = out.withColumn(f"_c{i}", F.coalesce(F.col(f"_c{i}"), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << BITS)).cast("int")))
    dims = range(len(keys))
    return out.withColumn(name, curve_index([F.col(f"_c{i}") for i in dims])).drop(*[f"{x}{i}" for i in dims for x in ("_v", "_c")])


def cut_runs(rows: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """rows with shard and slot: their order over the whole table, cut into `shards` runs of n / shards rows."""
    ranked = global_rank(rows, order, "_rank")
    n = F.lit(ranked.count())
    place = F.col("_rank") - 1
    shard = F.call_function("div", place * shards, n)
    first = F.call_function("div", shard * n + (shards - 1), F.lit(shards))
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", place - first).drop("_rank")


def hilbert_shards(docs: DataFrame, dimensions: list[Dimension], shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (bytes of the text and one), text_crc32, the dimensions' columns, curve, law, shard, slot, grown_shard.

    The law is `rows`: shards differ by one row at most; grown_shard is null. Rows that tie in curve and id are numbered by
    their checksum and then in any order. Null texts have size 1 and checksum 0. Null ids and null values of a dimension
    are ordinary ones, before the others. Repeated rows are rows. Dimensions that are null throughout say nothing. With fewer
    rows than shards some shards are empty; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [F.col(f"`{d.column}`").alias(f"dim_{d.column}") for d in dimensions]
    keys = [f"_k{i}" for i in range(len(dimensions))]
    own = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text).alias("_crc"), *columns, *[_key(d).alias(k) for k, d in zip(keys, dimensions)])
    placed = with_curve(staged(own, "shard-rows"), keys, "_curve").drop(*keys)
    out = cut_runs(placed, [F.col("_curve"), F.col("_id"), F.col("_crc")], shards)
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), *[f"dim_{d.column}" for d in dimensions], F.col("_curve").alias("curve"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, dimensions: list[Dimension], shards: int, id_col: str = "doc_id") -> None:
    """The rows of docs with all their columns as Parquet, a folder for each shard, in curve order; `manifest` holds rows and the least and largest value of every dimension for each shard."""
    keys = [f"_k{i}" for i in range(len(dimensions))]
    placed = with_curve(docs.select("*", *[_key(d).alias(k) for k, d in zip(keys, dimensions)]), keys, "_curve").drop(*keys)
    ranked = cut_runs(placed, [F.col("_curve"), F.col(f"`{id_col}`")], shards).drop("_curve", "slot")
    ranked.write.partitionBy("shard").parquet(f"{path}/rows")
    ranges = [f(F.col(f"`{d.column}`")).alias(f"{n}_{i}") for i, d in enumerate(dimensions) for n, f in (("min", F.min), ("max", F.max))]
    nulls = [F.count_if(F.col(f"`{d.column}`").isNull()).alias(f"nulls_{i}") for i, d in enumerate(dimensions)]
    ranked.groupBy("shard").agg(F.count("*").alias("rows"), *ranges, *nulls).coalesce(1).write.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, dimensions: list[Dimension], bounds: dict[str, tuple]) -> DataFrame:
    """Rows of written shards with low <= column <= high for each (low, high) of bounds; only shards whose ranges meet all bounds are read."""
    manifest, names = spark.read.parquet(f"{path}/manifest"), [d.column for d in dimensions]
    may, holds = F.lit(True), F.lit(True)
    for column, (low, high) in bounds.items():
        i = names.index(column)
        may = may & (F.col(f"max_{i}") >= low) & (F.col(f"min_{i}") <= high)
        holds = holds & F.col(f"`{column}`").between(low, high)
    hits = [r.shard for r in manifest.where(may).select("shard").toLocalIterator()]  # as many as there are shards
    return spark.read.parquet(f"{path}/rows").where(F.col("shard").isin(hits) & holds).drop("shard")
