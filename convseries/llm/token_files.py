"""Token files: flat little-endian unsigned ids, and 64-bit document offsets beside them.

Ids take 16 bits where the vocabulary has at most 65,536 of them, else 32; the width stands in the parts table. A
folder holds, for each part p, `p.ids` (the ids of its documents, one after another), `p.offsets` (int64: where each
document begins in `p.ids`, and the end) and `p.docs` (int64: the document ids). Parts follow each other in ascending
document id. The ids before a part, its base, come from prefix sums over the parts' totals: one row for each part.
A document's global start is its part's base plus its offset. Parts are written under a name of their own and renamed,
so that a task that is run again, or twice, leaves the same files.
"""

from __future__ import annotations

import contextlib
import os
import uuid
import zlib
from itertools import chain
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convseries.llm.common import new_folder, small_checkpoint
from convseries.llm.tokens import encoded_texts, encoder

#: What stands for a null document id in `p.docs`.
NO_ID = -(2**63)
#: Documents that a batch of the reader holds.
ROWS = 10_000


def _local(uri: str) -> str | None:
    """The path, if the folder is a mounted one."""
    found = urlparse(uri)
    return found.path if found.scheme in ("", "file") else None


@contextlib.contextmanager
def new_file(uri: str):  # noqa: ANN201
    """A file to append to under a name of its own; it takes its own name when all is written, and there is none otherwise."""
    path, name = _local(uri), f".{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + name, "wb") as f:
            yield f
        os.replace(path + name, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path + name) as f:
        yield f
    store.move(path + name, path)


def map_file(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where it is mounted, else read from the store."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text, with end_id after each, and returns the parts as (part, width, n_docs, n_ids, base).

    Null texts are empty and give end_id alone. Ties of the id are ordered by text; null ids come first and are stored
    as NO_ID. An empty table gives no parts.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        width = 2 if max(encoder(tokenizer, kind).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        name, n_docs, n_ids = f"{folder}/part-{part:06d}", 0, 0
        first_batch = next((b for b in batches if b.num_rows), None)
        if first_batch is None:
            return
        with new_file(f"{name}.ids") as ids, new_file(f"{name}.offsets") as offsets, new_file(f"{name}.docs") as names:
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in chain([first_batch], batches):
                names.write(np.asarray(batch.column(0).cast(pa.int64()).fill_null(NO_ID)).astype("<i8").tobytes())
                for _, flat, first in encoded_texts(batch.column(1), tokenizer, kind, end_id):
                    ids.write(memoryview(flat.astype(f"<u{width}", copy=False)).cast("B"))
                    offsets.write((n_ids + first[1:]).astype("<i8").tobytes())
                    n_docs, n_ids = n_docs + len(first) - 1, n_ids + int(first[-1])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "width": pa.array([width], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    parts = small_checkpoint(ordered.mapInArrow(write, "part long, width int, n_docs long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(parts: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every document in the files as (id, start, n_tokens, ids_crc32), over memory-mapped files; a task for each part."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            for part, width, base in zip(batch["part"], batch["width"], batch["base"]):
                name = f"{folder}/part-{part:06d}"
                ids, offsets, docs = map_file(f"{name}.ids", f"<u{width}"), map_file(f"{name}.offsets", "<i8"), map_file(f"{name}.docs", "<i8")
                for at in range(0, len(docs), ROWS):
                    own, ends = docs[at : at + ROWS], offsets[at : at + ROWS + 1]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(ends[:-1], ends[1:])]
                    yield pd.DataFrame({"id": pd.arrays.IntegerArray(np.array(own, np.int64), np.asarray(own == NO_ID)), "start": base + ends[:-1], "n_tokens": np.diff(ends), "ids_crc32": np.array(crc, np.int64)})

    # the number is given, so that the tasks are not put together for their small rows: each opens a file
    found = parts.select("part", "width", "base").repartition(max(1, parts.count())).mapInPandas(read, "id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumnRenamed("id", id_col)


def token_file_digests(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the files (to a new folder in the shared one by default) and reads them back."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, kind, end_id, id_col, text_col), folder, id_col)
