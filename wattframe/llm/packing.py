"""Packing of tokenised documents into fixed windows by online sum of squares.

Each task packs the rows it reads: full windows are cut off a document first, and its rest goes to the fill level that makes
the sum of squared counts of partially filled windows smallest. The level array and the ids of the open windows are all the
state. When a task ends, its open windows are laid out anew one after another with cuts, so it pads one window at most.
There is no shuffle, a task that runs again packs the same rows in the same way, and a window never spans tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wattframe.llm.text import text_slices
from wattframe.llm.tokens import SLICE, TOKENIZER, encoder

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class LevelPacker:
    """Online sum-of-squares packing of pieces below a window's length."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def level(self, size: int) -> int:
        """The fill level, 0 for a new window, whose choice leaves the smallest sum of squared counts; ties go to the fullest."""
        top = self.window - size
        before = self.counts[:top + 1]
        change = np.where(before > 0, 1 - 2 * before, np.iinfo(np.int64).max >> 1)
        change[0] = 0
        after = 2 * self.counts[size:self.window + 1] + 1
        after[-1] = 0  # a full window isn't counted
        change += after
        return top - int(np.argmin(change[::-1]))

    def place(self, piece, size: int) -> list | None:
        """Puts the piece in; the window's pieces if that fills it."""
        at = self.level(size)
        held = []
        if at:
            self.counts[at] -= 1
            held = self.open[at].pop()
        held.append(piece)
        if at + size == self.window:
            return held
        self.counts[at + size] += 1
        self.open[at + size].append(held)
        return None

    def rest(self) -> Iterator:
        """The pieces of all open windows."""
        for windows in self.open:
            for held in windows:
                yield from held
            windows.clear()
        self.counts[:] = 0


def pack(docs: DataFrame, *, window: int = 1024, tokenizer: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids.

    A document is the ids of its whole text and then ``end_id``; a null or empty text is ``end_id`` alone. A null doc_id stays
    null, repeated rows are packed each for itself, other columns are left out, and an empty table gives no rows. A sequence is
    padded to ``window``; only a task's last one may need it. sequence_id is unique, with gaps between tasks.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(path), LevelPacker(window)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def write(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for doc, start, total, ids in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset)
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                offset += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1), SLICE):
                ids, counts = enc.encode(data, offsets)
                begins = np.cumsum(counts) - counts
                for doc, begin, n in zip(batch.column(0).slice(first, last - first).to_pylist(), begins.tolist(), counts.tolist(), strict=True):
                    own = np.empty(n + 1, "<u4")
                    own[:n], own[n] = ids[begin:begin + n], end_id
                    full = (n + 1) // window * window
                    for start in range(0, full, window):
                        write([(doc, start, n + 1, own[start:start + window])])
                    if full <= n and (done := packer.place((doc, full, n + 1, own[full:].copy()), n + 1 - full)):
                        write(done)
                yield flush()
        held, fill = [], 0
        for doc, start, total, ids in packer.rest():
            while len(ids):
                part = ids[:window - fill]
                held.append((doc, start, total, part))
                fill, start, ids = fill + len(part), start + len(part), ids[len(part):]
                if fill == window:
                    write(held)
                    held, fill = [], 0
        if held:
            write(held)
        yield flush()

    return docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).mapInArrow(run, schema)
