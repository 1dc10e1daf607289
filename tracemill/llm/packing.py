"""Token ids packed into rows of one length, by best fit decreasing.

Texts are encoded (see bpe), documents longer than a row are cut into pieces of the row's length and a rest, nothing is lost. Each task
packs its pieces in groups of BUFFER_TOKENS: longest first, each into the row with the least room that still holds it. A
segment tree over the amounts of room answers which that is in log(length) steps. A packed row holds its ids
as little-endian integers (two bytes each if the vocabulary allows), padded at the end; the cumulative segment
lengths; the positions where position numbers start anew; and for each segment its document and offset there.

Defined results: null and empty texts have no ids and are in no row; repeated documents are packed as often as they come;
pieces of equal length are placed in the order of their rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import shipped

ROW_TOKENS = 2048
BUFFER_TOKENS = 4 << 20
SCHEMA = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{id}>, doc_offsets array<long>"


class Room:
    """Rows by the room they have left; a segment tree finds the least room that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)  # rows in the subtree
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) with the least room of at least need, which then leaves; None if there is none."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not self.tree[i]:
                    i += 1
        room = i - self.size
        row = self.rows[room].pop()
        self._add(room, -1)
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; every length is 1 to capacity."""
    room = Room(capacity)
    rows: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = room.take(lengths[i])
        if got is None:
            rows.append([])
            got = len(rows) - 1, capacity
        rows[got[0]].append(i)
        if got[1] > lengths[i]:
            room.put(got[0], got[1] - lengths[i])
    return rows


def pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(offset, ids) of the pieces of one document."""
    return [(at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]


def packed(docs: DataFrame, path: str, row_tokens: int = ROW_TOKENS, pad: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Packed rows of docs (id column, text); see SCHEMA."""
    shipped(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def rows_of(buffer: list, number: int, id_type: pa.DataType, dtype) -> pa.RecordBatch:
        bins = best_fit_decreasing([len(x) for _, _, x in buffer], row_tokens)
        part = TaskContext.get().partitionId()
        cols: list[list] = [[] for _ in range(7)]
        for k, row in enumerate(bins):
            flat = np.concatenate([buffer[i][2] for i in row])
            cu = np.cumsum([0, *[len(buffer[i][2]) for i in row]]).tolist()
            full = np.full(row_tokens, pad, dtype)
            full[: len(flat)] = flat
            for c, v in zip(cols, ((part << 33) + number + k, len(flat), full.tobytes(), cu, cu[:-1], [buffer[i][0] for i in row], [buffer[i][1] for i in row])):
                c.append(v)
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64())]
        names = ["pack_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        dtype = np.dtype("<u2") if len(enc.ranks) + 1 < 1 << 16 else np.dtype("<i4")
        buffer, size, number, id_type = [], 0, 0, None
        for batch in batches:
            id_type = batch.column(0).type
            names = batch.column(0).to_pylist()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for name, ids in zip(names, enc.ids(texts)):
                for at, part in pieces(ids.astype(dtype), row_tokens):
                    buffer.append((name, at, part))
                    size += len(part)
                    if size >= BUFFER_TOKENS:
                        out = rows_of(buffer, number, id_type, dtype)
                        number += out.num_rows
                        buffer, size = [], 0
                        yield out
        if buffer:
            yield rows_of(buffer, number, id_type, dtype)

    return docs.select(id_col, "text").mapInArrow(run, SCHEMA.format(id=kind))


def matrix(rows: list[bytes], row_tokens: int = ROW_TOKENS, dtype: str = "<u2") -> np.ndarray:
    """Packed rows as one id matrix."""
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), row_tokens)
