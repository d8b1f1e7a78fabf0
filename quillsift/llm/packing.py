"""Token ids packed into fixed rows: best-fit-decreasing with a segment tree over capacities.

Texts become token ids; documents longer than a row are split into row-sized pieces and a rest, so nothing is lost. A pack holds
about `pack_tokens` tokens of one task's documents; within it the pieces, longest first, go to the open row with the least
room that still fits them. Rooms are 0 to row_len; a segment tree counts the open rows of each room and finds the least
room that is large enough in log(row_len) steps. Each packed row is a fixed matrix row of little-endian ids (`dtype`) with padding,
the cumulative segment lengths, and the places where positions restart (position ids count from each of them).

Nulls and empty texts: no tokens, so one empty segment-free entry: they appear in no row (their ids are in the table anyway).
Very long texts: split, see above; a worker holds one pack. Ties: pieces of equal length keep document order; of rows with equal
room the one opened last is filled. Repeated rows are packed each. Empty tables give no rows. Extra columns are ignored.
Each task packs its own rows without a shuffle, so a hot source or key is as any other; another split of the input packs
other rows together, and a retried task packs the same.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema, small_batches

ROW_LEN, PACK_TOKENS = 2048, 1 << 21
SCHEMA = "pack string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, piece_nos array<int>"


class RoomTree:
    """Open rows by the room they have left; the least room of at least n in O(log) steps."""

    def __init__(self, most: int):
        self.size = 1
        while self.size < most + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) of the least room >= least."""
        at, count = least + self.size, self.count
        if not count[at]:
            while at and (at & 1 or not count[at + 1]):  # up until a right sibling has rows
                at >>= 1
            if not at:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, row_len: int) -> list[list[int]]:
    """The pieces of each row; lengths must be 1 to row_len."""
    tree, rows = RoomTree(row_len), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if (found := tree.take(n)) is None:
            room, row = row_len, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > n:
            tree.add(room - n, row)
    return rows


def pieces_of(ids: np.ndarray, row_len: int) -> list[np.ndarray]:
    return [ids[at : at + row_len] for at in range(0, len(ids), row_len)]


def unpack(rows, dtype: str = "<u2") -> dict[int, np.ndarray]:
    """The ids of each document from packed rows (any order) of distinct doc_ids."""
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in rows:
        flat = np.frombuffer(bytes(r["ids"]), dtype)
        for j, (doc, no) in enumerate(zip(r["doc_ids"], r["piece_nos"], strict=True)):
            found.setdefault(doc, {})[no] = flat[r["cu_seqlens"][j] : r["cu_seqlens"][j + 1]]
    return {d: np.concatenate([p[i] for i in sorted(p)]) for d, p in found.items()}


def byte_bpe_encoder(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """An encoder of a .tiktoken file; special strings are ordinary text."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [one.encode_ordinary(t) for t in texts]

    return make


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], *, row_len: int = ROW_LEN, pad: int = 0, dtype: str = "<u2", pack_tokens: int = PACK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows (SCHEMA). cu_seqlens starts with 0 and ends with n_tokens; position_resets are its starts of segments."""
    small_batches(docs.sparkSession)
    out, most = pa_schema(docs.sparkSession, SCHEMA), np.iinfo(dtype).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, packs = encoder(), TaskContext.get().partitionId(), 0
        waiting: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0

        def packed() -> Iterator[pa.RecordBatch]:
            rows = best_fit_decreasing(np.array([len(p) for _, _, p in waiting]), row_len)
            for at in range(0, len(rows), 512):
                part = [[waiting[i] for i in own] for own in rows[at : at + 512]]
                matrix = np.full((len(part), row_len), pad, dtype)
                ends = []
                for line, own in zip(matrix, part, strict=True):
                    flat = np.concatenate([p for _, _, p in own])
                    line[: len(flat)] = flat
                    ends.append(np.cumsum([0, *(len(p) for _, _, p in own)]))
                cols = [[f"{task}-{packs}"] * len(part), list(range(at, at + len(part))), [int(e[-1]) for e in ends], [line.tobytes() for line in matrix], ends, [e[:-1] for e in ends], [[d for d, _, _ in own] for own in part], [[n for _, n, _ in own] for own in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    flat = np.array(ids, np.int64)
                    if flat.max(initial=0) > most:
                        raise ValueError(f"ids up to {flat.max()} don't fit in {dtype}")
                    for no, piece in enumerate(pieces_of(flat.astype(dtype), row_len)):
                        waiting.append((doc, no, piece))
                        tokens += len(piece)
                if tokens >= pack_tokens:
                    yield from packed()
                    waiting.clear()
                    tokens, packs = 0, packs + 1
        if waiting:
            yield from packed()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
