"""Packing token sequences by minimum bin slack.

Every document becomes token ids and an end id. Whole windows of a long
document are sequences of their own; what is left of each document is filed by
its length. A window is then filled by the multiset of filed lengths whose sum
comes closest to the window: a subset-sum over bitsets, one bit per reachable
sum, seeded with the longest length on file and backtracked to counts. Because
thousands of documents are on file, the closest sum is nearly always the window
itself.

Each task packs what it reads and never holds more than ``file_tokens`` tokens,
so there is no shuffle and nothing is stored between reading and writing: a lost
executor repeats its own tasks only. When no exact filling is left at the end of
a task, the last documents are cut to the window, and the rest of them at powers
of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from observatory.llm.tokens import WordTokenizer

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
ARROW = pa.schema([(name, pa.int64()) for name in (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def closest_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of ``counts`` (length -> how many) that contains the longest length and sums closest to ``window``.

    Returned as length -> how many. Lengths are tried from the longest down, and
    the walk stops as soon as the window is filled exactly.
    """
    order = sorted((n for n, c in counts.items() if c > 0), reverse=True)
    if not order:
        return {}
    first = order[0]
    room = window - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in order:
        left = counts[n] - (n == first)
        if n > room or left <= 0:
            continue
        left, part = min(left, room // n), 1
        while left > 0 and not reach >> room & 1:
            take = min(part, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    picked = {first: 1}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            picked[n] = picked.get(n, 0) + take
            at -= n * take
    return picked


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """The state of one task: documents on file by remaining length, and rows to write."""

    def __init__(self, window: int, file_tokens: int, first_sequence: int):
        self.window, self.file_tokens, self.sequence = window, file_tokens, first_sequence
        self.files: dict[int, list[tuple[int | None, int, int, np.ndarray]]] = {}
        self.counts: dict[int, int] = {}
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, window = len(ids), self.window
        whole = total - total % window
        for start in range(0, whole, window):
            self.rows.append((doc, start, window, _crc(ids[start:start + window]), total, self.sequence, 0))
            self.sequence += 1
        if whole < total:
            n = total - whole
            self.files.setdefault(n, []).append((doc, whole, total, ids[whole:].copy()))
            self.counts[n] = self.counts.get(n, 0) + 1
            self.held += n
        if self.held >= self.file_tokens:
            self.fill(self.file_tokens // 2)

    def fill(self, keep: int) -> None:
        """Exact fillings until at most ``keep`` tokens are on file, or none is left."""
        while self.held > keep:
            picked = closest_fill(self.counts, self.window)
            if sum(n * k for n, k in picked.items()) < self.window:
                if keep:  # more documents may come, but the file may not grow
                    self.cut(self._take(picked, fill=True))
                    continue
                return
            offset = 0
            for piece in self._take(picked):
                self._row(piece, offset)
                offset += len(piece[3])
            self.sequence += 1

    def close(self) -> None:
        """All that is left: exact fillings, then documents cut to windows and at powers of two."""
        self.fill(0)
        self.cut(self._take(dict(self.counts)))

    def cut(self, pieces: list[tuple]) -> None:
        left = sum(len(p[3]) for p in pieces)
        room = offset = 0
        for doc, start, total, ids in pieces:
            while len(ids):
                if not room:
                    room, offset = (self.window if left >= self.window else 1 << left.bit_length() - 1), 0
                    left -= room
                n = min(room, len(ids))
                self._row((doc, start, total, ids[:n]), offset)
                start, ids, room, offset = start + n, ids[n:], room - n, offset + n
                if not room:
                    self.sequence += 1

    def _row(self, piece: tuple, offset: int) -> None:
        doc, start, total, ids = piece
        self.rows.append((doc, start, len(ids), _crc(ids), total, self.sequence, offset))

    def _take(self, picked: dict[int, int], fill: bool = False) -> list[tuple]:
        """Pieces off the file; with ``fill`` the longest pieces on top, until they fill a window."""
        out = []
        for n in sorted(picked, reverse=True):
            for _ in range(picked[n]):
                out.append(self._pop(n))
        while fill and sum(len(p[3]) for p in out) < self.window and self.held:
            out.append(self._pop(max(n for n, c in self.counts.items() if c)))
        return out

    def _pop(self, n: int) -> tuple:
        piece = self.files[n].pop()
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n], self.files[n]
        self.held -= n
        return piece

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(ARROW)
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=ARROW)


def pack(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    window: int = 4096, end_id: int = 2, file_tokens: int = 1 << 22,
) -> DataFrame:
    """One row per piece of a document: where it lies in its document and in its sequence.

    ``tokenizer``: path of the tokenizer's file, readable by every executor. A
    null text counts as empty: its document is the end id alone. A null id is
    kept. Repeated rows are packed as often as they come. Texts of any length
    are tokenized in slices. Other columns are not read. An empty table gives no
    rows. ``sequence_id`` is unique over the table and the same in every attempt
    of a task; offsets have no gaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        words = WordTokenizer.of(tokenizer)
        packer = Packer(window, file_tokens, (context.partitionId() if context else 0) << 40)
        end = np.array([end_id], np.uint16)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = batch.column(1)
            for i, doc in enumerate(docs):
                text = texts[i].as_py() or b""
                packer.add(doc, np.concatenate([*words.ids(text), end]))
                if len(packer.rows) >= 20_000:
                    yield packer.batch()
        words.forget()
        packer.close()
        yield packer.batch()

    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, SCHEMA)
