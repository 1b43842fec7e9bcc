"""Packing documents into fixed windows by the sum-of-squares rule.

Each task packs what it reads, online, with an array of levels: N[h] windows
are filled up to h ids.  A piece of r ids goes where the sum of N[h]^2 grows
least (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, 2006), a rule that
keeps gaps of many sizes open and wastes little for almost any distribution.
No shuffle is needed and a task's memory is bounded: windows leave it once
full, and when too many are open some are filled up by cutting the pieces of
the emptiest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkhist.llm._common import sliced, trim
from sparkhist.llm.tokens import default_path, encoder

#: Windows a task keeps open before it fills some up by cutting.
OPEN = 1024


class Packer:
    """Sum-of-squares packing of (key, start, ids, total) pieces into windows.

    ``emit(window)`` gets each finished window, a list of such pieces.  ids
    are bytes, four to an id.
    """

    def __init__(self, capacity: int, emit, most_open: int = OPEN):
        self.cap, self.emit, self.most = capacity, emit, most_open
        self.levels = np.zeros(capacity + 1, np.int64)
        self.at: dict[int, list[list[tuple]]] = {}
        self.open = 0

    def choose(self, r: int) -> int:
        """The level whose windows a piece of r ids joins; 0 opens a window."""
        n = self.levels
        best, best_h = (2 * int(n[r]) + 1 if r < self.cap else 0), 0
        hs = np.flatnonzero(n[1 : self.cap - r + 1]) + 1
        if len(hs):
            after = hs + r
            cost = 1 - 2 * n[hs] + np.where(after < self.cap, 2 * n[after] + 1, 0)
            i = len(hs) - 1 - int(np.argmin(cost[::-1]))  # of equal ones, the fullest
            if cost[i] <= best:
                best_h = int(hs[i])
        return best_h

    def _take(self, h: int) -> list[tuple]:
        self.levels[h] -= 1
        self.open -= 1
        return self.at[h].pop()

    def _put(self, h: int, window: list[tuple]) -> None:
        if h == self.cap:
            self.emit(window)
        else:
            self.levels[h] += 1
            self.open += 1
            self.at.setdefault(h, []).append(window)

    def add(self, key, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        while total - start >= self.cap:
            self.emit([(key, start, ids[4 * start : 4 * (start + self.cap)], total)])
            start += self.cap
        if r := total - start:
            h = self.choose(r)
            window = self._take(h) if h else []
            window.append((key, start, ids[4 * start :], total))
            self._put(h + r, window)
            if self.open > self.most:
                self.fill_up(self.most // 2)

    def fill_up(self, keep: int) -> None:
        """Cut pieces of the emptiest windows into the fullest until `keep` are open."""
        windows = [[h, self.at[h].pop()] for h in range(1, self.cap) for _ in range(int(self.levels[h]))]
        self.levels[:] = 0
        self.open = 0
        lo, hi = 0, len(windows) - 1
        while hi - lo + 1 > keep and lo < hi:
            gap = self.cap - windows[hi][0]
            key, start, ids, total = windows[lo][1].pop()
            n = len(ids) // 4
            if n > gap:
                windows[lo][1].append((key, start, ids[: 4 * (n - gap)], total))
                key, start, ids = key, start + n - gap, ids[4 * (n - gap) :]
                n = gap
            windows[hi][1].append((key, start, ids, total))
            windows[hi][0] += n
            windows[lo][0] -= n
            if windows[hi][0] == self.cap:
                self.emit(windows[hi][1])
                hi -= 1
            if not windows[lo][1]:
                lo += 1
        for h, w in windows[lo : hi + 1]:
            self._put(h, w)

    def finish(self) -> None:
        """Close all windows; the last is cut at powers of two, which need no padding."""
        self.fill_up(1)
        for h in np.flatnonzero(self.levels):
            left = [p for w in self.at[int(h)] for p in w]
            level = int(h)
            while level:
                size, window = 1 << (level.bit_length() - 1), []
                level -= size
                while size:
                    key, start, ids, total = left.pop(0)
                    n = min(size, len(ids) // 4)
                    window.append((key, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        left.insert(0, (key, start + n, ids[4 * n :], total))
                    size -= n
                self.emit(window)
        self.levels[:] = 0
        self.at, self.open = {}, 0


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pack the ids of every row, each ended by `end_id`, into sequences.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the ids.  A document that
    fits stays whole except where cutting saves padding; longer ones fill
    whole sequences first.  A null or empty text is the end id alone; rows
    with one id, or none, are documents of their own; other columns are not
    read; an empty table gives no piece.  Sequence ids are unique to a run.
    """
    path = path or default_path()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids array<int>" if with_ids else "")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        out: list[tuple] = []
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        key_type = None

        def emit(window: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for key, start, ids, total in window:
                n = len(ids) // 4
                row = (key, start, n, zlib.crc32(ids), total, sequence, at)
                out.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)
                at += n
            sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            arrays = [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            arrays += [pa.array(list(cols[7]), pa.list_(pa.int32()))] if with_ids else []
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

        packer = Packer(capacity, emit)
        end = int(end_id).to_bytes(4, "little")
        for b in sliced(batches):
            key_type = b.column("doc_id").type
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                packer.add(key, enc.ids_bytes(text.as_py() or "") + end)
                if len(out) >= 8192:
                    yield flush()
        packer.finish()
        if out:
            yield flush()
        del packer
        trim()

    return src.mapInArrow(run, schema)
