"""Sum-of-squares packing of documents into windows of tokens.

A document's ids and an end id are cut into full windows and a remainder. Remainders are placed one by one, as they come: of all levels of fill that leave room (and an empty
window) the one is taken that makes the sum over levels of the squared number of partially filled windows smallest (Csirik et al., 2006); the fuller level wins a tie. The
counts are one array with a place a level, so a placement is a few operations on that array, whatever the number of documents.

At the end of a partition, and whenever more than ``most_open`` windows are open, the open windows land: the emptiest are emptied into the gaps of the fullest, cutting documents
where a gap ends. What is left at the end of a partition is less than a window; it is cut at powers of two, which are sequence lengths that need no padding.

Every partition packs its own rows without a shuffle, and holds open windows only: ``most_open`` times the window's ids at most, beside one batch.

Defined cases: a null text is empty and gives the end id alone; rows that repeat a doc_id, or have none, are documents of their own; texts of any length are cut into as many windows
as they fill; the other columns come back as the struct ``row``, so no name can clash; an empty table gives no rows. Pieces depend on the order of the rows in a partition; over a scan
of files it is fixed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.merges import Speller
from tidemark.llm.scratch import small_batches
from tidemark.llm.words import runs, utf8

_PART = 1 << 22  # bytes of text encoded together

Piece = tuple  # (row, start in the document's ids, ids, number of the document's ids)


class Packer:
    """Windows of ``size`` ids under way in one partition."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open, self.open = size, most_open, 0
        self.count = np.zeros(size + 1, np.int64)  # partially filled windows by level; full ones don't count
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def level(self, n: int) -> int:
        """The level to place ``n`` ids at, fewer than a window: 0 is an empty window."""
        count, room = self.count, self.size - n
        before, after = count[1 : room + 1], count[n + 1 : self.size + 1]
        # one window less at the level before, one more at the level after; none more when it is full
        change = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
        if room and before[-1]:
            change[-1] = 1 - 2 * before[-1]
        if not room or (best := change.min()) > 2 * count[n] + 1:
            return 0
        return room - int(np.argmin(change[::-1]))

    def add(self, row: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Windows that a document fills."""
        full = len(ids) // self.size * self.size
        for at in range(0, full, self.size):
            yield [(row, at, ids[at : at + self.size], len(ids))]
        if rest := len(ids) - full:
            h = self.level(rest)
            window = self.take(h) if h else []
            window.append((row, full, ids[full:], len(ids)))
            if h + rest == self.size:
                yield window
            else:
                self.put(h + rest, window)
                if self.open > self.most_open:
                    left, filled = self.land()
                    yield from filled
                    if left:
                        self.put(sum(len(p[2]) for p in left), left)

    def take(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def put(self, level: int, window: list[Piece]) -> None:
        self.count[level] += 1
        self.open += 1
        self.windows[level].append(window)

    def land(self) -> tuple[list[Piece], list[list[Piece]]]:
        """Empties the emptiest open windows into the fullest. The pieces that are left, less than a window, and the windows filled."""
        levels = [h for h in range(1, self.size) for _ in range(self.count[h])]
        windows = [self.take(h) for h in levels]
        filled, low, high = [], 0, len(windows) - 1
        while low < high:
            gap = self.size - levels[high]
            while gap and low < high:
                moved = min(gap, levels[low])
                kept, gone = cut(windows[low], levels[low] - moved)
                windows[low], levels[low] = kept, levels[low] - moved
                windows[high] += gone
                gap -= moved
                low += not levels[low]
            levels[high] = self.size - gap
            if not gap:
                filled.append(windows[high])
                high -= 1
        return (windows[low] if low == high else []), filled

    def close(self) -> Iterator[list[Piece]]:
        """The windows of what is still open, the last ones as long as powers of two."""
        left, filled = self.land()
        yield from filled
        n = sum(len(p[2]) for p in left)
        while n:
            power = 1 << (n.bit_length() - 1)
            head, left = cut(left, power)
            yield head
            n -= power


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """``pieces`` before and from their id number ``at``."""
    head, tail = [], []
    for row, start, ids, of in pieces:
        if at >= len(ids):
            head.append((row, start, ids, of))
        elif at <= 0:
            tail.append((row, start, ids, of))
        else:
            head.append((row, start, ids[:at], of))
            tail.append((row, start + at, ids[at:], of))
        at -= len(ids)
    return head, tail


def pack(docs: DataFrame, spec: str, end_id: int = 1, size: int = 2048, most_open: int = 4096) -> DataFrame:
    """A row a piece: ``row`` (the document's other columns), ``start`` of the piece in the document's ids, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in that sequence.

    ``spec``: the vocabulary file's text (``bpe.load``). ``end_id`` follows the ids of every document.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((bpe._automaton(spec), spec))
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    end = np.array([end_id], "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, packer = Speller(*shared.value), Packer(size, most_open)
        number = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def filled(windows) -> None:
            nonlocal number
            for window in windows:
                offset = 0
                for of_row, start, ids, of in window:
                    out.append((of_row, start, len(ids), ids.tobytes(), of, number, offset))
                    offset += len(ids)
                number += 1

        def flush() -> pa.RecordBatch:
            rows, *columns = zip(*out, strict=True)
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(rows), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            _, offsets = utf8(texts)
            for low, high in runs(offsets, _PART):
                rows = batch.column("row").slice(low, high - low)
                ids, ends = speller.spell(texts.slice(low, high - low))
                for i, (start, to) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    filled(packer.add(rows.take(pa.array([i])), np.append(ids[start:to], end).astype("<u4")))
                    if len(out) >= 1024:
                        yield flush()
        filled(packer.close())
        if out:
            yield flush()

    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, F.col("text").cast("string").alias("text")).mapInArrow(run, f"row {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
