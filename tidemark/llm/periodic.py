"""Periodic runs of words by minimizers at several scales.

A run is a stretch of words of smallest period q, at least ``max(least, times * q)`` words long, that no neighbour extends. Periods up to ``SHORT`` are read off directly: words that
equal the one q before, counted lag by lag. Longer ones are found scale by scale, scale S for periods from S/2 + 1 to S: stretches of S words are hashed (doubling the stretches of the scale
before), and a stretch is a minimizer if it has the smallest hash of some window of S/2 neighbours. Inside a run of period q equal windows follow each other at distance q, so minimizers repeat at that
distance, and as S >= q no stretch equals another of the run in between. Thus every run has two neighbouring minimizers of one hash, q apart; each such pair is a seed, compared word by
word to both sides. A scale costs time in proportion to the words of the texts that are long enough for it.

Defined cases: null and empty texts have no words and no runs; a text of any length is looked at whole; repeated rows are found alike; the other columns come back as the struct
``row``, so no name can clash; an empty table gives no rows. ``times`` is 4 at least: shorter runs need not hold two windows a period apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import small_batches
from tidemark.llm.words import mix

SHORT = 8
_JOIN = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 20  # bytes of text looked at together


def _repeats(ids: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int]]:
    """Start and length of the stretches of at least ``least`` words in which words q apart are equal."""
    other = np.flatnonzero(ids[q:] != ids[:-q])
    edges = np.concatenate([[-1], other, [max(len(ids) - q, 0)]])
    for k in np.flatnonzero(np.diff(edges) - 1 >= least - q):
        yield int(edges[k]) + 1, int(edges[k + 1] - edges[k]) - 1 + q


def _same(ids: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The widest range around ``at`` of places whose word equals the one q further on."""
    low, step = at, 16
    while low > 0:
        back = min(step, low)
        differ = np.flatnonzero(ids[low - back : low] != ids[low - back + q : low + q])
        if len(differ):
            low += int(differ[-1]) + 1 - back
            break
        low, step = low - back, step * 2
    high, step = at, 16
    while high < len(ids) - q:
        ahead = min(step, len(ids) - q - high)
        differ = np.flatnonzero(ids[high : high + ahead] != ids[high + q : high + q + ahead])
        if len(differ):
            high += int(differ[0])
            break
        high, step = high + ahead, step * 2
    return low, high


def _over(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` (a power of two) neighbours."""
    by = 1
    while by < width:
        x = best(x[:-by], x[by:])
        by *= 2
    return x


def _seeds(h: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of neighbouring equal minimizers more than half a scale and at most a scale apart, and their distances."""
    w = scale // 2
    none = np.zeros(w - 1, h.dtype)
    low = _over(h, w, np.minimum)
    places = np.flatnonzero(_over(np.concatenate([none, low, none]), w, np.maximum) == h)
    found = h[places]
    order = np.argsort(found, kind="stable")
    found, places = found[order], places[order]
    apart = places[1:] - places[:-1]
    seed = np.flatnonzero((found[1:] == found[:-1]) & (apart > w) & (apart <= scale))
    return places[seed], apart[seed]


def runs(ids: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of several texts, by start, then period.

    ``ids``: a number for each word, each text followed by a number of its own that no word has. ``sizes``: the numbers of each text, that one included.
    """
    found: dict[tuple[int, int], int] = {}  # the smallest period of a stretch

    def add(start: int, length: int, q: int) -> None:
        if length >= max(least, times * q):
            found[start, length] = min(q, found.get((start, length), q))

    for q in range(1, min(SHORT, len(ids) // times) + 1):
        for start, length in _repeats(ids, q, max(least, times * q)):
            add(start, length, q)
    of = np.repeat(sizes, sizes)
    at = np.arange(len(ids))
    h, width = mix(ids.view(np.uint64) + _JOIN), 1
    while width < SHORT:
        h, width = mix(h[:-width] * _JOIN + h[width:]) if len(h) > width else h[:0], width * 2
    while len(h) > width:
        h, width = mix(h[:-width] * _JOIN + h[width:]), width * 2
        long = of[: len(h)] > times * (width // 2)
        if long.mean() < 0.7:
            # hashes over the end of a text hold its own last number, so that it stays harmless whatever follows
            keep = np.flatnonzero(long)
            h, at, of = h[keep], at[keep], of[keep]
        if len(h) < width:
            break
        places, apart = _seeds(h, width)
        order = np.lexsort((places, apart))
        last = (0, 0)  # period and end of the range seen last
        for place, q in zip(at[places[order]].tolist(), apart[order].tolist(), strict=True):
            if q == last[0] and place < last[1]:
                continue
            low, high = _same(ids, place, q)
            last = (q, high)
            add(low, high - low + q, q)
    return sorted((start, length, q) for (start, length), q in found.items())


def find(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(row, n_words, runs, collapsed) of every text: its runs (start, length, period) by start, then period, and its words joined by one space without those that repeat a run's first period."""
    if times < 4:
        raise ValueError("times must be 4 at least")
    small_batches(docs.sparkSession)
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def part(texts: list[bytes]) -> tuple[list, list, list]:
        number = defaultdict(count().__next__)
        words = [t.split() for t in texts]
        sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(sizes)
        ids = np.empty(ends[-1], np.int64)
        for k, w in enumerate(words):
            ids[ends[k] - sizes[k] : ends[k] - 1] = [number[x] for x in w]
            ids[ends[k] - 1] = -1 - k
        here: list[list] = [[] for _ in words]
        for start, length, q in runs(ids, sizes, least, times):
            k = int(np.searchsorted(ends, start, "right"))
            here[k].append((start - int(ends[k] - sizes[k]), length, q))
        collapsed = []
        for w, r in zip(words, here, strict=True):
            if r:
                kept = np.ones(len(w), bool)
                for start, length, q in r:
                    kept[start + q : start + length] = False
                w = [w[i] for i in np.flatnonzero(kept)]
            collapsed.append(b" ".join(w))
        return (sizes - 1).tolist(), here, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column("row"), batch.column("text").cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and size < _PART:
                    some.append(texts[at + len(some)].as_py() or b"")
                    size += len(some[-1])
                n, found, collapsed = part(some)
                lists = [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in found]
                arrays = [rows.slice(at, len(some)), pa.array(n, pa.int64()), pa.array(lists, pa.list_(run_type)), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "runs", "collapsed"])
                at += len(some)

    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, F.col("text").cast("string").alias("text")).mapInArrow(run, f"row {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
