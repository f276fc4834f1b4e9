"""Line deduplication by an exact set-similarity join.

A line's set is its distinct words (see ``words``; A-Z count as a-z). A line is removed when an earlier line, in the order
(row, line number), has a word set of Jaccard similarity ``percent``/100 or more; equal sets always qualify. Blank lines
have no set and stay. Whether the earlier line stays itself does not matter.

1. *Rarity*: how often words occur, over the whole corpus, in a table of 2^18 hashed buckets (a fixed size). The order
   (bucket count, word hash) is total, so the filters below lose nothing however coarse the counts are.
2. *Equal sets*: a 128-bit hash tells equal sets apart from others. A line that repeats one which the same task has read, and that is earlier, goes at once, so
   a line that is everywhere reaches the shuffle a few times for each task; the rest meet under their rarest word.
3. *Postings*: a line of n words is posted under its n - ceil(t n) + 1 rarest words. Lists are dealt by word and read in order of set size. Pairs must pass
   the length filter, the positional filter, and a parity filter: each word that only one of two sets has changes one of 128 parities, so few of these may differ.
4. *First pass*: in each list a line meets only the earliest line of a size that allows the similarity. That finds most repeats in large groups of
   near copies with one comparison each, not one with every other copy.
5. *Second pass*: lines not found so meet all earlier lines of their lists. What a line is removed for can't change the result, so the pairs left out don't matter.
6. *Verification*: the Jaccard similarity of the pairs left is computed on the lines themselves.

Rows are in order of doc_id, then of text (see ``scratch.numbered``), and each is a document of its own: of rows that repeat the first keeps its lines.

Defined cases: null text has no lines and stays null; rows with a null doc_id come last; columns other than text are passed through, and a column may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import numbered, save, small_batches
from tidemark.llm.words import U, mix, runs, signed, utf8, words

BUCKETS, SLICES = 1 << 18, 64
_LINE = 10


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(46)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of words by bucket, in slices of the table as bytes."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in runs(offsets):
            _, h = words(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a])
            total += np.bincount(_bucket(h), minlength=BUCKETS)
    if total.any():
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())})


def _add(slice_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS // SLICES, np.int64)
    for batch in batches:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"slice": pa.array([slice_[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def word_rarity(texts: DataFrame) -> np.ndarray:
    """The rank of each bucket by its number of words in all texts, the rarest first."""
    kind = "slice int, counts binary"
    found = texts.select("text").mapInArrow(_count, kind).groupBy("slice").applyInArrow(_add, kind).collect()
    total = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for slice_, counts in found:
        total[slice_] = np.frombuffer(counts, np.int64)
    rank = np.empty(BUCKETS, np.int64)
    rank[np.argsort(total.ravel(), kind="stable")] = np.arange(BUCKETS)
    return rank


def _line_sets(data: np.ndarray, offsets: np.ndarray, order: np.ndarray | None):
    """For a range of rows: (row, line number) of each line with words, the bounds of its distinct words, and these in order of rarity."""
    starts, h = words(data, offsets[:-1])
    feeds = np.flatnonzero(data == _LINE)
    row_of = np.searchsorted(offsets[:-1], starts, "right") - 1
    before = np.searchsorted(feeds, starts)
    line_of = before + row_of  # goes up at each line feed and at each row
    number_of = before - np.searchsorted(feeds, offsets[:-1])[row_of] if len(starts) else before
    # one 64-bit sort key where it orders as (line, rarity, hash) does, else the three keys themselves
    rank = np.zeros(len(h), U) if order is None else order[_bucket(h)].astype(U)
    key = (line_of.astype(U) << U(44)) | (rank << U(26)) | ((h << U(18)) >> U(38))
    at = np.argsort(key)
    tied = key[at[1:]] == key[at[:-1]]
    if (len(line_of) and line_of[-1] >= 1 << 20) or np.any(h[at[1:]][tied] != h[at[:-1]][tied]):
        at = np.lexsort((h, rank, line_of))
    h, line_of, row_of, number_of = h[at], line_of[at], row_of[at], number_of[at]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (line_of[1:] != line_of[:-1])
    h, line_of, row_of, number_of = h[fresh], line_of[fresh], row_of[fresh], number_of[fresh]
    bounds = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]])) if len(h) else np.zeros(0, np.int64)
    return row_of[bounds], number_of[bounds], bounds, h


def _classes_of(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [signed(np.add.reduceat(mix(h ^ salt), bounds)) if len(h) else np.zeros(0, np.int64) for salt in (U(0x632BE59BD9B4E019), U(0x8CB92BA72F3D8DD7))]


def _taken(n: np.ndarray, percent: int) -> np.ndarray:
    """Words of the prefix of a set of n words."""
    return n - -(-n * percent // 100) + 1


_COLUMNS = ("word", "n", "place", "odd1", "odd2", "set", "rid", "line")
_POSTED = "word bigint, n int, place int, odd1 bigint, odd2 bigint, set bigint, rid bigint, line int"


def _rows(values: list[np.ndarray], **more: pa.Array) -> pa.RecordBatch:
    kinds = dict(n=np.int32, place=np.int32, line=np.int32)
    return pa.RecordBatch.from_pydict({c: pa.array(v.astype(kinds.get(c, np.int64))) for c, v in zip(_COLUMNS, values)} | more)


def _prefixes(order: np.ndarray, percent: int):
    """(word, set size, place, parities of the set, hash of the set, line) for the rarest words of each line; size 0 marks a line that an earlier equal one makes redundant."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rid = batch.column("rid").to_numpy()
            for a, b in runs(offsets):
                row, number, bounds, h = _line_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
                if not len(h):
                    continue
                k1, k2 = _classes_of(h, bounds)
                rids = rid[a:b][row]
                sizes = np.diff(np.append(bounds, len(h)))
                new = np.ones(len(k1), bool)
                for i, (k, k_, r, at) in enumerate(zip(k1.tolist(), k2.tolist(), rids.tolist(), number.tolist())):
                    before = seen.get(k)
                    if before is not None and before[0] == k_ and before[1:] < (r, at):
                        new[i] = False
                    else:
                        seen[k] = (k_, r, at)
                if len(seen) > 60_000:  # the table only saves work and is bounded
                    seen.clear()
                if not new.all():
                    old, zero = ~new, np.zeros(int((~new).sum()), np.int64)
                    yield _rows([signed(mix(k1[old].view(U) ^ mix(rids[old].astype(U)))), zero, zero, zero, zero, zero, rids[old], number[old]])
                bit, upper = U(1) << (h & U(63)), (h & U(64)) > 0
                odd = [signed(np.bitwise_xor.reduceat(np.where(upper == half, bit, U(0)), bounds)[new]) for half in (False, True)]
                bounds, sizes, rids, number, k1 = bounds[new], sizes[new], rids[new], number[new], k1[new]
                if not len(rids):
                    continue
                taken = _taken(sizes, percent)
                rows = np.repeat(np.arange(len(taken)), taken)
                begin = np.cumsum(taken) - taken
                place = np.arange(len(rows)) - begin[rows]
                word = h[bounds[rows] + place]
                yield _rows([signed(word), sizes[rows], place, odd[0][rows], odd[1][rows], np.where(place == 0, k1[rows], 0), rids[rows], number[rows]])

    return post


def _may(x: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of postings in one list, with different sets, can be similar: length, positional and parity filters."""
    _, n, place, odd1, odd2, _, _, _ = x
    nl, nr = n[left], n[right]
    need = -(-(nl + nr) * percent // (100 + percent))
    good = (np.minimum(nl, nr) * 100 >= np.maximum(nl, nr) * percent) & (np.minimum(nl - place[left], nr - place[right]) >= need)
    # equal sets are found elsewhere, so the words that only one of the two has are one at least; each changes one parity
    apart = nl + nr - 2 * need
    changed = sum(np.bitwise_count((o[left] ^ o[right]).view(U)).astype(np.int64) for o in (odd1, odd2))
    return good & (apart > 0) & (changed <= apart)


def _in_lists(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Rows in order of word and set size, in pieces that don't divide a word's list."""
    waiting: list[pa.RecordBatch] = []
    held, rows = None, 0

    def pieces(last: bool) -> Iterator[list[np.ndarray]]:
        nonlocal held, rows
        if not waiting and held is None:
            return
        now = [np.concatenate([*([held[i]] if held is not None else []), *[b.column(c).to_numpy().astype(np.int64) for b in waiting]]) for i, c in enumerate(columns)]
        waiting.clear()
        rows = 0
        if not len(now[0]):
            return
        cut = len(now[0]) if last else int(np.searchsorted(now[0], now[0][-1], "left"))  # the last group may go on in the next batch
        held = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]

    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= 50_000:
            yield from pieces(last=False)
    yield from pieces(last=True)


def _least(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least rank in each range lo to hi (exclusive, not empty), by a table of minima over powers of two."""
    out = rank[lo].copy()
    size, step, table = hi - lo, 1, rank
    while True:
        fits = (size >= step) & (size < 2 * step)
        out[fits] = np.minimum(table[lo[fits]], table[hi[fits] - step])
        if 2 * step > size.max():
            return out
        table = np.minimum(table[: len(table) - step], table[step:])
        step *= 2


def _pairs(x: list[np.ndarray], percent: int, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings in one list that may be similar, by distance in the list; ``wanted`` says of which pairs the caller still needs to know."""
    word, n = x[0], x[1]
    left, step = np.arange(len(word)), 1
    while len(left):
        left = left[left + step < len(word)]
        near = (word[left] == word[left + step]) & (n[left] * 100 >= n[left + step] * percent)
        left = left[near]
        asked = left[wanted(left, left + step)]
        good = asked[_may(x, asked, asked + step, percent)]
        if len(good):
            yield good, good + step
        step += 1


def _meet_first(percent: int):
    """Postings that may be similar to another of their list, each with the earliest line of the list that it may be similar to (rid0, line0) or null.

    Lines that an earlier line of the same set makes redundant come out with size 0.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _in_lists(batches, _COLUMNS):
            gone = x[1] == 0
            late, x = [c[gone] for c in x], [c[~gone] for c in x]
            word, n, place, _, _, sets, rid, line = x
            # equal sets have the same rarest word
            first = np.flatnonzero(place == 0)
            first = first[np.lexsort((line[first], rid[first], n[first], sets[first], word[first]))]
            again = np.zeros(len(first), bool)
            again[1:] = (word[first[1:]] == word[first[:-1]]) & (sets[first[1:]] == sets[first[:-1]]) & (n[first[1:]] == n[first[:-1]])
            equal = np.zeros(len(word), bool)
            equal[first[again]] = True
            late = [np.concatenate([c, v[equal]]) for c, v in zip(late, x)]
            late[1] = np.zeros(len(late[1]), np.int64)
            x = [c[~equal] for c in x]
            marked = np.zeros(len(x[0]), bool)
            for left, right in _pairs(x, percent, lambda a, b: ~(marked[a] & marked[b])):
                marked[left] = marked[right] = True
            x = [c[marked] for c in x]
            word, n, _, _, _, _, rid, line = x
            if len(late[0]):
                none = len(late[0])
                yield _rows(late, rid0=pa.nulls(none, pa.int64()), line0=pa.nulls(none, pa.int32()))
            if not len(word):
                continue
            rank = np.empty(len(word), np.int64)
            by_time = np.lexsort((line, rid))
            rank[by_time] = np.arange(len(word))
            group = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]]))
            wide = int(n.max()) * 2 + 2
            key = group * wide + n
            lo = np.searchsorted(key, group * wide + -(-n * percent // 100), "left")
            hi = np.searchsorted(key, group * wide + np.minimum(n * 100 // percent, wide - 1), "right")
            hub, mine = by_time[_least(rank, lo, hi)], np.arange(len(word))
            found = (rank[hub] < rank) & ((rid[hub] != rid) | (line[hub] != line)) & _may(x, hub, mine, percent)
            yield _rows(x, rid0=pa.array(rid[hub], mask=~found), line0=pa.array(line[hub].astype(np.int32), mask=~found))

    return meet


def _meet_all(percent: int):
    """Pairs (earlier, later) of postings that may be similar and whose later line is still open."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _in_lists(batches, (*_COLUMNS, "open")):
            *x, open_ = x
            rid, line, open_ = x[6], x[7], open_ == 1
            for left, right in _pairs(x, percent, lambda a, b: open_[a] | open_[b]):
                swap = (rid[left] > rid[right]) | ((rid[left] == rid[right]) & (line[left] > line[right]))
                old, new = np.where(swap, right, left), np.where(swap, left, right)
                old, new = old[open_[new]], new[open_[new]]
                if len(old):
                    yield pa.RecordBatch.from_pydict({"rid": pa.array(rid[new]), "line": pa.array(line[new].astype(np.int32)), "rid0": pa.array(rid[old]), "line0": pa.array(line[old].astype(np.int32))})

    return meet


def _similar(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("said").to_pylist(), batch.column("said0").to_pylist()):
                x, y = set(x.encode().lower().split()), set(y.encode().lower().split())
                common = len(x & y)
                good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("line")], ["rid", "line"]).filter(pa.array(good, pa.bool_()))

    return verify


def _with_lists(texts: DataFrame, lists: DataFrame, lines: int, how: str, bound: int = 1_000_000) -> DataFrame:
    """``texts`` joined with their line lists on rid; the lists are broadcast only when they hold ``bound`` lines at most, else both sides are shuffled."""
    return texts.join(F.broadcast(lists) if lines <= bound else lists, "rid", how)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(rid, line) of the pairs (rid, line, rid0, line0) whose lines are similar enough."""
    wanted = save(pairs.select("rid", "line").unionByName(pairs.select(F.col("rid0").alias("rid"), F.col("line0").alias("line"))).distinct(), "wanted_lines")
    lists = wanted.groupBy("rid").agg(F.collect_set("line").alias("wanted"))
    some = _with_lists(texts, lists, wanted.count(), "inner")
    picked = F.transform(F.array(F.split("text", "\n", -1)), lambda all_: F.transform("wanted", lambda i: F.struct(i.alias("line"), F.get(all_, i).alias("said"))))[0]
    some = some.select("rid", F.inline(picked)).where("said is not null")
    said0 = some.select(F.col("rid").alias("rid0"), F.col("line").alias("line0"), F.col("said").alias("said0"))
    return pairs.join(some, ["rid", "line"]).join(said0, ["rid0", "line0"]).select("rid", "line", "said", "said0").mapInArrow(_similar(percent), "rid bigint, line int").distinct()


def repeated_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(rid, line): the lines of ``docs`` (doc_id, text) that an earlier line makes redundant; rid is the row's number, see ``scratch.numbered``."""
    return _repeated(numbered(docs), percent)


def _repeated(rows: DataFrame, percent: int) -> DataFrame:
    """``repeated_lines`` of rows (text, rid), each with a rid of its own."""
    texts = rows.select("rid", "text").where("text is not null")
    small_batches(rows.sparkSession)
    order = word_rarity(texts)
    posted = texts.mapInArrow(_prefixes(order, percent), _POSTED).repartition("word").sortWithinPartitions("word", "n")
    met = save(posted.mapInArrow(_meet_first(percent), f"{_POSTED}, rid0 bigint, line0 int"), "met")
    equal, live = met.where("n = 0").select("rid", "line"), met.where("n > 0")
    first = save(live.where("rid0 is not null").select("rid", "line", "rid0", "line0").distinct().join(equal, ["rid", "line"], "left_anti"), "first_pairs")
    late = save(_confirmed(first, texts, percent).unionByName(equal).distinct(), "late_lines")
    rest = live.join(late.withColumn("late", F.lit(1)), ["rid", "line"], "left").select(*_COLUMNS, F.when(F.col("late").isNull(), 1).otherwise(0).alias("open"))
    rest = rest.repartition("word").sortWithinPartitions("word", "n").mapInArrow(_meet_all(percent), "rid bigint, line int, rid0 bigint, line0 int")
    second = save(rest.distinct().join(first, ["rid", "line", "rid0", "line0"], "left_anti"), "second_pairs")
    return late.unionByName(_confirmed(second, texts, percent)).distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, lines_of, removed, emptied = [], [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            lines, gone = [] if text is None else text.split("\n"), set(gone or ())
            rest = [x for i, x in enumerate(lines) if i not in gone]
            kept.append(text if not gone else "\n".join(rest))
            lines_of.append(len(lines))
            removed.append(len(gone))
            emptied.append(bool(gone) and not any(x.strip(" \t\n\r\x0b\x0c") for x in rest))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()), pa.array(lines_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(emptied, pa.bool_())], ["row", "text", "n_lines", "n_removed", "emptied"])


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(row, text, n_lines, n_removed, emptied): the other columns of each row of ``docs`` as a struct, its text without the repeated lines, and whether that took its last words."""
    rows = numbered(docs)
    found = save(_repeated(rows, percent), "repeated_lines")
    gone = found.groupBy("rid").agg(F.collect_set("line").alias("gone"))
    both = _with_lists(rows, gone, found.count(), "left").select("row", "text", "gone")
    fields = [both.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("emptied", T.BooleanType())]
    return both.mapInArrow(_cut, T.StructType(fields))
