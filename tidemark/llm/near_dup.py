"""MinHash near-duplicate detection by an inverted join over signature coordinates.

A document's set is its distinct five-word shingles (with one to four words the whole sequence is the only member; without
words it is empty and linked with nothing). Texts are linked when 100 * intersection >= percent * union, and documents
are grouped by the connected components of the links.

Every step is a Spark job:

1. *Features*: set size, a 128-bit hash of the whole set and K minimum hashes per document. Documents with equal sets fall
   into one class, so groups of exact copies cost one row from here on, however large.
2. *Postings*: a class is posted under its coordinate-value pairs. Of K coordinates a pair must share at least
   ``MATCHES``, so it must meet in one of the K - MATCHES + 1 rarest coordinates of both (prefix filter); only these are posted.
   Rarity is counted over all classes in a table of fixed size.
3. *Collisions*: in the first list that both are in a pair's remaining coordinates are compared at once (skip merging) and it is retained at
   MATCHES or more, if set sizes allow the similarity at all.
   First every member meets only two members of its list, the oldest and the one with the most frequent coordinates; once those links
   have made components, the second pass compares members that are still in different components. Pairs inside a component can't
   change the result and are never made. Nor are pairs of which one side has too many shingles that no other open class has.
4. *Verification*: retained pairs are confirmed on their full shingle sets.

Chance decides recall only through step 2: a pair at similarity 0.85 shares fewer than 6 of 16 coordinates with probability 2e-6.

Defined cases: null text counts as empty; rows that share a doc_id count as one document; a null doc_id is numbered last
(the largest long) and comes back as null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import components
from tidemark.llm.scratch import save, semi, small_batches
from tidemark.llm.words import U, mix, runs, signed, utf8, words

K = 16
MATCHES = 6
WIDTH = 5
NO_ID = (1 << 63) - 1
BUCKETS = 1 << 16

_A = mix(np.arange(1, K + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_B = mix(np.arange(101, K + 101, dtype=U) * U(0x9E3779B97F4A7C15))
_SALTS = (U(0x51ED270B), U(0x2545F4914F6CDD1D))
_PLACE = mix(np.arange(201, WIDTH + 201, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for a, b in runs(offsets):
        base = offsets[a]
        starts, hashes = words(data[base : offsets[b]], offsets[a:b] - base)
        bounds = np.searchsorted(starts, offsets[a : b + 1] - base)
        n = len(hashes)
        rolled = np.zeros(max(0, n - WIDTH + 1), U)
        for j in range(WIDTH if n >= WIDTH else 0):
            rolled += hashes[j : n - WIDTH + 1 + j] * _PLACE[j]
        rolled = mix(rolled)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= WIDTH:
                s = np.sort(rolled[lo : hi - WIDTH + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif hi > lo:
                yield mix(np.array([np.sum(hashes[lo:hi] * _PLACE[: hi - lo])], U) + U(hi - lo))
            else:
                yield np.zeros(0, U)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids = batch.column("rid")
        done = 0
        pending: list[np.ndarray] = []

        def flush():
            nonlocal done, pending
            sizes = np.array([len(s) for s in pending], np.int64)
            some = sizes > 0
            every = np.concatenate(pending) if some.any() else np.zeros(0, U)
            begin = (np.cumsum(sizes) - sizes)[some]
            out = {}
            for name, salt in zip(("h1", "h2"), _SALTS):
                whole = np.zeros(len(pending), U)
                if len(every):
                    whole[some] = np.add.reduceat(mix(every ^ salt), begin)
                out[name] = pa.array(signed(whole))
            for j in range(K):
                low = np.zeros(len(pending), U)
                if len(every):
                    low[some] = np.minimum.reduceat(every * _A[j] + _B[j], begin)
                out[f"s{j}"] = pa.array((low >> U(32)).astype(np.uint32).view(np.int32))
            made = pa.RecordBatch.from_pydict({"rid": ids.slice(done, len(pending)), "n": pa.array(sizes), **out})
            done, pending = done + len(pending), []
            return made

        held = 0
        for s in shingle_sets(data, offsets):
            pending.append(s)
            held += len(s)
            if held > 200_000:
                yield flush()
                held = 0
        if pending:
            yield flush()


def signatures(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, a hash of the whole shingle set and the K minimum hashes of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered_ = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["rid", "text"])
            for made in _features(iter([numbered_])):
                lows = np.stack([made.column(f"s{j}").to_numpy() for j in range(K)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lows.size + 1, K, np.int32)), pa.array(lows.ravel()))
                yield pa.RecordBatch.from_pydict({c: batch.column(c).take(made.column("rid")) for c in keep} | {"whole": made.column("h1"), "signature": lists})

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*fields, "whole bigint", "signature array<int>"]))


_SIG = ", ".join(f"s{j} int" for j in range(K))
_KEY = [f"s{j}" for j in range(K)]


def _postings(counts: np.ndarray):
    """Each class under its rarest coordinate-value pairs."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([batch.column(k).to_numpy().view(np.uint32) for k in _KEY], axis=1).astype(U)
            key = (np.arange(K, dtype=U) << U(32))[None, :] | sig
            spread = mix(key)
            rarity = counts[(spread >> U(48)).astype(np.int64)]
            order = np.lexsort((spread, rarity), axis=1)[:, : K - MATCHES + 1]
            rows = np.repeat(np.arange(batch.num_rows), K - MATCHES + 1)
            common = pa.array(rarity.sum(axis=1)[rows])
            posted = np.take_along_axis(key, order, axis=1)
            m = posted.shape[1]
            before = np.concatenate([posted[:, :i] for i in range(m)], axis=1).ravel()
            ends = np.cumsum(np.append(0, np.tile(np.arange(m), batch.num_rows)))
            before = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(before)))
            posted = posted.ravel()
            yield pa.RecordBatch.from_pydict({"key": pa.array(signed(posted)), "common": common, "before": before, **{c: batch.column(c).take(pa.array(rows)) for c in ("rid", "n", "h1", "h2", *_KEY)}})

    return post


def _bucket_counts(classes: DataFrame) -> np.ndarray:
    """How many classes have each coordinate-value pair, by 2^16 hashed buckets: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for j, k in enumerate(_KEY):
                key = U(j << 32) | batch.column(k).to_numpy().view(np.uint32).astype(U)
                total += np.bincount((mix(key) >> U(48)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some.astype(np.int32)), "n": pa.array(total[some])})

    found = classes.select(*_KEY).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_sets(*utf8(batch.column(c))) for c in ("text_a", "text_b")]
            good = []
            for x, y in zip(*sets):
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(len(x) > 0 and len(y) > 0 and 100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return verify


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v), those whose full sets are similar enough."""
    ids = pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid"))).distinct()
    some = semi(texts, ids, "rid")
    of = lambda side, name: some.select(F.col("rid").alias(side), F.col("text").alias(name))
    both = pairs.join(of("u", "text_a"), "u").join(of("v", "text_b"), "v").select("u", "v", "text_a", "text_b")
    return both.mapInArrow(_verify(percent), "u bigint, v bigint").distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of every text, with the two hashes of the text's whole set."""

    def made(sets: list[np.ndarray]) -> pa.RecordBatch:
        every, sizes = np.concatenate(sets), [len(s) for s in sets]
        begin = np.cumsum(sizes) - sizes
        whole = {name: pa.array(signed(np.repeat(np.add.reduceat(mix(every ^ salt), begin), sizes))) for name, salt in zip(("h1", "h2"), _SALTS)}
        return pa.RecordBatch.from_pydict(whole | {"shingle": pa.array(signed(every))})

    for batch in batches:
        held: list[np.ndarray] = []
        shingles = 0
        for s in shingle_sets(*utf8(batch.column("text"))):
            if len(s):
                held.append(s)
                shingles += len(s)
            if shingles > 50_000:
                yield made(held)
                held, shingles = [], 0
        if held:
            yield made(held)


def _shared_part(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``rest`` with the number of shingles that each class shares with any other class of ``rest``.

    A class can only have in common with another what it shares with any, so one whose own shingles alone already hold the
    similarity below the threshold has no link left to find, and goes. In a large group of copies with edits of their own, most go.
    """
    kind = "h1 bigint, h2 bigint, shingle bigint"
    some = semi(texts, rest.select("rid").distinct(), "rid").mapInArrow(_shingle_rows, kind)
    alone = some.groupBy("shingle").agg(F.count("*").alias("in"), F.min("h1").alias("h1"), F.min("h2").alias("h2")).where("in = 1")
    alone = alone.groupBy("h1", "h2").agg(F.count("*").alias("alone"))
    rest = rest.join(alone, ["h1", "h2"], "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
    return rest.where(F.col("shared") * 100 >= F.col("n") * percent).drop("alone")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, kept is doc_id = component_id.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), "text")
    small_batches(docs.sparkSession)
    features = save(texts.mapInArrow(_features, f"rid bigint, n bigint, h1 bigint, h2 bigint, {_SIG}"), "features")
    classes = save(features.where("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), *[F.first(k).alias(k) for k in _KEY]), "classes")
    owned = save(features.join(classes.select("h1", "h2", F.col("rid").alias("own")), ["h1", "h2"], "left").select("rid", "n", "own"), "owned")
    first_own = owned.groupBy("rid").agg(F.min("own").alias("v"))
    same_id = owned.join(first_own, "rid").select(F.col("own").alias("u"), "v").where("u != v").distinct()
    posted = save(classes.mapInArrow(_postings(_bucket_counts(classes)), f"key bigint, common bigint, before array<bigint>, rid bigint, n bigint, h1 bigint, h2 bigint, {_SIG}"), "postings")

    a, b = ([F.col(f"{side}.{k}") for k in _KEY] for side in "ab")
    collide = reduce(lambda x, y: x + y, [(x == y).cast("int") for x, y in zip(a, b)]) >= MATCHES
    size = (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent) & collide

    own = F.struct("rid", "n", *_KEY)
    lists = posted.groupBy("key").agg(F.count("*").alias("members"), F.min(own).alias("oldest"), F.max(F.struct("common", own.alias("own"))).alias("central"))
    hubs = lists.where("members > 1").select("key", F.explode(F.array_distinct(F.array("oldest", "central.own"))).alias("hub")).select("key", "hub.*")
    first = hubs.alias("a").join(posted.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") != F.col("b.rid")) & size)
    first = save(first.select(F.least("a.rid", "b.rid").alias("u"), F.greatest("a.rid", "b.rid").alias("v")).distinct(), "hub_pairs")
    links = save(confirmed(first, texts, percent).unionByName(same_id), "links")
    label = save(components.connected(links), "labels")

    labelled = posted.join(label, posted.rid == label.node, "left").select(posted["*"], F.coalesce("component", "rid").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = save(labelled.join(mixed, "key", "left_semi"), "open_lists")
    for _ in range(2):  # what goes in the first round leaves others with more shingles of their own
        rest = save(_shared_part(rest.drop("shared"), texts, percent), "open_postings")
    shared = F.least("a.shared", "b.shared") * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent
    second = rest.alias("a").join(rest.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") < F.col("b.rid")) & (F.col("a.component") != F.col("b.component")) & shared & size & ~F.arrays_overlap("a.before", "b.before"))
    second = second.select(F.col("a.rid").alias("u"), F.col("b.rid").alias("v")).distinct().join(first, ["u", "v"], "left_anti")
    more = confirmed(save(second, "open_pairs"), texts, percent)
    label = components.connected(links.unionByName(more))

    known = owned.join(label.withColumnRenamed("node", "own"), "own", "left").select("rid", "n", F.coalesce("component", "own", "rid").alias("component"))
    doc_id, component = (F.when(F.col(c) != NO_ID, F.col(c)) for c in ("rid", "component"))
    return known.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("rid") == F.col("component")).alias("kept"))
