"""Mixing sources to target weights by cube-method balanced sampling (Deville and Tillé, 2004; Chauvet and Tillé, 2006).

Each source has a target: its weight's share of all words, at most ``MOST`` times its own words, what lies above shared out again by
weight. A document is wanted target / source_size times: that many whole times, and once more with probability the fraction. The
extra copies of a source are drawn by the cube method: the fractions move along the null space of the two balancing constraints,
number of documents and number of words, until at most two of a group are undecided.

Groups are blocks of about ``BLOCK`` documents of one source, dealt by a hash of doc_id, so a source of any size is many
blocks. The undecided of all blocks form new blocks, level after level; the last block of a source is the landing problem, in which the number of documents is
given up and the number of words is met as nearly as the block's documents allow by exchanges of one or two of them. Every draw is a hash of source, level and block: reruns agree.

Defined cases: null text has size 0; a null source is a source of its own, in order after all others; documents without words are wanted as often as the
rest of their source; a source without words has target 0 and no copies; rows that repeat a doc_id are drawn each for itself; a null doc_id is dealt like any
other value; extra columns are passed through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import ranked, save

MOST = 3
BLOCK = 4096
EPS = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from rows of (source, size).

    Sources in order of code points, null last, have the weights in turn. All have level * weight, but most * size at most. The level starts as all words by all weights; as long as
    there are sources above their bound these keep the bound, and the level is what is left of the words by the weights left. Each such round is one aggregate over the sources.
    """
    per = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("bound", (most * F.col("source_size")).cast("double"))
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("bound") < F.lit(level) * F.col("weight")
        row = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("bound"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("rest"), F.count_if(above).alias("full")).first()
        if row["full"] == full or not row["rest"]:
            break
        level, full = (row["all"] - (row["held"] or 0.0)) / row["rest"], row["full"]
    return per.select("source", "source_size", "n", F.least("bound", F.lit(level) * F.col("weight")).alias("target"))


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all but at most two are 0 or 1; sums of p and of p x hold, each mean holds."""
    p = p.astype(float).copy()
    open_ = []
    for k in np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist():
        open_.append(k)
        if len(open_) == 3:
            i, j, m = open_
            u = np.array([x[j] - x[m], x[m] - x[i], x[i] - x[j]], float)
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
            _move(p, open_, u, rng)
            open_ = [q for q in open_ if EPS < p[q] < 1 - EPS]
    return np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))


def _move(p: np.ndarray, at: list[int], u: np.ndarray, rng: np.random.Generator) -> None:
    """One step along u or -u to the edge of the unit cube, each with the probability that keeps the mean."""
    now = p[at]
    up, down = np.inf, np.inf
    for q, d in zip(now.tolist(), u.tolist()):
        if d > 0:
            up, down = min(up, (1 - q) / d), min(down, q / d)
        elif d < 0:
            up, down = min(up, q / -d), min(down, (1 - q) / -d)
    step = up if rng.random() * (up + down) < down else -down
    p[at] = now + step * u


def landing(p: np.ndarray, x: np.ndarray, words: float, rng: np.random.Generator) -> np.ndarray:
    """Decide what the flight left, near ``words`` in all: the number of documents is given up, the number of words isn't.

    Of the ways to decide those the nearest to ``words`` is taken. What is still missing is made good by the fewest changes: of all single documents taken in or left out,
    and of all exchanges of two, the one that comes nearest, as long as one helps.
    """
    p = p.copy()
    rest = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    p[rest] = 0.0
    taken = p > 0.5
    ways = ((np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1).astype(bool)
    miss = np.abs(words - x[taken].sum() - ways @ x[rest])
    best = np.flatnonzero(miss <= miss.min() + EPS)
    taken[rest] = ways[best[rng.integers(len(best))]]
    order = rng.permutation(len(x))  # ties between documents of one size
    order = order[np.argsort(x[order], kind="stable")]
    while True:
        miss = words - x[taken].sum()
        out, in_ = order[~taken[order]], order[taken[order]]
        # sizes gained by a change: one document more, one less, or one more for one less
        changes = [(x[q], [q]) for q in _nearest(x[out], out, miss)] + [(-x[q], [q]) for q in _nearest(x[in_], in_, -miss)]
        if len(out) and len(in_):
            at = np.searchsorted(x[out], x[in_] + miss)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(out) - 1)):
                gain = x[out[near]] - x[in_]
                i = int(np.argmin(np.abs(miss - gain)))
                changes.append((gain[i], [out[near[i]], in_[i]]))
        gain, flips = min(changes, key=lambda c: abs(miss - c[0]), default=(0.0, []))
        if abs(miss - gain) >= abs(miss) - EPS:
            return taken.astype(float)
        taken[flips] = ~taken[flips]


def _nearest(sizes: np.ndarray, which: np.ndarray, wanted: float) -> list[int]:
    """Of ``which``, in order of ``sizes``, the two around ``wanted``."""
    at = int(np.searchsorted(sizes, wanted))
    return [int(which[i]) for i in (at - 1, at) if 0 <= i < len(which)]


def _draw(level: int, last: bool):
    def draw(group: pd.DataFrame) -> pd.DataFrame:
        # the largest are decided first, so what stays undecided is small and the landing moves few words
        group = group.sort_values(["size", "h", "doc_id", "seq"], ascending=[False, True, True, True], kind="stable")
        # the seed comes from the group's key and level alone
        rng = np.random.default_rng([level, int(group["block"].iloc[0]) & 0xFFFFFFFF, int(group["seed"].iloc[0]) & 0xFFFFFFFF])
        p, x = group["p"].to_numpy(float), group["size"].to_numpy(float)
        words = float(p @ x)
        p = flight(p, x, rng)
        if last:
            p = landing(p, x, words, rng)
        return group.assign(p=p)

    return draw


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(row, size, source_size, target, copies) for every row of ``docs`` (doc_id, text, source), the row as a struct."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"))
    # ties: rows alike in doc_id and source are numbered so that their draws can be told apart
    units = save(sized.select("doc_id", "source", "size"), "units")
    per = save(targets(units, weights).withColumn("want", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    keyed = units.groupBy("doc_id", "source", "size").agg(F.count("*").alias("same"))
    keyed = keyed.withColumn("seq", F.explode(F.sequence(F.lit(1), F.col("same").cast("int")))).drop("same")
    keyed = keyed.join(per, keyed.source.eqNullSafe(per.source)).select(keyed["*"], "n", (F.col("want") - F.floor("want")).alias("p"))
    h = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("seq"))
    todo = keyed.where("p > 0").withColumn("h", h).withColumn("seed", F.xxhash64(F.coalesce("source", F.lit("\0"))))
    most = per.agg(F.max("n")).first()[0] or 0
    kind = "doc_id bigint, source string, size bigint, seq int, n bigint, p double, h bigint, seed bigint, block bigint"
    decided, level = [], 0
    while True:
        last = most <= BLOCK
        # about BLOCK undecided documents a block; the undecided of a level are two of a block at most
        blocks = F.ceil(F.col("n") / F.lit(float(BLOCK)))
        todo = todo.withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), blocks))
        todo = save(todo.groupBy("source", "block").applyInPandas(_draw(level, last), kind), "draws")
        decided.append(todo.where("p in (0.0, 1.0)").select("doc_id", "source", "size", "seq", "p"))
        if last:
            break
        todo = todo.where("p not in (0.0, 1.0)").drop("block").withColumn("n", 2 * F.ceil(F.col("n") / F.lit(float(BLOCK))))
        most, level = 2 * -(-most // BLOCK), level + 1
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    extra = extra.where("p = 1.0").groupBy("doc_id", "source", "size").agg(F.collect_set("seq").alias("extra"))
    # a row's number among its equals decides which of them have the extra copy; alone, a row is number 1
    return _with_copies(sized, units, per, extra)


def _with_copies(sized: DataFrame, units: DataFrame, per: DataFrame, extra: DataFrame) -> DataFrame:
    key = ["doc_id", "source", "size"]
    repeated = units.groupBy(*key).agg(F.count("*").alias("same")).where("same > 1").limit(1).count() > 0
    if repeated:
        sized = sized.withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row"))))
    else:
        sized = sized.withColumn("seq", F.lit(1))
    has = extra.select(*[F.col(k).alias(f"x_{k}") for k in key], "extra")
    same = [sized[k].eqNullSafe(has[f"x_{k}"]) for k in key]
    # documents with an extra copy: as many as the input in the worst case, so the join is left to the planner
    both = sized.join(has, same[0] & same[1] & same[2], "left")
    rates = per.select(F.col("source").alias("x_source2"), "source_size", "target", F.floor("want").cast("int").alias("whole"))
    both = both.join(rates, both.source.eqNullSafe(rates.x_source2), "left")
    copies = F.col("whole") + F.coalesce(F.array_contains("extra", F.col("seq")), F.lit(False)).cast("int")
    return both.select("row", "size", "source_size", "target", copies.alias("copies"))
