"""Toxic passages by maximum-scoring segment search over token log-odds.

*Model*, fitted on a bounded sample of labelled texts: for each token the log-odds of appearing in a toxic rather than a clean
text, with a Dirichlet prior that has the token's pooled share as its mean (Monroe et al., 2008). Tokens whose log-odds are
significant (z above ``Z``) and at least ``ODDS`` get it as their score, capped at ``CAP``; all others get the same negative score, chosen so that a random clean
token stream drifts down. The scores of a clean stream fix the Karlin-Altschul parameters lambda (the root of the moment equation) and K (from the
sample's clean maxima), so a segment score S in a text of n tokens has E = K n exp(-lambda S) and is significant when 1 - exp(-E) is small.

*Search*: Ruzzo and Tompa's scan gives all maximal scoring segments of a whole text in linear time. The evidence of a text is
the sum of -log10 E over its significant segments, so several passages add up; a logistic curve fitted on the same sample maps it to a probability.

Tokens are maximal runs of ASCII letters, digits, `'`, and all bytes above 0x7F; A-Z count as a-z.

Defined cases: null and empty texts have no tokens and score as a text without evidence does; without toxic or without clean labelled
texts there is no evidence to learn and every score is the smoothed share of toxic labels; labels above 0 are toxic, null ones none; a doc_id with several labels is toxic if any is;
rows repeat as they are given; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import near_dup
from tidemark.llm import words as W
from tidemark.llm.scratch import save, small_batches
from tidemark.llm.words import U, runs, signed, utf8

Z = 2.5
ODDS = 1.5
BASE = 0.5
CAP = 6.0
SIGNIFICANT = 0.05
SAMPLE = 20_000
COPIES = 12

#: Bytes that end a token, for a copy of the text in which they read as spaces.
_PLAIN = np.full(256, 32, np.uint8)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PLAIN[_lo:_hi] = np.arange(_lo, _hi)
_PLAIN[39] = 39


@dataclass(frozen=True)
class Model:
    """``tokens``: sorted hashes of the scored tokens and ``odds`` their scores; ``other``: the score of any other token."""

    tokens: np.ndarray
    odds: np.ndarray
    other: float
    lam: float
    k: float
    bias: float
    slope: float


def token_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """The token hashes of each row, in order."""
    data, offsets = utf8(column)
    for a, b in runs(offsets):
        base = offsets[a]
        starts, h = W.words(_PLAIN[data[base : offsets[b]]], offsets[a:b] - base)
        bounds = np.searchsorted(starts, offsets[a : b + 1] - base)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield h[lo:hi]


def segments(hits: np.ndarray, odds: np.ndarray, n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of n tokens of which those at ``hits`` score ``odds`` and the rest ``other`` < 0.

    Ruzzo and Tompa's algorithm; a run of negative scores only lowers the running sum, so one step per positive token is enough.
    """
    stack: list[list] = []  # start, end, sum before, sum after, index of the nearest earlier entry with a smaller sum before
    total, last = 0.0, -1
    for at, s in zip(hits.tolist(), odds.tolist()):
        total += other * (at - last - 1)
        last = at
        new = [at, at + 1, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new.append(j)
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(x[0], x[1], x[3] - x[2]) for x in stack]


def evidence(h: np.ndarray, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of -log10 E over the significant segments, and these segments in tokens."""
    if not len(h) or not len(model.tokens):
        return 0.0, []
    at = np.minimum(np.searchsorted(model.tokens, h), len(model.tokens) - 1)
    hits = np.flatnonzero(model.tokens[at] == h)
    if not len(hits):
        return 0.0, []
    total, found = 0.0, []
    for start, end, s in segments(hits, model.odds[at[hits]], len(h), model.other):
        log_e = np.log(model.k * len(h)) - model.lam * s
        if -np.expm1(-np.exp(min(log_e, 50.0))) <= SIGNIFICANT:
            total -= log_e / np.log(10)
            found.append((start, end, s))
    return float(total), found


def _share(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.bias + model.slope * x, -40, 40)))


def _lambda(score: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    lo, hi = 1e-9, 1.0
    moment = lambda x: float(np.sum(p * np.exp(np.clip(x * score, -700, 700)))) - 1
    while moment(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and token counts by label; a token counts once a text."""
    for batch in batches:
        rows = [[], []]
        for h, toxic in zip(token_hashes(batch.column("text")), batch.column("toxic").to_pylist()):
            rows[toxic].append(np.unique(h))
        for toxic in (0, 1):
            if rows[toxic]:
                token, n = np.unique(np.concatenate(rows[toxic]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"token": pa.array(signed(token)), "toxic": pa.array(n * toxic), "clean": pa.array(n * (1 - toxic))})


def _evidence_of(model: Model, more: bool = False):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], []
            for h in token_hashes(batch.column("text")):
                found.append(evidence(h, model))
                n.append(len(h))
            x = np.array([f[0] for f in found], float)
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            if more:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                out |= {"score": pa.array(_share(model, x)), "n_tokens": pa.array(n, pa.int64()), "passages": pa.array([[dict(zip(("start", "end", "score"), s)) for s in f[1]] for f in found], kind)}
            else:
                top = [max((s[2] for s in f[1]), default=0.0) for f in found]
                out |= {"x": pa.array(x), "top": pa.array(top, pa.float64()), "n_tokens": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_pydict(out)

    return scan


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic curve with a weak prior on both, by Newton steps."""
    f = np.stack([np.ones_like(x), np.minimum(x, 50)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        grad = f.T @ (p - y) + 1e-2 * w
        hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def _without_copies(rows: DataFrame) -> DataFrame:
    """(text, toxic) of ``rows`` (doc_id, text, toxic) without near copies, which would make all words of a text telling: of texts with one label whose signatures over the whole
    texts agree in ``COPIES`` of 16 coordinates, that of the smallest doc_id stays. They meet in one of the first four coordinates. The sample is bounded, so what leads a coordinate may be broadcast."""
    read = save(near_dup.signatures(rows, keep=("doc_id", "text", "toxic")), "labelled")
    left = read.drop("text").distinct()
    for c in range(4):
        met = F.col("signature")[c].alias("met")
        led = left.groupBy(met, "toxic").agg(F.min(F.struct("doc_id", "whole", "signature")).alias("first"))
        agree = F.size(F.filter(F.zip_with("signature", F.col("first.signature"), lambda a, b: a == b), lambda x: x))
        itself = F.struct("doc_id", "whole") == F.struct("first.doc_id", "first.whole")
        left = save(left.withColumn("met", met).join(F.broadcast(led), ["met", "toxic"]).where(itself | (agree < COPIES)).drop("met", "first"), "apart")
    kept = F.broadcast(left.select("doc_id", "whole", "toxic"))
    return read.join(kept, ["doc_id", "whole", "toxic"], "left_semi").dropDuplicates(["doc_id", "whole", "toxic"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` distinct labelled texts, chosen by a hash of doc_id; all of them where there are no more.

    The bound keeps what comes to the driver (the significant tokens and three numbers a text) of a fixed size.
    """
    small_batches(docs.sparkSession)
    by_id = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = by_id.count()
    part = 1_000_000 if n <= sample else max(1, 1_000_000 * sample // n)
    chosen = by_id.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < part)
    # the labels that may be learned from number 2 * sample at most, checked above, so they are small enough to broadcast
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = _without_copies(rows).persist()
    try:
        counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        bad, good = counts.get(1, 0), counts.get(0, 0)
        none = Model(np.zeros(0, U), np.zeros(0), -1.0, 1.0, 1.0, float(np.log((bad + 1) / (good + 9))), 0.0)
        if not bad or not good:
            return none
        toxic, clean = F.col("toxic"), F.col("clean")
        pooled = toxic + clean
        # the prior: PRIOR texts of each kind with the pooled shares, and BASE texts for any token, or one that no clean text has would never be significant
        a = F.lit(PRIOR) * pooled / F.lit(float(bad + good)) + F.lit(BASE)
        odds = F.log((toxic + a) / (F.lit(bad + PRIOR) - toxic - a)) - F.log((clean + a) / (F.lit(good + PRIOR) - clean - a))
        z = odds / F.sqrt(1 / (toxic + a) + 1 / (clean + a))
        scored = rows.mapInArrow(_token_counts, "token bigint, toxic bigint, clean bigint").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # a token must be in three texts; with that its significance is tested
        found = scored.where("toxic >= 3").select("token", "clean", odds.alias("odds"), z.alias("z")).where((F.col("z") > Z) & (F.col("odds") > ODDS)).toPandas()
        if not len(found):
            return none
        token = found["token"].to_numpy(np.int64).view(U)
        at = np.argsort(token)
        score = np.minimum(found["odds"].to_numpy(float), CAP)[at]
        tokens_of = rows.where("toxic = 0").mapInArrow(_evidence_of(none), "toxic int, x double, top double, n_tokens bigint").agg(F.sum("n_tokens"), F.count("*")).first()
        # a clean token scores as its share among clean texts says; the rest drift down by twice the mean gain
        p = np.minimum(found["clean"].to_numpy(float)[at] + 0.5, good) / max(1.0, float(tokens_of[0] or 1))
        other = -max(0.25, 2 * float(np.sum(p * score)) / max(1e-9, 1 - p.sum()))
        lam = _lambda(np.append(score, other), np.append(p, max(1e-9, 1 - p.sum())))
        model = Model(token[at], score, other, lam, 1.0, 0.0, 0.0)
        tops = rows.mapInArrow(_evidence_of(Model(model.tokens, score, other, lam, 1e-300, 0.0, 0.0)), "toxic int, x double, top double, n_tokens bigint").toPandas()
        base = tops[(tops["toxic"] == 0) & (tops["n_tokens"] > 0)]
        # of clean texts P(max < x) = exp(-K n exp(-lambda x)); the likeliest K for their maxima, where those without any segment are known to lie below the least score
        reach = base["n_tokens"].to_numpy(float) * np.exp(-lam * np.maximum(base["top"].to_numpy(float), score.min()))
        k = max(1, int((base["top"] > 0).sum())) / max(float(reach.sum()), 1e-300)
        model = Model(token[at], score, other, lam, max(k, 1e-12), 0.0, 0.0)
        x = rows.mapInArrow(_evidence_of(model), "toxic int, x double, top double, n_tokens bigint").select("toxic", "x").toPandas()
        bias, slope = _logistic(x["x"].to_numpy(float), x["toxic"].to_numpy(float))
        return Model(token[at], score, other, lam, max(k, 1e-12), bias, max(slope, 0.0))
    finally:
        rows.unpersist()


PRIOR = 10.0


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, with score (0 to 1), n_tokens and the significant passages (token range and score)."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(_evidence_of(model, more=True), ", ".join([*fields, "score double", "n_tokens bigint", "passages array<struct<start: bigint, end: bigint, score: double>>"]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = np.array([evidence(h, model)[0] for h in token_hashes(part.column("text"))], float)
                yield part.filter(pa.array(_share(model, x) < threshold))

    return docs.mapInArrow(run, docs.schema)
