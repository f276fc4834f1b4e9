"""Phrase search, fused channels and walks against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F
from tidemark.operators import graph, postings


def _terms(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower().replace("_", " ")) if w]


def search_by_definition(chunks, queries, k=10, k1=1.2, b=0.75):
    """Every query against every chunk; phrases are counted where all their words stand in a row."""
    told = {c: (kind, _terms(t)) for c, kind, t in chunks}
    n, avgdl = len(chunks), sum(len(w) for _, w in told.values()) / len(chunks)

    def count(words, phrase):
        return sum(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))

    out = []
    for q, text in queries:
        wanted = Counter(tuple(_terms(t)) for t in (text or "").split() if _terms(t))
        tf = {p: {c: x for c, (_, w) in told.items() if (x := count(w, list(p)))} for p in wanted}
        found = []
        for c, (kind, w) in told.items():
            if wanted and kind == "body" and all(c in tf[p] for p in wanted):
                idf = {p: max(math.log((n - len(tf[p]) + 0.5) / (len(tf[p]) + 0.5)), 1e-6) for p in wanted}
                found.append((-round(sum(m * idf[p] * tf[p][c] * (k1 + 1) / (tf[p][c] + k1 * (1 - b + b * len(w) / avgdl)) for p, m in wanted.items()), 6), c))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["lot", "22b", "cs", "40350", "the", "the", "the", "a", "ab"])
    chunks = [(i, rng.choice(["body", "body", "quoted"]), rng.choice([" ", "-"]).join(word() for _ in range(rng.randrange(0, 12)))) for i in range(150)] + [(150, "body", None), (151, "body", "the THE the the"), (152, "signature", "cs-40350 only here zebra")]
    queries = [(0, "CS-40350"), (1, "the"), (2, "the lot-22b"), (3, "the-the-the"), (4, "the the"), (5, None), (6, " -- "), (7, "zebra"), (8, "unknown the"), (9, "the-unknown"), (10, "-- cs-40350-the"), (11, "a-ab the"), (12, "CS-40350")]
    queries += [(20 + i, rng.choice([" ", "-"]).join(word() for _ in range(rng.randrange(1, 4)))) for i in range(60)]
    c = spark.createDataFrame(chunks, "chunk_id long, kind string, text string")
    got = postings.search(postings.postings(c), c, spark.createDataFrame(queries, "query_id long, query string"))
    want = search_by_definition(chunks, queries)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == [w[:3] for w in want]
    scores = {(r.query_id, r.chunk_id): r.score for r in got.collect()}
    assert all(abs(scores[q, c] - s) < 2e-6 for q, _, c, s in want) and len(want) > 100


def test_search_shuffles_no_postings_and_answers_in_several_readings(spark, monkeypatch):
    monkeypatch.setattr(postings, "ASKS", 3)
    monkeypatch.setattr(postings, "PAIRS", 7)
    chunks = [(i, "body", f"aa w{i % 5} w{i % 3} bb") for i in range(60)]
    queries = [(i, f"aa w{i % 5}-w{i % 3}") for i in range(15)]
    c = spark.createDataFrame(chunks, "chunk_id long, kind string, text string").repartition(3)
    got = postings.search(None, c, spark.createDataFrame(queries, "query_id long, query string"), k=2)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got.collect()) == [w[:3] for w in search_by_definition(chunks, queries, k=2)]
    # what is shuffled to be ranked are the best hits of each part alone: no join by chunk or phrase
    assert "chunk_id" not in " ".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x)


def test_postings_count_words_and_places(spark):
    c = spark.createDataFrame([(1, "body", "b a-B. é"), (2, "body", ""), (3, "quoted", None)], "chunk_id long, kind string, text string")
    assert [tuple(r) for r in postings.postings(c).orderBy("term").collect()] == [(1, "body", 4, "a", 1, [1]), (1, "body", 4, "b", 2, [0, 2]), (1, "body", 4, "é", 1, [3])]
    none = c.where(F.lit(False))
    assert postings.search(postings.postings(none), none, spark.createDataFrame([(1, "a")], "query_id long, query string")).collect() == []


def test_best_neighbours_equal_the_full_walk(spark):
    rng = random.Random(5)
    e = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", round(rng.random() ** 3, 3)) for _ in range(260)] + [("hub", f"n{i}", 0.01 * i) for i in range(40)] + [("n1", "n1", 0.9), ("n2", "n3", 0.0)]
    edges = spark.createDataFrame(e, "src string, dst string, weight double")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(40)] + [("hub",), ("nobody",)], "entity_id string")
    weight = {}
    for a, b, w in e:
        for x, y in ((a, b), (b, a)):
            if x != y and w > 0:
                weight.setdefault(x, {})[y] = max(w, weight.get(x, {}).get(y, 0))

    def walk(start, decayed):
        one = weight.get(start, {})
        best = {n: (w, 1) for n, w in one.items()}
        for m, w in one.items():
            for n, v in weight[m].items():
                if n != start and not (decayed and n in one):
                    s = w * v * (0.5 if decayed else 1)
                    if s > best.get(n, (0, 0))[0]:
                        best[n] = (s, 2)
        return best

    for decayed, f in ((False, graph.neighbors_weighted), (True, graph.neighbors_decayed)):
        whole = {(r.start, r.node): (r.score, r.hop) for r in f(edges, starts).collect()}
        assert whole == {(s, n): v for s in [*(f"n{i}" for i in range(40)), "hub"] for n, v in walk(s, decayed).items()}
        for k in (1, 7, 500):
            got = {(r.start, r.node): (r.score, r.hop) for r in f(edges, starts, k=k).collect()}
            want = {}
            for s in {s for s, _ in whole}:
                ranked = sorted((-v[0], n) for (t, n), v in whole.items() if t == s)[:k]
                want |= {(s, n): whole[s, n] for _, n in ranked}
            assert got == want


def test_graph_search_of_few_nodes_equals_that_of_all(spark):
    rng = random.Random(6)
    m = sorted({(rng.randrange(60), f"e{rng.randrange(25)}") for _ in range(300)})
    mentions = spark.createDataFrame(m, "email_id long, entity_id string")
    edges = spark.createDataFrame([(f"e{rng.randrange(25)}", f"e{rng.randrange(25)}", round(rng.random(), 3)) for _ in range(120)], "src string, dst string, weight double").where("src != dst")
    sal = spark.createDataFrame([(f"e{i}", (i % 5) / 5) for i in range(25)], "entity_id string, salience double")
    anchors, targets = mentions.select("email_id").where("email_id < 20"), mentions.select("email_id").where("email_id % 3 != 0")
    got = [sorted(map(tuple, graph.graph_search(edges, mentions, sal, anchors, 5, targets, width).collect())) for width in (2, 6, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 50 and all(r[2] % 3 for r in got[0])


def test_first_chunks(spark):
    c = spark.createDataFrame([(1, 2, "1:2", "body"), (1, 1, "1:1", "body"), (1, 0, "1:0", "quoted"), (2, 0, "2:0", "signature")], "email_id long, ord int, chunk_id string, kind string")
    assert [tuple(r) for r in graph.first_chunks(c).collect()] == [(1, "1:1")]


def test_whole_neighbour_queries_keep_every_node(spark, data):
    from tidemark.plans.catalog import QUERIES

    # each start reaches more than twenty nodes on these tables, and all of them are told
    for name in ("neighbors_weighted", "neighbors_decayed"):
        per = QUERIES[name](spark, data).groupBy("start").count().collect()
        assert per and max(r["count"] for r in per) > 20


def test_graph_search_walks_no_second_hop_without_need(spark, monkeypatch):
    m = [(i, "p") for i in range(40)] + [(100, "a"), (101, "b"), (102, "a")]
    mentions = spark.createDataFrame(m, "email_id long, entity_id string")
    edges = spark.createDataFrame([("a", "p", 0.9), ("b", "p", 0.8), ("a", "b", 0.1)], "src string, dst string, weight double")
    sal = spark.createDataFrame([(e, 1.0) for e in "abp"], "entity_id string, salience double")
    # the full walk isn't needed, as the nearest node has messages enough
    monkeypatch.setattr(graph, "neighbors_decayed", None)
    found = graph.graph_search(edges, mentions, sal, spark.createDataFrame([(100,)], "email_id long"), 5)
    assert [(r.email_id, r.score) for r in found.orderBy("rank").collect()] == [(i, 0.9) for i in range(5)]


def test_signals_need_their_words(spark):
    from pyspark.sql import functions as F
    from tidemark.functions import text as T

    said = [
        "Are you free", "when are you AVAILABLE", "your availability", "let me know what times", "set up a call", "line up\tan interview", "book our catch-up", "find some time", "Re-Schedule it", "push back our long meeting",
        "does noon work for you", "what time works", "when works", "works for you", "calendar invite", "meeting request", "send over an invite", "block off 30 mins", "block 2hours", "pencil us in", "hop on a zoom", "grab a coffee",
        "standup", "catch up", "calendar", "available", "timeslot", "Tuesday", "next week", "3 PM", "12:30am", "9:15", "google meet", "evening", "free", "nothing", "",
    ]
    df = spark.createDataFrame([(s,) for s in said], "said string")
    f = T.scheduling_signals(F.lit(None).cast("string"), F.col("said"), F.lit("text/plain"), F.lit(False)).reasons
    whys = dict.fromkeys(T.STRONG_WHY) | dict.fromkeys(T.WEAK_WHY)
    plain = F.array_compact(F.array(*[F.when(F.col("said").rlike("(?i)" + p), F.lit(w)) for p, w in zip(T.STRONG + T.WEAK, T.STRONG_WHY + T.WEAK_WHY, strict=True)]))
    rows = df.select(f.alias("got"), plain.alias("want")).collect()
    assert len(T.STRONG_NEEDS) == len(T.STRONG) and len(T.WEAK_NEEDS) == len(T.WEAK)
    assert all(r.got == r.want for r in rows) and {w for r in rows for w in r.want} == set(whys)
