"""Evidence kept up by deltas against what is computed anew."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from tidemark.operators import evidence, graph

MENTION = "email_id long, entity_id string, kind string, confidence double"


def mentions(rng, ids):
    kinds = ["person", "case", "project", "org"]
    return [(e, f"{kinds[k % 4]}:{k}", kinds[k % 4], rng.choice([0.4, 0.9, 1.0])) for e in ids for k in rng.sample(range(14), 4)]


def test_deltas_equal_recomputation(spark):
    """Messages are added, changed and removed; sums, sets and fingerprints end as if they had been computed from what is left."""
    rng = random.Random(7)
    old, changed_new = mentions(rng, range(60)), mentions(rng, range(50, 70))
    before, after = spark.createDataFrame(old, MENTION), spark.createDataFrame([m for m in old if m[0] < 45] + changed_new, MENTION)
    gone, come = before.where("email_id >= 45"), spark.createDataFrame(changed_new, MENTION)
    sums = evidence.pair_sums(evidence.pairs(before))
    delta = evidence.pair_sums(evidence.pairs(come)).unionByName(evidence.pair_sums(evidence.pairs(gone), -1))
    kept = evidence.applied(sums, evidence.changed(sums, delta, evidence.PAIR), evidence.PAIR, "n")
    whole = evidence.pair_sums(evidence.pairs(after))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(kept) == rows(whole) and kept.where("n <= 0").count() == 0
    keys = ["entity_id", "kind"]
    counts = evidence.entity_counts(before)
    counts = evidence.applied(counts, evidence.changed(counts, evidence.entity_counts(come).unionByName(evidence.entity_counts(gone, -1)), keys), keys, "df")
    weights = {r[:3]: r[3:] for r in rows(evidence.weigh(kept, counts, after.agg(F.count_distinct("email_id").alias("n"))))}
    want = {r[:3]: r[3:] for r in rows(graph.relations(after))}
    assert weights.keys() == want.keys() and all(abs(weights[k][0] - want[k][0]) < 2e-4 and weights[k][1] == want[k][1] for k in want)
    sets = evidence.id_sets(evidence.pairs(before), evidence.PAIR, 16)
    changes = evidence.changed_sets(sets, evidence.pairs(come), evidence.pairs(gone), evidence.PAIR, 16)
    merged = sets.join(changes, [*evidence.PAIR, "chunk"], "left_anti").unionByName(changes.where(F.size("ids") > 0))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, evidence.id_sets(evidence.pairs(after), evidence.PAIR, 16).collect()))
    prints = lambda df, sign=1: evidence.fingerprint_sums(df, ["entity_id"], F.col("email_id"), sign)
    state = prints(before)
    state = evidence.applied(state, evidence.changed(state, prints(come).unionByName(prints(gone, -1)), ["entity_id"]), ["entity_id"], "emails")
    assert rows(evidence.fingerprints(state, ["entity_id"])) == rows(evidence.fingerprints(prints(after), ["entity_id"]))


def test_one_new_message_touches_its_pairs_only(spark):
    rng = random.Random(1)
    sums = evidence.pair_sums(evidence.pairs(spark.createDataFrame(mentions(rng, range(40)), MENTION)))
    new = spark.createDataFrame(mentions(rng, [99]), MENTION)
    assert evidence.changed(sums, evidence.pair_sums(evidence.pairs(new)), evidence.PAIR).count() == evidence.pairs(new).count() <= 6


def test_unmoved_briefs_are_untouched(spark):
    stored = spark.createDataFrame([("case", "a", "h", "b", ["x"], "1", 5), ("case", "b", "h", "b", ["x"], "1", 5), ("case", "c", "h", "b", ["x"], None, 5)], "node_type string, node_id string, headline string, body string, open_items array<string>, hash string, generated_at long")
    now = spark.createDataFrame([("case", "a", "1"), ("case", "b", "2"), ("case", "c", "1"), ("case", "d", "1")], "node_type string, node_id string, hash string")
    got = sorted(map(tuple, evidence.mark_dirty(stored, now).collect()))
    assert got == [("case", n, None, None, [], h, None) for n, h in (("b", "2"), ("c", "1"), ("d", "1"))]


def test_mentions_are_dealt_by_message_in_parts_that_grow(spark, data, monkeypatch):
    from tidemark.operators import evidence, graph
    from tidemark.sources import tables, views

    assert tables.parts(spark, 10_000_000) == 100 and tables.parts(spark, 1) == spark.sparkContext.defaultParallelism
    m = views.mentions(spark, data)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # what is counted or joined by message needs no shuffle of its own
    base = plan(m).count("Exchange hashpartitioning")
    assert plan(graph.cooccurrence(m)).count("Exchange hashpartitioning") == base
    assert plan(evidence.pairs(m)).count("Exchange hashpartitioning") == 2 * base
    # sets of ids are made where the pairs are
    chunked = evidence.pairs(m, 5)
    assert plan(evidence.id_sets(chunked, evidence.PAIR)).count("Exchange hashpartitioning") == plan(chunked).count("Exchange hashpartitioning")


def test_mentions_meet_a_large_part_table_in_parts_that_grow(spark, data, monkeypatch):
    from tidemark.sources import tables, views

    want = sorted(map(tuple, views.mentions(spark, data).collect()))
    monkeypatch.setattr(tables, "small", lambda df, most=0: df)
    monkeypatch.setattr(views, "parts", lambda spark, rows: 7)
    m = views.mentions(spark, data)
    plan = m._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # both tables of each of the two joins, whatever the session's shuffle partitions are
    assert len(dealt) == 4 and sum("l_partkey" in line for line in dealt) == 2 and all(", 7)" in line for line in dealt)
    assert sorted(map(tuple, m.collect())) == want


def test_salience_and_listings_count_mentions_once(spark, data):
    from tidemark.operators import graph
    from tidemark.plans import catalog
    from tidemark.sources import views

    plan = lambda df: df._jdf.queryExecution().toString()
    m = views.mentions(spark, data)
    both = graph.salience(m, "kind")
    assert "lineitem" in plan(m) and "lineitem" not in plan(both)
    assert sorted(map(tuple, both.drop("kind").collect())) == sorted(map(tuple, graph.salience(m).collect()))
    assert all(r.entity_id.startswith(f"{r.kind}:") for r in both.collect())
    assert "lineitem" not in plan(catalog.QUERIES["list_entities"](spark, data))


def test_walks_from_few_starts_equal_those_in_blocks(spark, monkeypatch):
    import random

    from tidemark.operators import graph

    r = random.Random(5)
    # one node that all others meet, and pairs at random
    pairs = {("hub", f"n{i}") for i in range(60)} | {(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(120)}
    edges = spark.createDataFrame([(a, b, r.random()) for a, b in sorted(pairs)], "src string, dst string, weight double")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(0, 60, 6)] + [("hub",)], "entity_id string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "CELL", 9)  # several columns of ends
    for walks in (graph.neighbors_weighted, graph.neighbors_decayed):
        monkeypatch.setattr(graph, "FEW", 50)
        few = walks(edges, starts)
        monkeypatch.setattr(graph, "FEW", 0)
        blocks = walks(edges, starts)
        assert "collect_list" not in plan(few) and "collect_list" in plan(blocks)
        got = sorted(map(tuple, few.collect()))
        assert got == sorted(map(tuple, blocks.collect())) and len(got) == 11 * 60


def test_rollup_ranks_no_whole_group(spark):
    from tidemark.operators import graph

    projects = spark.createDataFrame([("project:a", 0.9), ("project:b", 0.8)], "entity_id string, salience double")
    edges = spark.createDataFrame([(f"case:{i:02d}", "project:a", 0.5 + i / 100) for i in range(20)] + [("case:03", "project:b", 0.9)], "src string, dst string, weight double")
    kinds = spark.createDataFrame([(f"case:{i:02d}", "case") for i in range(20)] + [("project:a", "project"), ("project:b", "project")], "entity_id string, kind string")
    out = graph.rollup(projects, edges, kinds, ("case", "project"), most=3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.project, r.kind, r.nth, r.node, r.more) for r in out.collect())
    assert got == [
        ("project:a", "case", 1, "case:19", 17), ("project:a", "case", 2, "case:18", 17), ("project:a", "case", 3, "case:17", 17), ("project:a", "project", 1, "project:b", 0),
        ("project:b", "case", 1, "case:03", 0), ("project:b", "project", 1, "project:a", 0),
    ]


def test_entities_for_email_tells_entities_of_every_kind(spark, data):
    from tidemark.plans import catalog
    from tidemark.sources import views

    pairs = lambda df: set(map(tuple, df.select("email_id", "entity_id").collect()))
    got = pairs(catalog.QUERIES["entities_for_email"](spark, data))
    assert got == pairs(views.mentions(spark, data)) and {e.split(":")[0] for _, e in got} == {"person", "case", "project", "org"}


def test_evidence_fingerprint_has_entities_of_every_kind(spark, data):
    from tidemark.plans import catalog
    from tidemark.sources import views

    got = {r.entity_id: r.emails for r in catalog.QUERIES["evidence_fingerprint"](spark, data).collect()}
    assert got == {r.entity_id: r.n for r in views.mentions(spark, data).groupBy("entity_id").agg(F.count_distinct("email_id").alias("n")).collect()}


def test_walks_are_made_as_arrays_and_equal_a_loop(spark, monkeypatch):
    from tidemark.operators import graph

    r = random.Random(8)
    # a few nodes that all others meet, pairs at random, equal weights, and weights that take part in nothing
    pairs = {(f"n{i}", f"hub{j}") for i in range(150) for j in range(3)} | {(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(90)} | {("one", "two")}
    edges = [(a, b, r.choice([0.25, 0.5, r.random(), r.random()])) for a, b in sorted(pairs)] + [("n1", "n2", None), ("n3", "n4", 0.0), ("n5", "n6", -1.0)]
    starts = [f"n{i}" for i in range(0, 150, 2)] + ["hub0", "one", "nobody"]
    weight = {}
    for a, b, w in edges:
        if a != b and w and w > 0:
            weight[a, b] = max(w, weight.get((a, b), 0))
    step = {}
    for (a, b), w in weight.items():
        for x, y in ((a, b), (b, a)):
            step.setdefault(x, {})[y] = max(w, step.get(x, {}).get(y, 0))
    want = {0.5: {}, 1.0: {}}
    for s in starts:
        one = step.get(s, {})
        for share, found in want.items():
            far = {}
            for m, w in one.items():
                for t, v in step[m].items():
                    if t != s:
                        far[t] = max(far.get(t, 0), w * v * share)
            for t in one.keys() | far.keys():
                if share == 0.5:
                    found[s, t] = (one[t], 1) if t in one else (far[t], 2)
                else:
                    found[s, t] = (one[t], 1) if one.get(t, 0) >= far.get(t, 0) else (far[t], 2)
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    s = spark.createDataFrame([(x,) for x in starts], "entity_id string")
    monkeypatch.setattr(graph, "CELL", 40)
    for most in (10**6, 50):
        monkeypatch.setattr(graph, "BLOCK_EDGES", most)
        for share, walks in ((1.0, graph.neighbors_weighted), (0.5, graph.neighbors_decayed)):
            out = walks(e, s)
            plan = out._jdf.queryExecution().executedPlan().toString()
            # no walk is a row: what is not told by arrays is no join and no explosion after the cells are made
            assert "MapInArrow" in plan and "Join" not in plan
            assert {(x.start, x.node): (x.score, x.hop) for x in out.collect()} == want[share]


def test_dense_and_listed_walks_are_equal(monkeypatch):
    import numpy as np
    from tidemark.operators import graph

    monkeypatch.setattr(graph, "LISTED", 50)
    r = np.random.default_rng(3)
    for size in (3, 60, 100):
        # 100 starts and ends, each edge to one of eight nodes with a chance
        have, near = r.random((100, 8)) < size / 100, r.random((100, 8))
        there, far = r.random((100, 8)) < size / 100, r.random((100, 8))
        at, node = np.nonzero(have)
        to, last = np.nonzero(there)
        order = np.argsort(last, kind="stable")
        begin, end = (np.searchsorted(last[order], np.arange(8), side) for side in ("left", "right"))
        got = graph._band(100, at, node, near[at, node], begin, end, to[order], far[to, last][order], 100)
        both = np.where(have[:, None] & there[None], near[:, None] * far[None], -1.0)
        assert (got == both.max(axis=2)).all()


def test_rounded_equals_round(spark):
    from tidemark.functions.numbers import rounded

    r = random.Random(2)
    some = [i / 2e6 for i in range(-3, 40)] + [round(r.random(), 6) * round(r.random(), 6) * 0.5 for _ in range(3000)] + [r.random() * 10 ** r.randrange(-12, 14) for _ in range(2000)]
    some += [-1.23456789, 0.0, -0.0, None, float("nan"), float("inf"), float("-inf"), 1e300, 0.0000005, 1.0000005, 0.1234565]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    assert df.where(~rounded(F.col("x")).eqNullSafe(F.round("x", 6))).count() == 0


def test_sets_after_changes_equal_recomputation(spark, monkeypatch):
    """Ids that are kept, removed, added, or removed and added again, in several chunks, without a shuffle of pairs or a table of sets."""
    rng = random.Random(11)
    before, new = mentions(rng, range(80)), mentions(rng, range(60, 100))
    monkeypatch.setattr(evidence, "CHUNK", 16)
    lists = lambda rows, change: evidence.entity_lists(spark.createDataFrame(rows, MENTION)).withColumn("change", F.lit(change))
    gone = [m for m in before if m[0] >= 55]
    before += [(7, "person:zz", "case", 0.4), (8, "odd", None, 0.7), (8, "\U0001f600", "org", 0.7), (8, "\uffee", "org", 0.7)]
    changed = lists(before, 0).unionByName(lists(gone, -1)).unionByName(lists(new, 1))
    got = evidence.sets_after(changed, 3)
    after = spark.createDataFrame([m for m in before if m[0] < 55] + new, MENTION)
    want = evidence.id_sets(evidence.pairs(after), evidence.PAIR, 16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100
    assert plan.count("Exchange hashpartitioning(chunk") == 1 and "Exchange hashpartitioning(src" not in plan and "Join" not in plan


def test_each_pair_of_a_message_is_made_once(spark):
    rng = random.Random(4)
    m = spark.createDataFrame(mentions(rng, range(50)) + [(7, "person:zz", "case", 0.4), (8, "odd", None, 0.7), (8, "case:odd", "case", 0.123457)], MENTION)
    lists = evidence.entity_lists(m)
    of = lambda df: sorted(map(repr, df.select(*evidence.PAIR, "email_id", "base").collect()))
    assert of(evidence.pairs_of(lists)) == of(evidence.pairs(m)) == of(evidence.pairs(m, 3))
    assert "Join" not in evidence.pairs_of(lists)._jdf.queryExecution().executedPlan().toString()


def test_relation_evidence_writes_and_joins_no_sets(spark, data):
    from tidemark.plans import catalog

    plan = catalog.QUERIES["relation_evidence"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # sets are neither read from a table nor dealt by pair
    assert "id_sets" not in plan and "hashpartitioning(src" not in plan


def test_relations_of_kinds_are_those_of_columns(spark):
    kinds = ["person", "case", "project", "org", "topic", None]
    rows = [(x, y, a, b) for x in kinds for y in kinds for a, b in (("a", "b"), ("b", "a"))]
    df = spark.createDataFrame(rows, "x string, y string, a string, b string")
    got = df.select("*", graph.relation(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("rel")).collect()
    assert all(r.rel == graph.told(r.x, r.y, r.a < r.b) for r in got) and len(got) == 72


def test_sums_by_chunk_equal_sums_of_pairs(spark, monkeypatch):
    """Messages are counted, counted again and taken away, in several chunks."""
    rng = random.Random(12)
    some, more = mentions(rng, range(70)) + [(8, "odd", None, 0.7), (8, "case:odd", "case", 0.123457)], mentions(rng, range(70, 90))
    monkeypatch.setattr(evidence, "CHUNK", 16)
    lists = lambda rows, change: evidence.entity_lists(spark.createDataFrame(rows, MENTION)).withColumn("change", F.lit(change))
    gone = [m for m in some if m[0] % 5 == 0]
    sums = evidence.sums_by_chunk(lists(some, 1).unionByName(lists(more, 1)).unionByName(lists(gone, -1)), 3)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" not in plan and "Join" not in plan
    want = evidence.pair_sums(evidence.pairs(spark.createDataFrame([m for m in some if m[0] % 5] + more, MENTION)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(evidence.summed(sums, evidence.PAIR, "n", 5)) == rows(want) and sums.count() > want.count()


def test_relations_kept_up_have_entities_of_every_kind(spark, data):
    from tidemark.plans import catalog

    got = {(r.src, r.dst, r.rel): r.evidence for r in catalog.QUERIES["relations_kept_up"](spark, data).collect()}
    assert got == {(r.src, r.dst, r.rel): r.evidence for r in catalog.QUERIES["relations"](spark, data).collect()}
    assert any(rel == "participant_in" for _, _, rel in got)


def test_relations_kept_up_join_no_state(spark, data):
    from tidemark.plans import catalog

    plan = catalog.QUERIES["relations_kept_up"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # two joins with the rarities, sent to every task, and the sums are dealt by pair once
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and plan.count("hashpartitioning(src") == 1


def test_relations_kept_up_meet_many_rarities_in_parts(spark, data, monkeypatch):
    from tidemark.plans import catalog
    from tidemark.sources import tables

    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(catalog.QUERIES["relations_kept_up"](spark, data))
    monkeypatch.setattr(tables, "small", lambda df, most=0: df)
    got = catalog.QUERIES["relations_kept_up"](spark, data)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # pairs are not sorted, and no entity is sent to every task
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 0
    assert rows(got) == want
