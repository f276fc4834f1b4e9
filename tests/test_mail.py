"""Resolution against a sequential brute force, calendar rules, ingestion and streams on literal rows."""

from __future__ import annotations

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.functions import text as T
from tidemark.operators import briefs, calendars, graph, intervals, merge, queue, resolution, stages
from tidemark.sources.messages import parse_busy, parse_calendar, read_messages

KEYED = "kind string, key string, span string, place bigint, vec array<float>"


def one_after_the_other(rows, entities, aliases, vectors, bar, low):
    """Every mention in order, with what the ones before it have left in dicts."""
    cos = lambda x, y: round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 6)
    inside = lambda a, b: len(a) >= 4 and len(a.split()) < len(b.split()) and f" {' '.join(a.split())} " in f" {' '.join(b.split())} "
    keys = {(k, name): e for e, k, name, _ in entities}
    own_key = {e: name for e, _, name, _ in entities}
    claims = {}
    for k, name, e in sorted(aliases, key=lambda a: a[2]):
        claims.setdefault((k, name), e)
    shown = [(e, k, name, v) for e, k, name, v in sorted(entities)]
    out = {}
    for kind, key, span, place in sorted(rows, key=lambda r: r[3]):
        said = name_of(kind, span)
        if (kind, key) in keys:
            e, rung = keys[kind, key], "exact"
        elif (kind, key) in claims or (kind, said) in claims:
            e, rung = claims.get((kind, key)) or claims[kind, said], "alias"
        else:
            vec, e, most = vectors.get((kind, key)), None, -2
            for other, k, name, v in shown:
                if vec and k == kind and kind not in resolution.NO_VECTOR and len(v) == len(vec):
                    c = cos(vec, v)
                    if c >= (min(bar, low) if inside(key, name) or inside(name, key) else bar) and c > most:
                        e, most = other, c
            rung = "vector"
            if e is None:
                e, rung = f"{kind}:{key}", "new"
                keys[kind, key], own_key[e] = e, key
                if vec:
                    shown.append((e, kind, key, vec))
        if said and own_key[e] not in (said, re.sub(r"[^\w]+", "", span).upper()):
            claims.setdefault((kind, said), e)
        out[place] = (e, rung)
    return out


def name_of(kind, span):
    """The normalised name for the words that these tests use: lower case, without article, generic noun and plural of topics."""
    words = [w for w in re.sub(r"[^\w\s@.+-]+", " ", (span or "").lower()).split() if w not in ("project", "case", "the")]
    name = " ".join(words)
    return name[:-1] if kind == "topic" and len(name.split()[-1:] and name.split()[-1]) > 3 and re.search("[^suiao]s$", name) and not name.endswith("es") else name


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_equals_one_mention_after_the_other(spark, seed):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    vec = lambda i, noise: [float(np.float32(x + noise * rng.gauss(0, 1))) for x in base[i]]
    nouns = ["alpha", "beta", "gamma ray", "lot 22b", "anshun lot 22b", "delta", "flux", "flux launch", "kits", "kit"]
    entities = [(f"e{i}", "topic", f"known {i}", vec(i, 0.1)) for i in range(3)] + [("e9", "topic", "delta", vec(3, 0.0)), ("p1", "person", "a@b.co", [])]
    aliases = [("topic", "nick", "e1"), ("topic", "nick", "e0"), ("person", "boss", "p1")]
    rows, vectors = [], {}
    for _ in range(70):
        word = rng.choice([*nouns, "nick", "known 1", f"thing {rng.randrange(12)}"])
        rows.append(("topic", name_of("topic", word), rng.choice([word, f"The {word.title()}", f"{word} project"])))
    for _ in range(60):  # addresses that share display names, in turn
        rows.append(("person", rng.choice(["a@b.co", *[f"p{i}@b.co" for i in range(12)]]), rng.choice(["Boss", "Ann B", "Bob", "p3@b.co", "Cy", "", "Dee", "Eve"])))
    rows += [("case", c, s) for c, s in [("CS1", "CS-1"), ("CS2", "CS 2"), ("CS1", "cs1"), ("CS3", "The big case"), ("CS4", "The big case"), ("CS4", "CS-4")]]
    rng.shuffle(rows)
    rows = [(*r, i) for i, r in enumerate(rows)]
    for kind, key, _, _ in rows:
        if kind == "topic" and rng.random() < 0.9:
            vectors.setdefault((kind, key), vec(rng.randrange(8), 0.3))
    want = one_after_the_other(rows, entities, aliases, vectors, resolution.BAR, resolution.CONTAINED_BAR)
    df = spark.createDataFrame(rows, "kind string, key string, span string, place bigint")
    e = spark.createDataFrame(entities, "entity_id string, kind string, key string, vec array<float>")
    a = spark.createDataFrame(aliases, "kind string, key string, entity_id string")
    v = spark.createDataFrame([(k, n, x) for (k, n), x in vectors.items()], "kind string, key string, vec array<float>")
    got, claimed = resolution.resolve_all(df, e, a, v)
    got = {r.place: r for r in got.collect()}
    new = {r.entity_id: f"{r.kind}:{r.key}" for r in got.values() if r.rung == "new"}
    assert {p: (new.get(r.entity_id, r.entity_id), r.rung) for p, r in got.items()} == want
    assert {r for _, r in want.values()} == {"exact", "alias", "vector", "new"} and claimed.count() > 3
    assert resolution.resolve(df.limit(0), e, a, v.limit(0)).count() == 0


def test_names_near_each_other_take_few_rounds_and_no_broadcast(spark, monkeypatch):
    rounds, plans, decide, keep = [], {}, resolution._decide, resolution.keep
    monkeypatch.setattr(resolution, "_decide", lambda *args: rounds.append(1) or decide(*args))
    monkeypatch.setattr(resolution, "keep", lambda df, name="kept": plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or keep(df, name))
    rows = [("topic", f"n{i}", f"n{i}", i) for i in range(12)]
    df = spark.createDataFrame(rows, "kind string, key string, span string, place bigint")
    none = spark.createDataFrame([], "entity_id string, kind string, key string, vec array<float>")
    vectors = spark.createDataFrame([(k, n, [1.0, i / 100]) for k, n, _, i in rows], "kind string, key string, vec array<float>")
    got = {r.place: r for r in resolution.resolve(df, none, none.select("kind", "key", "entity_id"), vectors).collect()}
    assert [got[i].rung for i in range(12)] == ["new"] + ["vector"] * 11 and len({r.entity_id for r in got.values()}) == 1
    assert len(rounds) <= 3 and all("Broadcast" not in plans[name] for name in ("seen", "round"))


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = np.float32(centres[rng.integers(0, 12, 600)] + 0.35 * rng.normal(size=(600, 16)))
    words = ["lot", "22b", "flux", "launch", "bay", "ab"]
    rows = [(i, ["topic", "org"][i % 2], " ".join(rng.choice(words, rng.integers(1, 4))), [float(v) for v in x[i][: 16 if i % 50 else 8]]) for i in range(600)] + [(600, "topic", "zero", [0.0] * 16), (601, "topic", "none", []), (602, "topic", "null", None)]
    items = spark.createDataFrame(rows[:200] + rows[600:], "id long, kind string, key string, vec array<double>")
    stored = spark.createDataFrame(rows[200:], "entity_id long, kind string, key string, vec array<double>")
    got = {(r.id, r.entity_id): r.score for r in resolution.near(items, stored).collect()}
    inside = lambda a, b: len(a) >= 4 and len(a.split()) < len(b.split()) and f" {a} " in f" {b} "
    want = {}
    for i, k, name, u in rows[:200]:
        for j, l, other, v in rows[200:600]:
            if k == l and len(u) == len(v):
                c = float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
                if c >= (0.65 if inside(name, other) or inside(other, name) else 0.86):
                    want[i, j] = c
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in want) and len(want) > 300
    from tidemark.operators import nearness

    _, work = nearness.by_angle(items, stored, 0.86)
    assert work.first().pairs < 0.5 * 200 * 400 / 2


def test_consolidate_is_stable(spark):
    rows = [(m, "topic", f"t{m % 3}", f"T {m % 3}", m, m, 1.0) for m in range(9)] + [(m, "case", "C1", "C-1", m + 20, m, 1.0) for m in range(4)]
    df = spark.createDataFrame(rows, "email_id bigint, kind string, key string, span string, place bigint, seen bigint, confidence double")
    none = spark.createDataFrame([], "entity_id string, kind string, key string, vec array<float>")
    alias = spark.createDataFrame([], "kind string, key string, entity_id string")
    vectors = spark.createDataFrame([], "kind string, key string, vec array<float>")
    first = resolution.consolidate(df, none, alias, vectors)
    again = resolution.consolidate(df, first["index"].withColumn("vec", F.array().cast("array<float>")), first["claims"], vectors)
    for name in ("entities", "salience", "relations"):
        assert sorted(map(repr, first[name].collect())) == sorted(map(repr, again[name].collect()))
    assert {r.rung for r in again["resolved"].collect()} == {"exact"}


def test_slots_follow_the_local_clock_and_lead_time(spark):
    day = lambda text: int(__import__("datetime").datetime.fromisoformat(text).timestamp() * 10**6)
    ranges = spark.createDataFrame([("c", day("2026-10-30T00:00:00+00:00"), day("2026-11-04T00:00:00+00:00"))], "calendar_id string, `from` bigint, `to` bigint")
    busy = spark.createDataFrame([("c", day("2026-11-02T17:00:00+00:00"), day("2026-11-02T17:20:00+00:00"))], "calendar_id string, start bigint, end bigint")
    got = calendars.suggest_slots(ranges, busy, F.lit(day("2026-10-30T15:22:00+00:00")), zone="America/Los_Angeles", padding=10)
    assert [(r.nth, r.start, r.end - r.start) for r in got.orderBy("nth").collect()] == [
        (1, day("2026-10-30T16:30:00+00:00"), 30 * calendars.MINUTE),
        (2, day("2026-11-02T17:30:00+00:00"), 30 * calendars.MINUTE),
        (3, day("2026-11-03T17:00:00+00:00"), 30 * calendars.MINUTE),
    ]
    half = calendars.ceil_to(F.lit(day("2026-11-02T03:31:00+00:00")), 60, "Asia/Kolkata")
    assert spark.range(1).select(half.alias("x")).first().x == day("2026-11-02T04:30:00+00:00")


def test_messages_are_read_newest_first(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "internalDate": str(1000 * i)}) for i in range(5)] + [json.dumps({"id": "x"}), "", "not json"]
    (tmp_path / "m.json").write_text("\n".join(lines))
    got = read_messages(spark, str(tmp_path), 3).collect()
    assert [json.loads(r.raw)["id"] for r in got] == ["4", "3", "2"]
    assert read_messages(spark, str(tmp_path)).count() == 7


def test_calendars_and_busy_times(spark):
    raw = [{"id": "b", "start": {"dateTime": "2026-11-02T10:00:00Z"}, "end": {"dateTime": "2026-11-02T11:00:00Z"}, "attendees": [{"email": "A@b.co"}, {}]}, {"id": "a", "start": {"date": "2026-11-01"}}, {"id": "c"}, {"id": "d", "status": "cancelled"}]
    rows = parse_calendar(spark.createDataFrame([(json.dumps(r),) for r in raw], "raw string")).collect()
    assert [(r.event_id, r.all_day, list(r.attendees)) for r in rows] == [("a", True, []), ("b", False, ["a@b.co"]), ("c", False, [])]
    busy = parse_busy(spark.createDataFrame([("c", '{"start": "2026-11-02T10:00:00Z", "end": "2026-11-02T11:00:00Z"}'), ("c", '{"start": "soon"}'), ("c", "x")], "calendar_id string, raw string"))
    assert [(r.end - r.start) for r in busy.collect()] == [intervals.HOUR]


def test_headers_that_are_absent_are_null(spark):
    row = spark.range(1).select(F.create_map(F.lit("X-One"), F.lit("1")).alias("h")).select(T.header(F.col("h"), "x-one").alias("a"), T.header(F.col("h"), "two").alias("b")).first()
    assert (row.a, row.b) == ("1", None)


def test_entities_in_html_are_read(spark):
    page = "<p>caf&#233; &#x20AC;5 &lt;b&gt; &amp;amp; &nbsp;x&#8203;y</p><noscript>no</noscript><!-- c --><style>p{a:b}</style>"
    assert spark.range(1).select(T.html_to_text(F.lit(page)).alias("a")).first().a == "café €5 <b> &amp; xy"


def test_upserts_keep_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k bigint, v string")
    assert sorted(map(tuple, merge.merge_latest(old, new, ["k"], F.desc("v")).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    edges = spark.createDataFrame([("a", "b", "r", 1.0, ["2", "1", "2"])], "src string, dst string, rel string, weight double, evidence array<string>")
    assert merge.merge_edges(edges.limit(0), edges).first().evidence == ["1", "2"]


def test_priors_meet_decorated_senders(spark):
    log = spark.createDataFrame([(1, "Ann <A@b.co>", "level", "urgent", 1), (2, "a@b.co", "level", "low", 2), (3, "c@d.co", "level", "loud", 3)], "id bigint, sender string, kind string, value string, created_at bigint")
    assert [tuple(r) for r in queue.sender_priors(log).collect()] == [("a@b.co", "low", None)]
    left, gone = queue.clear_priors(log, spark.createDataFrame([("A@B.co",)], "sender string"))
    assert (left.count(), gone.count()) == (1, 2)


def test_evidence_hash_ignores_order_and_repeats(spark):
    rows = [("n", i) for i in range(50)]
    one = spark.createDataFrame(rows, "entity_id string, email_id bigint")
    two = spark.createDataFrame(rows[::-1] + rows[:9], "entity_id string, email_id bigint").repartition(5)
    assert graph.fingerprint(one).first() == graph.fingerprint(two).first()
    assert graph.fingerprint(one).first().hash != graph.fingerprint(one.where("email_id > 0")).first().hash
    assert briefs.evidence_hash(one, ["entity_id"], F.col("email_id")).first() == briefs.evidence_hash(two, ["entity_id"], F.col("email_id")).first()


def test_stage_inputs_are_bounded(spark):
    seen = spark.createDataFrame([(1, None, "s", "x" * 5000, False), (2, True, "s", "y", False)], "email_id bigint, is_no_reply boolean, subject string, body string, is_scheduling boolean")
    got = stages.run_stage(seen, stages.STAGES["score_level"], lambda rows: ["urgent" if len(r["body"]) == 2000 else "high" for r in rows]).orderBy("email_id").collect()
    assert [r.score_level for r in got] == ["urgent", "medium"]
    gated = stages.run_stage(seen, stages.STAGES["outline"], lambda rows: [["a", "b"]] * len(rows)).orderBy("email_id").collect()
    assert [r.outline for r in gated] == [None, None]


def test_upsert_stream_goes_on_after_a_restart(spark, tmp_path):
    from tidemark.streaming import streams

    schema = "event_id bigint, ts timestamp, user_id bigint"
    feed, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, 10), (2, 20)], [(3, 10)]):
        spark.createDataFrame([(e, u) for e, u in rows], "event_id bigint, user_id bigint").select("event_id", F.timestamp_seconds("event_id").alias("ts"), "user_id").write.mode("append").parquet(feed)
        query, table = streams.upsert(spark.readStream.schema(schema).parquet(feed), out, ["user_id"])
        query.awaitTermination()
    assert sorted((r.user_id, r.event_id) for r in table().collect()) == [(10, 3), (20, 2)]


def test_quoted_text_begins_at_headers_rules_and_attributions():
    from tidemark.operators.chunking import split_quoted

    for mark in ("On Mon, 2 Nov 2026,\nAnn <a@b.co>\nwrote:\n> old", "Ann Lee wrote:\n> old", "-----Original Message-----\nold", "_____\nFrom: x", "From: Ann\nSent: Monday\nold", "> old\n> older"):
        assert split_quoted(f"new text\n\n{mark}") == ("new text", mark)
    middle = "intro\n> a note\n" + "RELATED " * 40
    assert split_quoted(middle) == (middle.rstrip(), "")
    assert split_quoted("a\n> x\nthanks\n> y") == ("a", "> x\nthanks\n> y") and split_quoted("") == ("", "")


def test_signatures_by_delimiter_and_contact_details():
    from tidemark.operators.chunking import split_signature

    block = "Best,\nGrant Manager | Core\ng.f@core.com | +1 503-555-0138"
    assert split_signature(f"Real point.\n\n{block}\n\n--\nCore | 4400 SW Way") == ("Real point.", f"{block}\n\n--\nCore | 4400 SW Way")
    assert split_signature("Real point.\n\nSent from my phone") == ("Real point.", "Sent from my phone")
    assert split_signature("Call me\nabout the plan\nof the day") == ("Call me\nabout the plan\nof the day", "")
    far = "x\n--\n" + "y" * 1000
    assert split_signature(far) == (far, "") and split_signature(block) == (block, "")


def test_long_inputs_of_a_stage_meet_by_digest_in_parts_and_are_held_in_slices(spark, monkeypatch):
    from tidemark.operators import chunking, stages

    texts = [None, "", "-", "x" * 40, "1:a|-", "bad", *[f"text {i} " + "y" * 30 for i in range(50)]]
    rows = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(2 * len(texts))], "node_id long, evidence string").repartition(2)

    def fn(asked):
        if any(r["evidence"] == "bad" for r in asked):
            raise ValueError("no")
        held = sum(len(r["evidence"]) for r in asked)
        return [{"headline": r["evidence"][:9], "body": "much" if held > 600 else "little", "open_items": [r["evidence"]]} for r in asked]

    def done(n, held):
        monkeypatch.setattr(chunking, "HELD", held)
        got = stages.run_stage(rows, stages.STAGES["brief"], fn, "node_id", n)
        return got, sorted((r.node_id, r.brief and (r.brief.headline, r.brief.open_items), r.brief and r.brief.body, r.brief_error) for r in got.collect())

    whole, long_ = done(None, 2_000_000)[1], done(7, 100)
    assert [r[:2] + r[3:] for r in long_[1]] == [r[:2] + r[3:] for r in whole]
    # no more than about 100 characters were held at once, here and without parts
    assert {r[2] for r in long_[1]} == {None, "little"} and {r[2] for r in done(None, 100)[1]} == {None, "little"}
    plan = long_[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all(", 7)" in line and "evidence" not in line for line in dealt)


def test_briefs_are_made_in_parts_that_grow(spark, data):
    from tidemark.plans import catalog

    plan = catalog.QUERIES["stage_brief"](spark, data)._jdf.queryExecution().executedPlan().toString()
    # evidence is read from its table, and no text is a key
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "collect_list" not in plan and dealt and all("REPARTITION_BY_NUM" in line for line in dealt)


def test_lines_of_evidence_are_gathered_in_parts(spark):
    from tidemark.operators import stages

    pairs = spark.createDataFrame([(i % 5, i) for i in range(40)], "node long, email_id long").select(F.lit("thread").alias("node_type"), F.col("node").cast("string").alias("node_id"), "email_id")
    messages = spark.createDataFrame([(i, "a", None, f"s{i}", None, "b") for i in range(40)], "email_id long, sender string, received_at timestamp, subject string, summary string, body string")
    messages = messages.withColumn("received_at", F.timestamp_seconds("email_id"))
    parts = stages.evidence_lines(pairs, messages, 3, 9)
    dealt = [line for line in parts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 3 and all(", 9)" in line for line in dealt)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, stages.evidence_lines(pairs, messages, 3).collect()))
