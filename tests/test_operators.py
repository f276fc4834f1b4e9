"""Cases that the tables don't hold: nulls, ties, empty input, edges of intervals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tidemark.functions import text as T
from tidemark.operators import chunking, graph, intervals, maintain, merge, queue, retrieval


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filters_treat_unknown_flags_apart(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, False), (3, None, None)], "email_id int, is_no_reply boolean, is_scheduling boolean")
    assert rows(queue.filter_queue(df, no_reply=False).select("email_id")) == [(2,)]
    assert rows(queue.filter_queue(df, scheduling=False).select("email_id")) == [(2,), (3,)]
    assert rows(queue.filter_review(df, False, False).select("email_id")) == [(2,), (3,)]


def test_spread_stays_in_band_and_keeps_order(spark):
    df = spark.range(600).select(F.col("id").alias("email_id"), F.lit("medium").alias("level"), (25 + F.col("id") % 7).cast("double").alias("score"), F.timestamp_seconds("id").alias("received_at"))
    out = queue.spread_scores(df).orderBy("score", "received_at").collect()
    spread = [r.spread for r in out]
    assert spread == sorted(spread) and len(set(spread)) == 600 and 25 < spread[0] and spread[-1] < 50


def test_spread_leaves_out_unscored(spark):
    df = spark.createDataFrame([(1, None, None), (2, "low", None)], "email_id int, level string, score double").withColumn("received_at", F.lit(0).cast("timestamp"))
    assert queue.spread_scores(df).count() == 0


def test_priors_take_the_last_valid_correction(spark):
    log = [(1, "a", "level", "low", 1), (2, "a", "level", "high", 1), (3, "a", "level", "silly", 9), (4, "a", "no_reply", "true", 1), (5, "b", "no_reply", "false", 1)]
    df = spark.createDataFrame(log, "id int, sender string, kind string, value string, created_at int")
    assert rows(queue.sender_priors(df)) == [("a", "high", True), ("b", None, False)]


def test_merge_intervals_joins_touching_and_drops_empty(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 12, 10), (1, 20, 30), (1, 21, 22), (2, 1, 2)], "calendar_id int, start bigint, end bigint")
    assert rows(intervals.merge_intervals(df)) == [(1, 0, 7), (1, 20, 30), (2, 1, 2)]


def test_free_windows_without_busy_time(spark):
    windows = spark.createDataFrame([(1, 0, 10)], "calendar_id int, from bigint, to bigint")
    busy = spark.createDataFrame([], "calendar_id int, start bigint, end bigint")
    assert rows(intervals.free_windows(windows, busy)) == [(1, 0, 10)]


def test_free_windows_clip_and_subtract(spark):
    windows = spark.createDataFrame([(1, 10, 20)], "calendar_id int, from bigint, to bigint")
    busy = spark.createDataFrame([(1, 5, 12), (1, 14, 15), (1, 19, 30)], "calendar_id int, start bigint, end bigint")
    assert rows(intervals.free_windows(windows, busy)) == [(1, 12, 14), (1, 15, 19)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(merge.merge_latest(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(merge.insert_ignore(old, new, ["k"], F.col("v"))) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(merge.merge_latest(old, new.limit(0), ["k"])) == rows(old)
    assert merge.conform(old, {"w": F.lit(0), "v": F.lit("x")}).columns == ["k", "v", "w"]


def test_updates_are_guarded(spark):
    df = spark.createDataFrame([(1, "open", "x"), (2, "done", "y")], "k int, status string, v string")
    edits = spark.createDataFrame([(1, "p", 1), (1, "q", 2), (2, "z", 1)], "k int, value string, at int")
    assert rows(merge.apply_updates(df, edits, "k", "v", F.col("status") == "open")) == [(1, "open", "q"), (2, "done", "y")]


def test_relations_need_two_messages_to_belong_and_drop_hubs(spark):
    m = [(e, "person:hub", "person", 1.0) for e in range(30)] + [(1, "case:a", "case", 1.0), (1, "project:p", "project", 1.0), (2, "case:b", "case", 1.0), (2, "project:p", "project", 1.0), (3, "case:b", "case", 0.4), (3, "project:p", "project", 1.0)]
    found = graph.relations(spark.createDataFrame(m, "email_id int, entity_id string, kind string, confidence double"))
    assert [(r.src, r.dst, r.rel, r.evidence) for r in found.collect()] == [("case:b", "project:p", "belongs_to", 2)]


def test_walks_differ_in_revisits_and_decay(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.8), ("a", "c", 0.1)], "src string, dst string, weight double")
    s = spark.createDataFrame([("a",)], "entity_id string")
    assert rows(graph.neighbors_weighted(e, s)) == [("a", "b", 0.5, 1), ("a", "c", 0.4, 2)]
    assert rows(graph.neighbors_decayed(e, s)) == [("a", "b", 0.5, 1), ("a", "c", 0.1, 1)]


def test_graph_search_finds_messages_without_shared_entities(spark):
    m = spark.createDataFrame([(1, "case:a"), (2, "case:b"), (3, "case:z")], "email_id int, entity_id string")
    e = spark.createDataFrame([("case:a", "project:p", 1.0), ("case:b", "project:p", 1.0)], "src string, dst string, weight double")
    sal = spark.createDataFrame([("case:a", 0.0)], "entity_id string, salience double")
    found = graph.graph_search(e, m, sal, spark.createDataFrame([(1,)], "email_id int"))
    assert rows(found) == [(1, 1, 2, 0.125)]


def test_budget_cuts_the_last_section(spark):
    df = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc")], "anchor int, priority int, text string")
    assert rows(retrieval.budget_prefix(df, 6)) == [(1, 1, "aaaa"), (1, 2, "bb")]


@pytest.mark.parametrize(("k", "block"), [(3, 7), (3, 2048), (50, 2048)])
def test_vector_search_in_blocks_equals_all_pairs(spark, k, block):
    import numpy as np

    rng = np.random.default_rng(1)
    rows_ = [(i, [float(v) for v in rng.integers(-2, 3, 3 if i % 9 else 2)]) for i in range(60)] + [(60, []), (61, None), (62, [0.0] * 3)]
    v = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, retrieval.vector_topk(v, v.where("vec_id % 4 = 0"), k, block).collect()))
    want = []
    for q, x in rows_:
        if q % 4 == 0 and x:
            near = []
            for i, y in rows_:
                if i != q and y and len(y) == len(x):
                    norm = np.linalg.norm(x) * np.linalg.norm(y)
                    near.append((-round(float(np.dot(x, y) / norm), 6) if norm else 0.0, i))
            want += [(q, n + 1, i, -s + 0.0) for n, (s, i) in enumerate(sorted(near)[:k])]
    assert got == sorted(want)


def test_todos_reconcile(spark):
    columns = "todo_id string, email_id int, kind string, text string"
    stored = spark.createDataFrame([("a", 1, "k", "t", "open"), ("b", 1, "k", "t", "done"), ("c", 2, "k", "t", "open"), ("e", 3, "k", "t", "open")], columns + ", status string")
    desired = spark.createDataFrame([("a", 1, "k", "t"), ("d", 2, "k", "t")], columns)
    got = maintain.sync_todos(stored, desired, spark.createDataFrame([(1,), (2,)], "email_id int"))
    assert rows(got.select("todo_id", "status")) == [("a", "open"), ("b", "done"), ("c", "done"), ("d", "open"), ("e", "open")]


@pytest.mark.parametrize(
    ("value", "want"),
    [("Ann B <Ann@Example.com>", "ann@example.com"), ("  x@y.z ", "x@y.z"), ("a <b> c", "a <b> c"), ("", "")],
)
def test_addr_only(spark, value, want):
    assert spark.range(1).select(T.addr_only(F.lit(value)).alias("a")).first().a == want


@pytest.mark.parametrize(
    ("text", "singular", "want"),
    [("The Atlas Project", True, "atlas"), ("sample kits", True, "sample kit"), ("Technologies", True, "technology"), ("Atlas", True, "atlas"), ("the case", False, "case"), (None, True, "")],
)
def test_normalize_name(spark, text, singular, want):
    assert spark.range(1).select(T.normalize_name(F.lit(text).cast("string"), singular).alias("a")).first().a == want


def test_find_ids(spark):
    got = spark.range(1).select(T.find_ids(F.lit("see RMA-2026-0447, CS-40350, #4471, #22 and CS-40350")).alias("a")).first().a
    assert [tuple(x) for x in got] == [("RMA-2026-0447", "document"), ("CS-40350", "case"), ("#4471", "case")]


def test_html_to_text(spark):
    page = "<html><head><title>t</title></head><body><script>x<1</script><p>a &amp; b</p><br>c<div>d</div></body></html>"
    assert spark.range(1).select(T.html_to_text(F.lit(page)).alias("a")).first().a == "a & b\n\nc\nd"


def test_chunks_split_quotes_and_signatures():
    body, quoted = chunking.split_quoted("Hi\n\nOn Monday, Ann wrote:\n> old")
    assert (body, quoted) == ("Hi", "On Monday, Ann wrote:\n> old")
    assert chunking.split_quoted("> a\n" + "x" * 300) == ("> a\n" + "x" * 300, "")
    assert chunking.split_signature("Hello\n-- \nAnn") == ("Hello", "-- \nAnn")
    assert chunking.split_body("") == []
    assert all(len(p) <= 900 for p in chunking.split_body("One sentence here. " * 200))


def test_resolve_ladder(spark):
    m = spark.createDataFrame([("case", "A"), ("case", "B"), ("case", "C")], "kind string, key string")
    known = spark.createDataFrame([("case", "A", "e1")], "kind string, key string, entity_id string")
    alias = spark.createDataFrame([("case", "B", "e9"), ("case", "B", "e2"), ("case", "A", "e3")], "kind string, key string, entity_id string")
    got = {r.key: (r.entity_id, r.rung) for r in chunking.resolve_entities(m, known, alias).collect()}
    assert got["A"] == ("e1", "exact") and got["B"] == ("e2", "alias") and got["C"][1] == "new"


def test_model_stage_guards_rows(spark):
    def fails_on_b(batch):
        if any(r["x"] == "b" for r in batch):
            raise ValueError("no b")
        return [r["x"] * 2 for r in batch]

    df = spark.createDataFrame([("a",), ("b",), ("a",)], "x string")
    assert rows(chunking.model_stage(df, fails_on_b, ["x"], "string")) == [("a", "aa", None), ("b", None, "no b")]


def _b64(text):
    import base64

    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def test_parse_messages(spark):
    import json

    from tidemark.sources.messages import parse_messages

    part = lambda kind, text, name="": {"mimeType": kind, "filename": name, "body": {"data": _b64(text)}}
    headers = [{"name": "FROM", "value": "=?utf-8?q?J=C3=B6?= <j@x.org>"}, {"name": "To", "value": "a@x, b@y"}, {"name": "cc", "value": "c@z"}, {"name": "X-Other", "value": "n"}]
    raw = [
        {"id": "1", "threadId": "t", "labelIds": ["UNREAD"], "internalDate": "1700000000000", "payload": {"headers": headers, "mimeType": "multipart/mixed", "parts": [{"mimeType": "multipart/alternative", "parts": [part("text/plain", "plain é"), part("text/html", "<p>html</p>")]}, part("text/plain", "not the body", "a.txt")]}},
        {"id": "2", "payload": part("text/html", "<head><title>t</title></head><body><style>x</style><p>a &amp; b</p>c</body>")},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in raw] + [("{broken",), (None,)], "raw string")
    got = {r.email_id: r for r in parse_messages(df).collect()}
    assert got["1"].sender == "Jö <j@x.org>" and got["1"].recipients == ["a@x", "b@y", "c@z"] and got["1"].body == "plain é"
    assert got["1"].has_attachments and got["1"].read_status == "unread" and got["1"].received_at.year == 2023 and "X-Other" not in got["1"].headers
    assert got["2"].body == "a & b\nc" and got["2"].received_at is None and got["2"].sender is None
    assert sorted(r.error for r in parse_messages(df).where("error is not null").collect()) == ["not JSON", "not JSON"]


def test_parse_messages_of_odd_shape(spark):
    import json

    from tidemark.sources.messages import DEPTH, decoded, decoded_words, parse_messages

    deep = {"mimeType": "text/plain", "body": {"data": _b64("deep")}}
    for _ in range(DEPTH):
        deep = {"mimeType": "multipart/mixed", "parts": [deep]}
    raw = [{"id": "deep", "payload": deep}, {"id": "deeper", "payload": {"parts": [deep]}}, {"id": "none"}, {"payload": {}}, {"id": 7, "internalDate": 1000, "labelIds": [], "payload": {"headers": [], "parts": [], "body": {}}}, ["list"]]
    two = {"id": "two", "payload": {"parts": [{"parts": [{"mimeType": "text/plain", "body": {"data": _b64("b")}}]}, {"mimeType": "text/plain", "filename": "", "body": {"data": _b64("c") + "="}}, {"mimeType": "text/plain", "body": {"data": "!"}}]}}
    got = {r.email_id or r.error: r for r in parse_messages(spark.createDataFrame([(json.dumps(x),) for x in [*raw, two]], "raw string")).collect()}
    assert set(got) == {"deep", "nested too deeply", "none", "no id", "7", "two"}
    assert got["deep"].body == "deep" and got["none"].body == "" and got["7"].received_at is not None and got["two"].body == "b\nc"
    one = spark.range(1).select(decoded(F.lit("4oKs_-8")).alias("a"), decoded(F.lit(None).cast("string")).alias("b"), *[decoded_words(F.lit(x)).alias(k) for k, x in (("c", "=?ISO-8859-1?Q?a=E9_b?="), ("d", "x =?utf-8?b?w7w=?=\n =?utf-8?B?w7w=?= y"), ("e", "=?koi8-r?B?w7w=?="), ("f", "a=?b"))]).first()
    assert one.a.startswith("€") and one.b == "" and (one.c, one.d, one.e, one.f) == ("aé b", "x üü y", "=?koi8-r?B?w7w=?=", "a=?b")


def test_parse_calendar(spark):
    from tidemark.sources.messages import parse_calendar

    raw = ['{"id":"a","summary":"s","start":{"dateTime":"2026-01-02T09:00:00Z"},"end":{"dateTime":"2026-01-02T10:00:00+00:00"}}', '{"id":"b","start":{"date":"2026-01-03"},"end":{"date":"2026-01-04"}}', '{"id":"c","status":"cancelled"}', "nonsense"]
    got = {r.event_id: r for r in parse_calendar(spark.createDataFrame([(x,) for x in raw], "raw string")).collect()}
    assert set(got) == {"a", "b"} and got["b"].all_day and not got["a"].all_day and (got["a"].end - got["a"].start).seconds == 3600


def test_working_hours_follow_daylight_saving(spark):
    day = lambda d: int(__import__("datetime").datetime.fromisoformat(d + "T00:00:00+00:00").timestamp() * 10**6)
    df = spark.createDataFrame([(1, day("2026-10-30"), day("2026-11-03"))], "calendar_id int, from bigint, to bigint")
    got = rows(intervals.working_windows(df, "America/Los_Angeles"))
    hours = [(a % intervals.DAY // intervals.HOUR, (b - a) // intervals.HOUR) for _, a, b in got]
    assert hours == [(0, 0), (16, 8), (17, 7)] or hours == [(16, 8), (17, 7)]


def test_bodies_are_packed_by_paragraphs_and_sentences():
    assert chunking.split_body("a\n\nb\n \nc") == ["a\n\nb\n\nc"]
    assert chunking.split_body("one two. three four; five\nsix no end", 12, 0) == ["one two.", "three four;", "five", "six no end"]
    assert chunking.split_body("x" * 30 + ". " + "y" * 5, 10, 0) == ["x" * 30 + ".", "y" * 5]
    first, second = chunking.split_body("First one here. The last words.\n\n" + "z" * 30, 40, 20)
    assert first == "First one here. The last words." and second == "here. The last words."[-20:].split(". ")[1].strip() + "\n\n" + "z" * 30
    assert chunking.split_body("tail without an end\n\n" + "z" * 20, 24, 10)[1].startswith("out an end\n\n")
    assert "".join("".join(chunking.split_body("w " * 3000, overlap=0)).split()) == "w" * 3000


def test_quoted_text_below_much_else_stays():
    quoted = lambda t: chunking.split_quoted(t)
    assert quoted("> a\n" + "x" * 200)[1] and not quoted("> a\n" + "x" * 201)[1]
    assert quoted("> a\n\n  " + "x" * 100 + "\n> b\n" + " " * 400 + "y" * 99 + "\n\n \n")[0] == "> a\n\n  " + "x" * 100  # blanks between lines count
    assert quoted("> a\n \n\n" + "x" * 200 + "  \n \n") == ("", "> a\n \n\n" + "x" * 200)


def test_many_blank_lines_take_linear_time():
    import time

    began = time.time()
    text = "\n" * 200_000 + "end"
    assert chunking.split_quoted(text)[1] == "" and chunking.split_signature(text)[1] == "" and chunking.split_body(text) == ["end"]
    assert time.time() - began < 5


def test_replies_are_owed_for_classified_read_unsent_mail(spark):
    df = spark.createDataFrame([(1, False, "read", None), (2, None, "read", None), (3, True, "read", None), (4, False, "unread", None), (5, False, "read", "sent"), (6, False, "read", "suggested")], "email_id int, is_no_reply boolean, read_status string, outline_status string")
    assert rows(df.where(maintain.needs_reply(df)).select("email_id")) == [(1,), (6,)]


def test_invitations_are_decisive(spark):
    cases = [("text/calendar", "x", False), ('x/y; name="A.ICS"', "x", True), ("a/b; method = request", "x", False), ("text/plain", "friday", False), ("text/plain", "friday 3 pm", False), ("text/plain", "friday 3 pm", True), (None, "when works", True)]
    df = spark.createDataFrame(cases, "kind string, subject string, bulk boolean")
    got = [r.f for r in df.select(T.scheduling_signals(F.col("subject"), F.lit(None).cast("string"), F.col("kind"), F.col("bulk")).alias("f")).collect()]
    assert [g.related for g in got] == [True, True, True, False, True, False, True] and got[0].points == 0
    assert got[0].reasons == [T.INVITE_WHY] and got[5].reasons[-1] == T.BULK_WHY and len(got[5].reasons) == 3


def test_mentions_read_the_chunks_once(spark):
    texts = [(1, "Ask ann@desk.org or bob@mail.example.com about CS-40350 and CS-40350"), (2, None), (3, "ann@desk.org again")]
    found = chunking.extract_mentions(chunking.chunk_corpus(spark.createDataFrame(texts, "email_id long, body string")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = [(r.email_id, r.kind, r.key) for r in found.collect()]
    assert len(got) == len(set(got)) and {(1, "person", "ann@desk.org"), (1, "person", "bob@mail.example.com"), (3, "person", "ann@desk.org")} <= set(got)
    assert sum(kind == "case" for _, kind, _ in got) == 1
