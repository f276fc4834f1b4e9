"""Model stages: what each may read, which rows it runs for, and what is made of its answers. The model itself is a function that users pass in.

Every stage runs ``model_stage`` over the distinct inputs of the rows that pass its gate, and joins the answers back; a row whose call fails keeps null and its error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import mail as M
from tidemark.functions import text as T
from tidemark.operators.chunking import digest, model_stage

#: Bounds of inputs and answers; the confidence of an id that a message is not about, and prefixes of documents.
BODY = {"score": 2000, "extract": 4000, "summarize": 8000, "outline": 8000}
INCIDENTAL = 0.4
DOCUMENT_PREFIXES = ("INV", "PO", "ORD", "RMA", "QUO", "QT", "SO", "DN", "AP", "AR", "CR", "GRN", "SN", "SKU", "ACCT", "MAT", "LOT", "BOL", "AWB", "PN")


@dataclass(frozen=True)
class Stage:
    """``gate``: the rows it runs for; ``inputs``: the columns a model reads, bounded; ``answer``: the type of its answer; ``after``: what is made of it."""

    name: str
    gate: Callable[[], Column]
    inputs: Callable[[], dict[str, Column]]
    answer: str
    after: Callable[[Column], Column]
    empty: str | None = None  # the error of an answer of which nothing is left


def _subject_and(body: Column) -> dict[str, Column]:
    return {"subject": F.coalesce("subject", F.lit("")), "body": F.coalesce(body, F.lit(""))}


def _bounded(stage: str) -> Callable[[], dict[str, Column]]:
    return lambda: _subject_and(F.left("body", F.lit(BODY[stage])))


def _always() -> Column:
    return F.lit(True)


def _items(most: int, chars: int) -> Callable[[Column], Column]:
    """The answers that say something, ``most`` of them, each cut to ``chars``."""
    return lambda a: F.slice(F.filter(F.transform(a, lambda x: F.left(F.trim(x), F.lit(chars))), M.is_meaningful), 1, most)


def _level(a: Column) -> Column:
    known = F.when(F.lower(F.trim(a)).isin("low", "medium", "high", "urgent"), F.lower(F.trim(a)))
    return F.when(F.coalesce("is_no_reply", F.lit(False)) & known.isin("high", "urgent"), "medium").otherwise(known)


def _summary(a: Column) -> Column:
    """struct<summary, dates>: three bullets that say something, trimmed to sentences, and five dates as they were written; null where no bullet does."""
    bullets = M.join_bullets(F.slice(F.transform(a.bullets, lambda x: F.left(x, F.lit(200))), 1, 3))
    return F.when(bullets != "", F.struct(bullets.alias("summary"), F.slice(F.transform(F.coalesce(a.dates, F.array().cast("array<string>")), lambda x: F.left(x, F.lit(60))), 1, 5).alias("dates")))


def _names(a: Column) -> Column:
    """The answer with each list cut to its most, and its texts to theirs."""
    chars = {"projects": 60, "deliverables": 60, "topics": 40, "primary_ids": 24, "case_ids": 24}
    cut = lambda n: lambda x: F.left(x, F.lit(n))
    lists = [F.transform(M.capped(a.getField(f), f), cut(n)).alias(f) for f, n in chars.items()]
    return F.struct(*lists, M.clamp(a.confidence, 0.5).alias("confidence"))


def _brief(a: Column) -> Column:
    """struct<headline, body, open_items> within 120 and 2,000 characters and eight items of 200; null without headline and body."""
    cut = lambda c, n: F.left(F.trim(F.coalesce(c, F.lit(""))), F.lit(n))
    items = F.slice(F.transform(F.coalesce(a.open_items, F.array().cast("array<string>")), lambda x: F.left(x, F.lit(200))), 1, 8)
    return F.when((cut(a.headline, 120) != "") & (cut(a.body, 2000) != ""), F.struct(cut(a.headline, 120).alias("headline"), cut(a.body, 2000).alias("body"), items.alias("open_items")))


def _unit(a: Column) -> Column:
    """The vector at length one; a vector of zeros stays."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(a, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0)).cast("float"))), 1)


STAGES = {
    s.name: s
    for s in (
        Stage("classify", lambda: F.col("is_no_reply").isNull(), lambda: _subject_and(M.first_lines(F.col("body"))), "boolean", lambda a: ~a),
        Stage("score_level", _always, _bounded("score"), "string", _level),
        Stage("summarize", _always, _bounded("summarize"), "struct<bullets: array<string>, dates: array<string>>", _summary, "empty summary"),
        Stage("action_items", _always, _bounded("summarize"), "array<string>", _items(8, 200)),
        Stage("categorize", _always, _bounded("score"), "string", lambda a: F.left(T.normalize_topic(a), F.lit(40))),
        Stage("propose_event", lambda: F.coalesce("is_scheduling", F.lit(False)), _bounded("score"), "struct<title: string, start: string, end: string>", lambda a: a),
        Stage("outline", lambda: ~F.coalesce("is_no_reply", F.lit(True)), _bounded("outline"), "array<string>", lambda a: F.when(F.size(a) >= 2, F.slice(F.transform(F.filter(a, lambda x: F.trim(x) != ""), lambda x: F.left(F.trim(x), F.lit(150))), 1, 5))),
        Stage("expand", lambda: F.col("draft").isNull() & F.coalesce(F.size("outline") > 0, F.lit(False)), lambda: _subject_and(F.array_join("outline", "\n")), "string", M.clean_draft),
        Stage("extract_names", _always, _bounded("extract"), "struct<projects: array<string>, deliverables: array<string>, topics: array<string>, primary_ids: array<string>, case_ids: array<string>, confidence: double>", _names),
        Stage("brief", lambda: F.coalesce("evidence", F.lit("")) != "", lambda: {"evidence": F.col("evidence")}, "struct<headline: string, body: string, open_items: array<string>>", _brief, "empty brief"),
        Stage("embed", lambda: F.length(F.trim(F.coalesce("body", F.lit("")))) > 0, lambda: {"body": F.col("body")}, "array<float>", _unit),
    )
}


def run_stage(rows: DataFrame, stage: Stage, fn: Callable, key: str = "email_id", n: int | None = None) -> DataFrame:
    """``rows`` with the stage's output in a column of its name and its error in ``<name>_error``; rows that don't pass the gate have neither.

    ``n`` is for long inputs: these are dealt to that many parts once, and only their digests and the answers meet the rows, in as many parts; Spark's own parts grow with the texts, as they are sized as compressed.
    """
    inputs = stage.inputs()
    asked = rows.where(stage.gate()).select(key, *[c.alias(f"_{i}") for i, c in inputs.items()])
    columns = [f"_{i}" for i in inputs]
    plain = lambda batch: fn([{k[1:]: v for k, v in r.items()} for r in batch])
    by = columns
    if n:
        asked, by = asked.withColumn("_digest", digest(columns)), ["_digest"]
    answers = model_stage(asked, plain, columns, stage.answer, n)
    meet = lambda df, *c: df.repartition(n, *c) if n else df
    given = meet(asked.select(key, *by), *by).join(meet(answers, *by), by).select(key, F.col("value").alias("_value"), F.col("error").alias("_error"), F.lit(True).alias("_asked"))
    both = meet(rows, key).join(meet(given, key), key, "left")
    value, error = F.when(F.col("_asked"), stage.after(F.col("_value"))), F.col("_error")
    if stage.empty:
        error = F.coalesce(error, F.when(F.col("_asked") & value.isNull(), stage.empty))
    return both.withColumns({stage.name: value, f"{stage.name}_error": error}).drop("_value", "_error", "_asked")


def embedded(rows: DataFrame, fn: Callable, key: str = "email_id") -> DataFrame:
    """``rows`` with the stage ``embed``: vectors of length one, and zeros of the same width for blank texts; null where the call failed."""
    done = run_stage(rows, STAGES["embed"], fn, key)
    width = F.broadcast(done.agg(F.coalesce(F.max(F.size("embed")), F.lit(0)).alias("_width")))  # one row
    blank = F.length(F.trim(F.coalesce("body", F.lit("")))) == 0
    return done.crossJoin(width).withColumn("embed", F.when(blank & (F.col("_width") > 0), F.array_repeat(F.lit(0.0).cast("float"), F.col("_width"))).otherwise(F.col("embed"))).drop("_width")


def with_free_time(rows: DataFrame) -> DataFrame:
    """``rows`` (outline, is_scheduling, calendar_read, slots) with the sentence on free time as the last point of a scheduling message's outline."""
    said = M.availability(F.col("is_scheduling"), F.col("calendar_read"), F.col("slots"))
    return rows.withColumn("outline", F.when(F.col("outline").isNotNull() & said.isNotNull(), F.concat("outline", F.array(said))).otherwise(F.col("outline")))


def evidence_lines(pairs: DataFrame, messages: DataFrame, most: int = 100, n: int | None = None) -> DataFrame:
    """(node_type, node_id, evidence): what a model reads for a brief: a head and a line for each message of the node (email_id, sender, received_at, subject, summary, body), in order of time.

    A prompt is bounded: of a node's messages the ``most`` newest are told, ranked before any is gathered. Ids without a stored message are left out. With ``n`` messages and nodes are dealt to that many parts, in which they meet and their lines are gathered.
    """
    deal = lambda df, *c: df.repartition(n, *c) if n else df
    told = deal(pairs.select("node_type", "node_id", "email_id"), "email_id").distinct().join(deal(messages, "email_id"), "email_id")
    told = deal(told, "node_id")  # a type that all nodes share would be no key of the ranks, which would deal them anew
    nth = F.row_number().over(Window.partitionBy("node_type", "node_id").orderBy(F.desc("received_at"), F.desc("email_id")))
    some = told.withColumn("nth", nth).where(F.col("nth") <= most)
    excerpt = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.left(F.coalesce("body", F.lit("")), F.lit(500)))
    line = F.concat(F.lit("- From "), F.coalesce("sender", F.lit("")), F.lit(", "), F.date_format("received_at", "yyyy-MM-dd"), F.lit(", re: "), F.coalesce("subject", F.lit("")), F.lit(": "), excerpt)
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("nth")).alias("at"), line.alias("line")))), lambda x: x.line)
    head = F.concat(F.lit("State document for "), "node_type", F.lit(" "), "node_id", F.lit(". Evidence emails:"))
    return some.groupBy("node_type", "node_id").agg(lines.alias("lines")).select("node_type", "node_id", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("evidence"))


def summarize_groups(rows: DataFrame, fn: Callable, most: int = 20) -> DataFrame:
    """(group_id, value, error): one answer for each group of ``rows`` (group_id, place, text), from its first ``most`` rows."""
    nth = F.row_number().over(Window.partitionBy("group_id").orderBy("place"))
    told = rows.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x.text), "\n").alias("texts"))
    return told.join(model_stage(told, fn, ["texts"], "string"), "texts").select("group_id", "value", "error")


def judge_ids(mentions: DataFrame, answers: DataFrame) -> DataFrame:
    """Mentions (email_id, kind, key, span, source, confidence) after a model's word on their ids (email_id, primary_ids, case_ids).

    An id that only its default makes a document becomes a case if the model calls it one; a known prefix is never overruled. Ids that a message isn't about weigh less; none is dropped.
    """
    keys = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: T.normalize_id(x))
    both = mentions.join(answers.select("email_id", keys(F.col("primary_ids")).alias("_primary"), keys(F.col("case_ids")).alias("_cases")), "email_id", "left")
    is_id = (F.col("source") == "regex") & (F.size(T.find_ids(F.col("span"))) > 0)
    key = T.normalize_id(F.col("span"))
    named = F.upper(F.substring_index("span", "-", 1)).isin(*DOCUMENT_PREFIXES)
    promoted = is_id & (F.col("kind") == "document") & F.array_contains("_cases", key) & ~named
    incidental = is_id & (F.size("_primary") > 0) & ~F.array_contains("_primary", key)
    changed = {"kind": F.when(promoted, "case").otherwise(F.col("kind")), "confidence": F.when(incidental, INCIDENTAL).otherwise(F.col("confidence"))}
    return both.withColumns(changed).drop("_primary", "_cases")


def model_mentions(answers: DataFrame) -> DataFrame:
    """(email_id, kind, key, span, source, confidence) from a model's names (email_id, projects, deliverables, topics, confidence): no addresses, no ids, each key once a message, the first field's."""
    kinds = (("projects", "project"), ("deliverables", "deliverable"), ("topics", "topic"))

    def named(kind: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(x).alias("span"))

    every = F.flatten(F.array(*[F.transform(M.capped(F.col(field), field), named(kind)) for field, kind in kinds]))
    rows = answers.select("email_id", F.posexplode(every).alias("place", "m"), M.clamp(F.col("confidence"), 0.5).alias("confidence")).select("email_id", "place", "m.*", "confidence")
    rows = rows.where((F.col("span") != "") & ~F.contains("span", F.lit("@")) & (F.size(T.find_ids(F.col("span"))) == 0))
    rows = rows.withColumn("key", F.when(F.col("kind") == "project", T.normalize_name(F.col("span"))).otherwise(T.normalize_name(F.col("span"), singular=True))).where("key != ''")
    nth = F.row_number().over(Window.partitionBy("email_id", "key").orderBy("place"))
    return rows.withColumn("nth", nth).where("nth = 1").select("email_id", "kind", "key", "span", F.lit("llm").alias("source"), "confidence")


def extract_full(found: DataFrame, answers: DataFrame) -> DataFrame:
    """All mentions: those found by rule, after the model's word on their ids, and the model's names. Messages whose call failed have no row in ``answers`` and keep what the rules found."""
    columns = ["email_id", "kind", "key", "span", "source", "confidence"]
    return judge_ids(found.select(columns), answers).select(columns).unionByName(model_mentions(answers).select(columns))


def compare_backends(results: DataFrame) -> DataFrame:
    """(backend, failures, mean_seconds, n, least, most, mean, stdev, distinct, clustered) of results (item_id, backend, value, seconds): failures have no value, times are those of successes; a backend is clustered when its values are too few different ones to rank by."""
    ok, v = F.col("value").isNotNull(), F.col("value")
    per = results.groupBy("backend").agg(
        F.count_if(~ok).alias("failures"), F.round(F.coalesce(F.avg(F.when(ok, F.col("seconds"))), F.lit(0.0)), 6).alias("mean_seconds"), F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("stdev"), F.count_distinct(v).alias("distinct"),
    )
    return per.withColumn("clustered", F.col("distinct") <= F.greatest(F.lit(2), F.floor(F.col("n") / 4)))


def side_by_side(results: DataFrame, backends: list[str]) -> DataFrame:
    """(item_id, a column a backend): the values that the backends gave each item."""
    return results.groupBy("item_id").pivot("backend", backends).agg(F.max("value"))
