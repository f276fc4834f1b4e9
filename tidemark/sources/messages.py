"""Raw message resources (JSON with a recursive MIME tree) as typed rows, and calendar event JSON as flat rows, by VARIANT and built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: The headers that are kept, by their usual names.
KEPT = ("From", "To", "Cc", "Subject", "Date", "Reply-To", "List-Unsubscribe", "List-Id", "Precedence", "Auto-Submitted", "Content-Type")
#: Levels of parts inside parts that are read.
DEPTH = 16


def decoded(data: Column) -> Column:
    """base64url with or without padding as text; what is no UTF-8 is replaced, and what is no base64 is empty."""
    bare = F.rtrim(F.translate(data, "-_", "+/"), F.lit("="))
    whole = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    return F.coalesce(F.make_valid_utf8(F.try_to_binary(whole, F.lit("base64")).cast("string")), F.lit(""))


def decoded_words(value: Column) -> Column:
    """A header with its encoded words read (base64 or quoted, in UTF-8, ASCII or Latin-1); words in other charsets stay as they are."""
    v = F.regexp_replace(F.coalesce(value, F.lit("")), r"(\?=)\s+(?==\?)", "$1")
    words = F.array_distinct(F.regexp_extract_all(v, F.lit(r"=\?[^?\s]+\?[BbQq]\?[^?]*\?="), F.lit(0)))

    def quoted(data: Column) -> Column:
        tokens = F.regexp_extract_all(F.replace(data, F.lit("_"), F.lit(" ")), F.lit("(?s)=[0-9A-Fa-f]{2}|."), F.lit(0))
        return F.unhex(F.array_join(F.transform(tokens, lambda t: F.when((F.length(t) == 3) & F.startswith(t, F.lit("=")), F.substring(t, 2, 2)).otherwise(F.hex(F.encode(t, "UTF-8")))), ""))

    def read(word: Column) -> Column:
        part = lambda n: F.split_part(word, F.lit("?"), F.lit(n))
        data = F.when(F.upper(part(3)) == "B", F.try_to_binary(part(4), F.lit("base64"))).otherwise(quoted(part(4)))
        charset = F.lower(part(2))
        text = F.when(charset.isin("utf-8", "utf8", "us-ascii"), F.make_valid_utf8(data.cast("string"))).when(charset.isin("iso-8859-1", "latin-1", "latin1"), F.decode(data, "ISO-8859-1"))
        return F.coalesce(text, word)

    return F.aggregate(words, v, lambda t, w: F.replace(t, w, read(w)))


def _parts(payload: Column) -> tuple[Column, Column]:
    """array<struct<path, part>> of a message's parts in the order of the tree, each before its own parts, and whether some lie deeper than is read."""
    one = lambda path, part: F.struct(path.alias("path"), part.alias("part"))

    def below(level: Column) -> Column:
        def of(p: Column) -> Column:
            inner = F.coalesce(F.try_variant_get(p.part, "$.parts", "array<variant>"), F.array().cast("array<variant>"))
            return F.transform(inner, lambda x, i: one(F.concat(p.path, F.lit("."), F.lpad(i.cast("string"), 6, "0")), x))

        return F.flatten(F.transform(level, of))

    # each level is bound as an element of an array, so that the levels below don't read it again
    start = F.struct(F.array(one(F.lit(""), payload)).alias("level"), F.array(one(F.lit(""), payload)).alias("all"))

    def step(state: Column, _: Column) -> Column:
        return F.element_at(F.transform(F.array(below(state.level)), lambda found: F.struct(found.alias("level"), F.concat(state.all, found).alias("all"))), 1)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step)
    flat = lambda all_: F.transform(all_, lambda p: F.struct(p.path.alias("path"), F.try_variant_get(p.part, "$.mimeType", "string").alias("kind"), F.coalesce(F.try_variant_get(p.part, "$.filename", "string"), F.lit("")).alias("filename"), F.try_variant_get(p.part, "$.body.data", "string").alias("data")))
    told = F.element_at(F.transform(F.array(walked), lambda w: F.struct(F.array_sort(flat(w.all)).alias("parts"), F.exists(w.level, lambda p: F.try_variant_get(p.part, "$.parts", "array<variant>").isNotNull()).alias("deep"))), 1)
    return told


def parse_messages(raw: DataFrame) -> DataFrame:
    """(email_id, thread_id, sender, recipients, subject, body, read_status, headers, has_attachments, error, received_at) from a column ``raw`` of message JSON.

    Plain text goes before HTML, and attachments are not text. Only the headers of ``KEPT`` are kept, of each name the first, with encoded words read. ``error`` is set, and all else null, where a message can't be read:
    it is no JSON object, has no id, or has parts nested deeper than ``DEPTH``.
    """
    rows = raw.select(F.try_parse_json("raw").alias("m"))
    get = lambda path, kind="string": F.try_variant_get("m", path, kind)
    heads = F.coalesce(get("$.payload.headers", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>"))
    rows = rows.select("m", get("$.id").alias("id"), heads.alias("heads"), _parts(get("$.payload", "variant")).alias("tree"))
    first = lambda name: F.get(F.filter("heads", lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))
    entries = F.array_compact(F.array(*[F.when(first(n).isNotNull(), F.struct(F.lit(n).alias("key"), decoded_words(first(n)["value"]).alias("value"))) for n in KEPT]))
    text = lambda kind: F.array_join(F.filter(F.transform(F.filter("tree.parts", lambda p: (p.kind == kind) & (p.filename == "")), lambda p: decoded(F.coalesce(p.data, F.lit("")))), lambda t: t != ""), "\n")
    error = F.when(F.col("m").isNull(), "not JSON").when(F.col("id").isNull(), "no id").when(F.col("tree.deep"), "nested too deeply")
    labels = F.coalesce(get("$.labelIds", "array<string>"), F.array().cast("array<string>"))
    read = rows.select("m", "id", F.map_from_entries(entries).alias("headers"), F.btrim(text("text/plain"), F.lit(" \t\r\n\f")).alias("plain"), text("text/html").alias("html"), F.exists("tree.parts", lambda p: p.filename != "").alias("attached"), labels.alias("labels"), error.alias("error"))
    header = lambda name: F.element_at("headers", name)
    people = F.filter(F.transform(F.split(F.concat_ws(",", header("To"), header("Cc")), ","), lambda x: F.trim(x)), lambda x: x != "")
    body = F.when(F.col("plain") != "", F.col("plain")).otherwise(T.html_to_text(F.col("html")))
    known = {
        "email_id": F.col("id"), "thread_id": get("$.threadId"), "sender": header("From"), "recipients": people, "subject": header("Subject"), "body": body, "read_status": F.when(F.array_contains("labels", "UNREAD"), "unread").otherwise("read"),
        "headers": F.col("headers"), "has_attachments": F.col("attached"), "received_at": F.timestamp_millis(F.expr("try_cast(try_variant_get(m, '$.internalDate', 'string') as bigint)")),
    }
    good = F.col("error").isNull()
    out = {k: F.when(good, v) for k, v in known.items()}
    return read.select(*[out[k].alias(k) for k in list(known)[:-1]], "error", out["received_at"].alias("received_at"))


def read_messages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(raw, received_at): exported message JSON, one message a line, the newest first, ``limit`` of them. Only the date is read of a message before the limit."""
    rows = spark.read.text(path).where("trim(value) != ''").select(F.col("value").alias("raw"))
    ms = F.expr("try_cast(get_json_object(raw, '$.internalDate') as bigint)")
    newest = rows.withColumn("received_at", F.timestamp_millis(ms)).orderBy(F.desc_nulls_last("received_at"), F.get_json_object("raw", "$.id"))
    return newest if limit is None else newest.limit(limit)


def parse_calendar(raw: DataFrame) -> DataFrame:
    """(event_id, summary, start, end, all_day, attendees, location) from a column ``raw`` of event JSON, in order of start, unknown ones last; cancelled events are left out."""
    when = "struct<date:string,dateTime:string>"
    e = F.from_json("raw", f"id string, status string, summary string, location string, start {when}, end {when}, attendees array<struct<email:string>>").alias("e")
    rows = raw.select(e).where("e.id is not null and coalesce(e.status, '') != 'cancelled'")
    at = lambda c: F.coalesce(F.try_to_timestamp(c.dateTime), F.try_to_timestamp(c.date))
    guests = F.filter(F.transform(F.coalesce("e.attendees", F.array().cast("array<struct<email:string>>")), lambda a: F.lower(a.email)), lambda a: a.isNotNull())
    rows = rows.select(F.col("e.id").alias("event_id"), "e.summary", at(F.col("e.start")).alias("start"), at(F.col("e.end")).alias("end"), F.col("e.start.date").isNotNull().alias("all_day"), guests.alias("attendees"), "e.location")
    return rows.orderBy(F.asc_nulls_last("start"), "event_id")


def parse_busy(raw: DataFrame) -> DataFrame:
    """(calendar_id, start, end) in microseconds from rows (calendar_id, raw) of busy periods as JSON; periods that can't be read are left out."""
    e = F.from_json("raw", "start string, end string").alias("e")
    at = lambda c: F.unix_micros(F.try_to_timestamp(c))
    return raw.select("calendar_id", e).select("calendar_id", at(F.col("e.start")).alias("start"), at(F.col("e.end")).alias("end")).where("start is not null and end is not null")
