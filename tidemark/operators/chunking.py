"""Splitting message bodies into body, signature and quoted chunks, and the mentions in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import mail as M
from tidemark.functions import text as T

SIZE, OVERLAP, SIGNATURE_REACH, MOST_AFTER = 800, 100, 900, 200
#: How reply history begins.
QUOTE_STARTS = (
    r"(?ms)^On\s(?=[^\n]*\d).{3,240}?\bwrote:", r"(?m)^.{0,120}?\bwrote:[^\S\n]*$", r"(?mi)^[^\S\n]*-{2,}\s*Original Message\s*-{2,}", r"(?mi)^[^\S\n]*-{2,}\s*Forwarded message\s*-{2,}",
    r"(?m)^[^\S\n]*_{5,}[^\S\n]*$", r"(?m)^[^\S\n]*From:\s*\S.*\n\s*(?:Sent|Date|To):\s",
)
#: What lines of a signature hold, and the line above one.
CONTACT = (
    r"\+?\d[\d\s().\-]{7,}\d", r"[\w.+-]+@[\w-]+\.[\w.]+", r"\bhttps?://|\bwww\.",
    r"(?i)\b\d+\s+\w+([\s\w]*)\b(?:St|Street|Ave|Avenue|Dr|Drive|Rd|Road|Blvd|Way|Lane|Ln|Suite|Ste|Floor|Fl)\b",
    r"(?i)\b(?:CEO|CTO|COO|CFO|VP|Director|Manager|Lead|Head of|Founder|Partner|Engineer|Analyst|Coordinator|President|Officer|Specialist|Consultant)\b",
    r"(?i)^Sent from my ", r"(?i)\b(?:unsubscribe|opt out|opt-out|you'?re receiving this|don'?t want these)\b", r"(?m)^\s*\S.*\|\s*\S",
)
DELIMITER = r"(?m)^[^\S\n]*(?:--+|__+|—)[^\S\n]*$"
CONTACT_BLOCK = 400
_STARTS, _CONTACT, _DELIMITER = [re.compile(p) for p in QUOTE_STARTS], [re.compile(p) for p in CONTACT], re.compile(DELIMITER)


def split_quoted(text: str) -> tuple[str, str]:
    """(text, quoted): from the first attribution, divider or header block on, or from the first line of ``>`` after which little unquoted text is left."""
    cuts = [m.start() for m in (p.search(text) for p in _STARTS) if m]
    at, below, blank, lead = len(text), 0, 0, 0
    for line in reversed(text.split("\n")):  # from the end, with the length of the unquoted text below: from its topmost line on, white space around it aside
        at -= len(line)
        if line.lstrip().startswith(">"):
            if below > MOST_AFTER:
                break
            cuts.append(at)
        elif line.strip():
            bare = line.lstrip()
            below = len(bare) + 1 + blank + lead + below if below else len(bare.rstrip())
            blank, lead = 0, len(line) - len(bare)
        elif below:
            blank += len(line) + 1
        at -= 1
    cut = min(cuts, default=len(text))
    return text[:cut].rstrip(), text[cut:].strip()


def _contact_start(text: str) -> int | None:
    """Where the last paragraphs begin of which at least half of the lines are contact details; long ones are prose."""
    begin, found = 0, []
    for gap in [*re.finditer(r"\n[ \t]*(?:\n[ \t]*)+", text), None]:
        end = gap.start() if gap else len(text)
        if text[begin:end].strip():
            found.append((begin, text[begin:end]))
        begin = gap.end() if gap else end
    start = None
    for at, block in reversed(found):
        lines = [x for x in block.split("\n") if x.strip()]
        hits = sum(any(p.search(x) for p in _CONTACT) for x in lines)
        if len(block) > CONTACT_BLOCK or not hits or 2 * hits < len(lines) or len(text) - at > SIGNATURE_REACH:
            break
        start = at
    return start


def split_signature(text: str) -> tuple[str, str]:
    """(text, signature): from the first delimiter line near the end on, and from the contact details above it, or from these alone. All of a text is no signature."""
    cut = next((m.start() for m in _DELIMITER.finditer(text) if len(text) - m.start() <= SIGNATURE_REACH), len(text))
    above = _contact_start(text[:cut])
    cut = cut if above is None else above
    return (text[:cut].rstrip(), text[cut:].strip()) if cut else (text, "")


_PARAGRAPH, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?;:])\s+|\n")


def _packed(parts: list[str], size: int, between: str) -> Iterator[list[str]]:
    """Neighbouring parts in groups whose text, joined by ``between``, is ``size`` characters at most; a longer part is alone."""
    group: list[str] = []
    length = 0
    for part in parts:
        if group and length + len(between) + len(part) > size:
            yield group
            group, length = [], -len(between)
        length = length + len(between) + len(part) if group else len(part)
        group.append(part)
    if group:
        yield group


def split_body(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of about ``size`` characters that end at paragraphs; longer paragraphs are cut at sentences, and a longer sentence stays whole.

    A piece begins with the last ``overlap`` characters of the one before, from where a sentence begins in them, else all of them, and its paragraphs are a blank line apart.
    """
    blocks: list[str] = []
    for paragraph in filter(None, map(str.strip, _PARAGRAPH.split(text.strip()))):
        if len(paragraph) <= size:
            blocks.append(paragraph)
        else:
            sentences = [x for x in _SENTENCE.split(paragraph) if x.strip()]
            blocks += [" ".join(g) for g in _packed(sentences, size, " ")]
    out: list[str] = []
    now: list[str] = []
    length = 0
    for block in blocks:
        if now and length + 2 + len(block) > size:
            out.append("\n\n".join(now))
            tail = out[-1][-overlap:] if overlap > 0 else ""
            begins = _SENTENCE.search(tail)
            tail = (tail[begins.end() :] if begins else tail).strip()
            now, length = ([tail], len(tail)) if tail else ([], 0)
        length += len(block) + (2 if now else 0)
        now.append(block)
    return [*out, "\n\n".join(now)] if now else out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for email, text in zip(batch["email_id"], batch["body"].fillna("")):
            rest, quoted = split_quoted(text)
            rest, signature = split_signature(rest)
            made = [(p, "body") for p in split_body(rest)] + [(signature, "signature")] * bool(signature) + [(p, "quoted") for p in split_body(quoted, overlap=0)]
            rows += [(email, i, f"{email}:{i}", kind, p) for i, (p, kind) in enumerate(made)]
        yield pd.DataFrame(rows, columns=["email_id", "ord", "chunk_id", "kind", "text"]).astype({"ord": "int32"})


def chunk_corpus(messages: DataFrame) -> DataFrame:
    """(email_id, ord, chunk_id, kind, text) from (email_id, body): body first, then signature, then quoted. No shuffle."""
    return messages.select(F.col("email_id").cast("long").alias("email_id"), "body").mapInPandas(_pieces, "email_id bigint, ord int, chunk_id string, kind string, text string")


def extract_mentions(chunks: DataFrame) -> DataFrame:
    """(email_id, chunk_id, kind, key, source): addresses as people and organisations, ids as cases and documents, each once a chunk, from body chunks."""
    body = chunks.where("kind = 'body' and trim(text) != ''")
    one = lambda kind, key: F.struct(kind.alias("kind"), key.alias("key"))
    # one pass over the chunks, whose making costs more than all the rest
    people = F.flatten(F.transform(T.find_addresses(F.col("text")), lambda a: F.array(one(F.lit("person"), a), one(F.lit("org"), T.org_from_domain(a)))))
    ids = F.transform(T.find_ids(F.col("text")), lambda i: one(i.kind, T.normalize_id(i.id)))
    rows = body.select("email_id", "chunk_id", F.explode(F.concat(people, ids)).alias("m")).select("email_id", "chunk_id", "m.*").where("kind != 'org' or key is not null")
    return rows.select("email_id", "chunk_id", "kind", "key", F.lit("regex").alias("source")).distinct()


def header_mentions(messages: DataFrame) -> DataFrame:
    """(email_id, kind, key, span, source, confidence): people and organisations of the sender, the recipients and the subject, and ids of the subject, each key once a message, the first."""
    lines = F.concat(F.array(F.coalesce("sender", F.lit(""))), F.split(F.coalesce("to_line", F.lit("")), ","), F.split(F.coalesce("cc_line", F.lit("")), ","))
    bare = T.strip_reply_prefixes(F.col("subject"))
    one = lambda kind, key, span, source: F.struct(kind.alias("kind"), key.alias("key"), span.alias("span"), F.lit(source).alias("source"))

    def person(source: str):
        return lambda x: F.array(one(F.lit("person"), T.addr_only(x), F.coalesce(M.display_name(x), T.addr_only(x)), source), one(F.lit("org"), T.normalize_name(T.org_from_domain(T.addr_only(x))), T.org_from_domain(T.addr_only(x)), source))

    people = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(T.addr_only(x), F.lit("@"))), person("header")))
    told = F.flatten(F.transform(T.find_addresses(bare), person("regex")))
    ids = F.transform(T.find_ids(bare), lambda i: one(i.kind, T.normalize_id(i.id), i.id, "regex"))
    rows = messages.select("email_id", F.posexplode(F.concat(people, told, ids)).alias("place", "m")).select("email_id", "place", "m.*").where("coalesce(key, '') != '' and span is not null")
    first = Window.partitionBy("email_id", "kind", "key").orderBy("place")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "place").withColumn("confidence", F.lit(1.0))


#: Fixed value: the headers that name people.
PARTICIPANTS = ("From", "To", "Cc", "Bcc", "Reply-To")


def extract_deterministic(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(email_id, chunk_id, kind, key, span, source, confidence) by rules alone: people and organisations of the sender, the recipients, five headers and the subject, and ids of the subject (no chunk) and of body chunks; of one kind, key and chunk the first.

    ``messages``: (email_id, sender, recipients, headers, subject); ``chunks``: (email_id, chunk_id, kind, text). A message's own mentions are told apart inside its row, a chunk's inside the chunk's.
    """
    none = F.array().cast("array<string>")
    lines = F.concat(F.array(F.coalesce("sender", F.lit(""))), F.coalesce("recipients", none), *[F.coalesce(F.split(T.header(F.col("headers"), h), ","), none) for h in PARTICIPANTS])
    bare = T.strip_reply_prefixes(F.col("subject"))
    one = lambda kind, key, span, source: F.struct(kind.alias("kind"), key.alias("key"), span.alias("span"), F.lit(source).alias("source"))

    def person(source: str):
        def of(x):
            address = T.addr_only(x)
            org = T.org_from_domain(address)
            return F.array(one(F.lit("person"), address, F.coalesce(M.display_name(x), address) if source == "header" else address, source), one(F.lit("org"), T.normalize_name(org, singular=True), org, source))

        return of

    people = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(T.addr_only(x), F.lit("@"))), person("header")))
    told = F.flatten(F.transform(T.find_addresses(bare), person("regex")))
    ids = lambda text: F.transform(T.find_ids(text), lambda i: one(i.kind, T.normalize_id(i.id), i.id, "regex"))
    found = F.filter(F.concat(people, told, ids(bare)), lambda m: (F.coalesce(m.key, F.lit("")) != "") & m.span.isNotNull())

    def firsts(all_):
        """The first of each kind and key."""
        return F.filter(all_, lambda m, i: F.forall(F.slice(all_, F.lit(1), i), lambda n: (n.kind != m.kind) | (n.key != m.key)))

    fresh = F.element_at(F.transform(F.array(found), firsts), 1)
    own = messages.select("email_id", F.lit(None).cast("string").alias("chunk_id"), F.inline(fresh))
    body = chunks.where("kind = 'body'").select("email_id", F.col("chunk_id").cast("string").alias("chunk_id"), F.inline(F.element_at(F.transform(F.array(ids(F.col("text"))), firsts), 1)))
    return own.unionByName(body).withColumn("confidence", F.lit(1.0))


def resolve_entities(mentions: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kind, key, entity_id, rung) of each distinct mention: the known entity of that key, else of that alias, else a new one with a content id."""
    keys = mentions.select("kind", "key").distinct()
    exact = known.select("kind", "key", F.col("entity_id").alias("exact"))
    first = Window.partitionBy("kind", "key").orderBy("entity_id")
    alias = aliases.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("kind", "key", F.col("entity_id").alias("alias"))
    new = F.concat(F.lit("ent_"), F.substring(F.sha1(F.concat_ws(":", "kind", "key")), 1, 16))
    both = keys.join(exact, ["kind", "key"], "left").join(alias, ["kind", "key"], "left")
    return both.select("kind", "key", F.coalesce("exact", "alias", new).alias("entity_id"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").otherwise("new").alias("rung"))


#: Characters of inputs that a model stage holds at once, about.
HELD = 2_000_000


def digest(columns: list[str]) -> Column:
    """A digest of inputs of any length, by which equal ones meet; nulls are told from empty texts."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *told), 256)


def _held(batch: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """``batch`` in slices of about ``most`` characters."""
    chars = np.cumsum(sum((batch[c].map(lambda x: len(x) if isinstance(x, str) else 1).to_numpy() for c in batch.columns), np.zeros(len(batch), np.int64)))
    cuts = np.flatnonzero(np.diff(chars // most, prepend=0)).tolist()
    for low, high in zip([0, *cuts], [*cuts, len(batch)]):
        if low < high:
            yield batch.iloc[low:high]


def model_stage(rows: DataFrame, fn, columns: list[str], schema: str, n: int | None = None) -> DataFrame:
    """``fn`` (list of dicts to list of values) over batches of distinct inputs: (columns, value, error). A batch that fails is tried row by row, and a row that fails keeps its error.

    With ``n`` inputs are long: they are told apart by the ``digest`` of ``columns`` that ``rows`` has as ``_digest``, dealt by it to ``n`` parts, and not given back: (_digest, value, error).
    """
    keys, most = ["_digest"] if n else columns, HELD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (some for whole in batches for some in _held(whole, most)):
            asked = batch[columns].to_dict("records")
            try:
                values, errors = list(fn(asked)), [None] * len(asked)
            except Exception:
                values, errors = [], []
                for one in asked:
                    try:
                        values += fn([one])
                        errors.append(None)
                    except Exception as e:
                        values.append(None)
                        errors.append(str(e))
            yield batch[keys].assign(value=values, error=errors)

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    some = rows.select(*keys, *columns).repartition(n, "_digest").groupBy("_digest").agg(*[F.first(c).alias(c) for c in columns]) if n else rows.select(*columns).distinct()
    return some.mapInPandas(run, f"{kept}, value {schema}, error string")
