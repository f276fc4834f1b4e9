"""Functions of message fields, names, summaries and calendar text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Ends of sentences, and characters that titles and drafts shed.
SENTENCE_END = ".!?。！？"
TITLE_TAIL = " .-–—:"
DRAFT_HEAD = "}]{[` \t\n"
#: How many answers of each kind a model may give.
MOST_ANSWERS = {"projects": 4, "deliverables": 6, "topics": 3, "primary_ids": 8, "case_ids": 8}
#: Sentences about free time that outlines end with.
OFFER = "Offer these times (from your calendar, already checked for conflicts): "
NONE_FREE = "Note: no open slots found in the next week — offer to look further out or suggest the recipient propose a time"
NO_CALENDAR = "Note: your calendar could not be checked for this email — confirm your own availability before replying"
#: Labels of the parties in a model's input.
FROM = "From (the other party, who wrote this email): "
TO = "To (the mailbox owner — everything is read and replied to from their perspective): "
#: Headers that hint at a message's kind.
HINTS = ("list-unsubscribe", "precedence", "auto-submitted")


def provisional_id(kind: Column, key: Column) -> Column:
    return F.concat_ws(":", kind, key)


def parse_provisional(entity_id: Column) -> Column:
    """struct<kind, key>; the key may itself hold colons. Null without any."""
    at = F.instr(entity_id, ":")
    return F.when(at > 0, F.struct(F.left(entity_id, at - 1).alias("kind"), F.substr(entity_id, at + 1).alias("key")))


def content_id(length: int, *parts: Column) -> Column:
    """The first ``length`` hex digits of the SHA-1 of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, length)


def display_name(value: Column) -> Column:
    """The name before ``<address>``, without quotes; null for a bare address."""
    v = F.trim(F.coalesce(value, F.lit("")))
    name = F.trim(F.btrim(F.trim(F.substring_index(v, "<", 1)), F.lit('"')))
    return F.when(F.contains(v, F.lit("<")) & F.endswith(v, F.lit(">")), F.nullif(name, F.lit("")))


def sender_name(sender: Column) -> Column:
    """struct<name, email>: the shown name without quotes, else the address; of a bare address what is before the @."""
    inner = F.regexp_extract(sender, r"^[^<]*<(.+?)>$", 1)
    name = F.trim(F.regexp_replace(F.substring_index(sender, "<", 1), "[\"']", ""))
    decorated = F.struct(F.coalesce(F.nullif(name, F.lit("")), inner).alias("name"), F.trim(inner).alias("email"))
    return F.when(inner != "", decorated).otherwise(F.struct(F.substring_index(sender, "@", 1).alias("name"), sender.alias("email")))


def addresses_of(line: Column) -> Column:
    """The bare addresses of a comma-separated header line."""
    return F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), ","), T.addr_only), lambda a: a != "")


def is_direct(to_line: Column, cc_line: Column, owner: str | None) -> Column:
    """False only where the owner is among Cc and not among To; true where the owner or To is unknown."""
    if owner is None:
        return F.lit(True)
    return to_line.isNull() | F.array_contains(addresses_of(to_line), owner) | ~F.array_contains(addresses_of(cc_line), owner)


def hint_headers(headers: Column) -> Column:
    """The headers that hint at a message's kind, of a map, by name in any case."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*HINTS))


def truncate(text: Column, most: int, marker: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(marker))).otherwise(text)


def first_lines(text: Column, lines: int = 5, most: int = 500) -> Column:
    """The first lines of a body, ``most`` characters of them."""
    return F.left(F.array_join(F.slice(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), 1, lines), "\n"), F.lit(most))


def trim_to_sentence(summary: Column) -> Column:
    """Up to the last end of a sentence; unchanged where there is none."""
    s = F.trim(summary)
    whole = F.regexp_extract(s, rf"(?s)^(.+[{SENTENCE_END}])", 1)
    return F.when(whole != "", whole).otherwise(s)


def join_bullets(bullets: Column) -> Column:
    """The bullets that say something, trimmed to sentences, one a line."""
    lines = F.transform(F.coalesce(bullets, F.array().cast("array<string>")), trim_to_sentence)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= 4) & x.rlike(r"[\p{L}\p{N}]")), "\n")


def is_meaningful(item: Column) -> Column:
    """Six characters at least, beginning with a letter or digit, with two letters in a row."""
    s = F.trim(F.coalesce(item, F.lit("")))
    return (F.length(s) >= 6) & s.rlike(r"^[\p{L}\p{N}]") & s.rlike("[A-Za-z]{2}")


def clean_draft(draft: Column) -> Column:
    """A draft without stray punctuation of the answer's format before it."""
    return F.ltrim(F.trim(draft), F.lit(DRAFT_HEAD))


def clamp(value: Column, default: float) -> Column:
    """Between 0 and 1; ``default`` where there is no number."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(value.cast("double"), F.lit(None)), F.lit(default))))


def capped(answers: Column, field: str) -> Column:
    return F.slice(F.coalesce(answers, F.array().cast("array<string>")), 1, MOST_ANSWERS.get(field, 8))


def contains_tokens(shorter: Column, longer: Column) -> Column:
    """Whether the words of ``shorter`` (four characters at least) are a run of the more numerous words of ``longer``."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return (F.length(shorter) >= 4) & (F.size(words(shorter)) > 0) & (F.size(words(shorter)) < F.size(words(longer))) & F.contains(padded(longer), padded(shorter))


def search_terms(query: Column) -> Column:
    """The quoted phrases, one for each word of a query, that all must match."""
    words = F.filter(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " ")


def clean_attendees(answers: Column, sender: Column) -> Column:
    """All addresses among the answers and of the sender, each once; names without one go."""
    every = F.concat(F.coalesce(answers, F.array().cast("array<string>")), F.array(F.coalesce(sender, F.lit(""))))
    return F.array_distinct(F.flatten(F.transform(every, T.find_addresses)))


def normalized_title(title: Column) -> Column:
    words = F.array_join(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: w != ""), " ")
    return F.rtrim(F.lower(words), F.lit(TITLE_TAIL))


def format_slot(start: Column, end: Column) -> Column:
    """``Mon 02 Nov 09:00-09:30`` from local timestamps; the end's day only where it is another."""
    clock = F.date_format(end, "HH:mm")
    last = F.when(F.to_date(start) == F.to_date(end), clock).otherwise(F.date_format(end, "EEE dd MMM HH:mm"))
    return F.concat(F.date_format(start, "EEE dd MMM HH:mm"), F.lit("-"), last)


def availability(scheduling: Column, read: Column, slots: Column, most: int = 3) -> Column:
    """The bullet on free time of a scheduling message: calendar not read, nothing fits, or the first slots (array of strings). Null for other messages."""
    offer = F.concat(F.lit(OFFER), F.array_join(F.slice(slots, 1, most), "; "))
    said = F.when(~F.coalesce(read, F.lit(False)), NO_CALENDAR).when(F.coalesce(F.size(slots), F.lit(0)) < 1, NONE_FREE).otherwise(offer)
    return F.when(F.coalesce(scheduling, F.lit(False)), said)


def age_label(seconds: Column, day: Column) -> Column:
    """How long ago: now, minutes, hours, days, then the date."""
    ago = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{name} ago"))
    return F.when(seconds < 60, "Just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86_400, ago(3600, "h")).when(seconds < 604_800, ago(86_400, "d")).otherwise(F.date_format(day, "MMM d"))


def prompt_block(sender: Column, to_line: Column, subject: Column) -> Column:
    """Who wrote to whom about what, for a model."""
    some = lambda value, none: F.coalesce(F.nullif(value, F.lit("")), F.lit(none))
    return F.concat_ws("\n", F.concat(F.lit(FROM), some(sender, "unknown")), F.concat(F.lit(TO), F.nullif(to_line, F.lit(""))), F.concat(F.lit("Subject: "), some(subject, "(no subject)")))


def reply_text(subject: Column) -> Column:
    return F.concat(F.lit('Reply to "'), F.coalesce(F.nullif(subject, F.lit("")), F.lit("(no subject)")), F.lit('"'))


def looks_like_html(text: Column) -> Column:
    """Whether a plain part holds tags or style blocks."""
    return text.rlike(r"(?i)</?(?:a|b|body|br|div|em|font|h[1-6]|head|hr|html|i|img|li|ol|p|span|strong|style|table|tbody|td|th|thead|tr|u|ul)\b[^>]*>") | text.rlike(CSS_BLOCK)


#: Fixed value: a style rule on its own.
CSS_BLOCK = r"[^\n{}]*\{[^{}]*:[^{}]*\}"


def clean_plain(text: Column) -> Column:
    """A plain part with markup taken out where it has any, entities read and white space normalised."""
    t = F.coalesce(text, F.lit(""))
    return T.normalize_whitespace(F.when(looks_like_html(t), F.regexp_replace(T.html_to_text(t), CSS_BLOCK, "")).otherwise(T.unescape(t)))
