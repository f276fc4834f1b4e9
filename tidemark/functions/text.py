"""Text and header functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that raise a message's urgency.
URGENCY = ("urgent", "asap", "as soon as possible", "action required", "immediately", "deadline", "important", "time-sensitive", "time sensitive")
#: Nouns that names carry or drop at will.
GENERIC = ("project", "programme", "program", "initiative", "case", "ticket", "incident", "issue")
#: Prefixes of ids of cases and of documents.
CASE_PREFIXES = ("CASE", "CS", "SUP", "SUPPORT", "INC", "TICKET", "TKT", "REQ", "ISSUE", "BUG", "SR")
#: Mail providers whose domain names no organisation.
FREE_MAIL = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.co.uk", "ymail.com", "aol.com", "icloud.com", "me.com", "mac.com",
    "proton.me", "protonmail.com", "pm.me", "gmx.com", "gmx.de", "mail.com", "zoho.com", "yandex.com", "fastmail.com", "hey.com", "qq.com", "163.com", "126.com",
)
#: Phrases that arrange a time, two points each, and weaker ones, one point each.
STRONG = (
    r"\bare you (free|available)\b", r"\bwhen are you (free|available)\b", r"\byour availability\b", r"\blet me know (?:your |what )?(?:availability|times?|when)\b",
    r"\b(schedule|set ?up|book|arrange|line up)\s+(?:a|an|our|some)?\s*(call|meeting|time|chat|sync|catch[- ]?up|appointment|slot|session|demo|interview)\b",
    r"\bfind (?:a|some) time\b", r"\b(re-?schedule|postpone|push back|move)\b[^.!?]{0,30}\b(call|meeting|appointment|sync|chat|it|this)\b", r"\bre-?schedule\b",
    r"\bdoes\b[^.!?]{0,25}\bwork for you\b", r"\bwhat time works\b", r"\bwhen works\b", r"\bwork(s)? for you\b", r"\bcalendar invite\b", r"\bmeeting (request|invitation)\b",
    r"\bsend (?:you |over )?an? invite\b", r"\bblock (?:off |out )?(?:some |an? )?(?:time|hour|slot|\d+\s*(?:min(?:ute)?s?|hours?))\b", r"\bpencil (?:you |it |us )?in\b",
    r"\bhop on a (call|zoom|meet)\b", r"\bgrab (?:a )?(coffee|lunch|drink|time)\b",
)
WEAK = (
    r"\b(meeting|call|sync|stand-?up|appointment|interview|demo)\b", r"\bcatch[- ]?up\b", r"\bcalendar\b", r"\bavailab(le|ility)\b", r"\b(time ?slot|slot)\b",
    r"\b(mon|tues|wednes|thurs|fri|satur|sun)day\b", r"\b(tomorrow|next week|this week|later today)\b", r"\b\d{1,2}\s?(:\d{2})?\s?(am|pm)\b", r"\b\d{1,2}:\d{2}\b",
    r"\b(zoom|google meet|hangout|teams|webex)\b", r"\b(morning|afternoon|evening)\b", r"\b(free|available)\b",
)

#: Words of which a text in lower case must hold one of each group for the phrase to be in it at all. Most texts lack them, and words are found far faster than phrases.
STRONG_NEEDS = (
    [("you",), ("free", "available")], [("when",), ("free", "available")], [("availability",)], [("let",), ("know",)],
    [("schedule", "set", "book", "arrange", "line"), ("call", "meeting", "time", "chat", "sync", "catch", "appointment", "slot", "session", "demo", "interview")],
    [("find",), ("time",)], [("schedule", "postpone", "push", "move"), ("call", "meeting", "appointment", "sync", "chat", "it", "this")], [("schedule",), ("re",)],
    [("does",), ("work",)], [("what",), ("works",)], [("when",), ("works",)], [("work",), ("you",)], [("calendar",), ("invite",)], [("meeting",), ("request", "invitation")],
    [("send",), ("invite",)], [("block",), ("time", "hour", "slot", "min")], [("pencil",)], [("hop",), ("call", "zoom", "meet")], [("grab",), ("coffee", "lunch", "drink", "time")],
)
WEAK_NEEDS = (
    [("meeting", "call", "sync", "stand", "appointment", "interview", "demo")], [("catch",)], [("calendar",)], [("availab",)], [("slot",)],
    [("day",)], [("tomorrow", "next", "this", "later")], [("am", "pm")], [(":",)], [("zoom", "google", "hangout", "teams", "webex")], [("morning", "afternoon", "evening")], [("free", "available")],
)


#: Why each phrase counts, in the order of the phrases; content types, methods and the reasons of invitations and of bulk mail.
STRONG_WHY = (
    "asks whether the recipient is free", "asks when the recipient is free", "asks for availability", "asks for times", "proposes scheduling a meeting", "proposes finding a time", "asks to reschedule", "mentions rescheduling",
    "proposes a specific time", "asks what time works", "asks when works", "proposes a time for confirmation", "references a calendar invite", "is a meeting request", "offers to send an invite", "proposes blocking time",
    "proposes pencilling in a time", "proposes a call", "proposes meeting up",
)
WEAK_WHY = (
    "mentions a meeting", "mentions catching up", "mentions a calendar", "mentions availability", "mentions a slot", "names a weekday", "names a relative day", "names a clock time", "names a clock time", "mentions a meeting tool",
    "names a time of day", "mentions being free",
)
INVITES, INVITE_METHODS = ("text/calendar", "application/ics"), ("method=request", "method=reply", "method=cancel")
INVITE_WHY, BULK_WHY = "carries a calendar invite (text/calendar)", "discounted: bulk/automated headers, no explicit ask"


def addr_only(value: Column) -> Column:
    """The bare address of ``Name <addr>``, in lower case."""
    v = F.trim(value)
    inner = F.regexp_extract(v, r"<([^<]*)>$", 1)
    return F.lower(F.trim(F.when(v.rlike(r"<[^<]*>$"), inner).otherwise(v)))


def local_part(value: Column) -> Column:
    return F.substring_index(addr_only(value), "@", 1)


def header(headers: Column, name: str) -> Column:
    """A header by name in any case; null when absent."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())), 0)


def strip_reply_prefixes(subject: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*(?:(?:re|fwd|fw|aw|sv)\s*:\s*)+", ""))


#: Fixed value: an address in running text.
ADDRESS = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"


def find_addresses(text: Column) -> Column:
    """All addresses of a text, in lower case, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ADDRESS), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def parse_rfc3339(value: Column, zone: str = "UTC") -> Column:
    """A time as calendars write it: with an offset or Z, without one in ``zone``, a bare date as midnight there; fractions beyond microseconds are cut. Null for what can't be read."""
    text = F.regexp_replace(F.regexp_replace(F.trim(value), "[zZ]$", "+00:00"), r"(\.\d{6})\d+", "$1")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    offset = text.rlike(r"[+-]\d{2}:?\d{2}(:\d{2})?$") & text.rlike("[T ]")
    at = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.try_to_timestamp(F.when(offset, text).otherwise(F.concat(text, F.lit("+00:00")))))
    return F.when(offset, at).otherwise(F.to_utc_timestamp(at, zone))


def default_range(now: Column, days: int = 7) -> Column:
    """struct<start, end>: the usual look-ahead."""
    return F.struct(now.alias("start"), F.timestamp_micros(F.unix_micros(now) + days * 86_400_000_000).alias("end"))


def normalize_id(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w]+", ""))


def find_ids(text: Column) -> Column:
    """Machine ids (PREFIX-123[-45], then #123), each key once, in order: array<struct<id, kind>>."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,10}-\d{1,6}(?:-\d{1,6})?)\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(#\d{3,})"), F.lit(1)))
    fresh = F.filter(F.array_distinct(found), lambda x: x != "")
    kind = lambda x: F.when(F.substring_index(x, "-", 1).isin(*CASE_PREFIXES) | F.startswith(x, F.lit("#")), "case").otherwise("document")
    return F.transform(fresh, lambda x: F.struct(x.alias("id"), kind(x).alias("kind")))


def org_from_domain(address: Column) -> Column:
    domain = F.substring_index(address, "@", -1)
    label = F.substring_index(domain, ".", 1)
    return F.when((F.instr(address, "@") > 0) & ~domain.isin(*FREE_MAIL) & (F.length(label) >= 2), label)


def normalize_name(text: Column, singular: bool = False) -> Column:
    """The identity key of a name: lower case, no punctuation, article or generic nouns, and for common nouns no plural."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s@.+-]+", " "), r"(?U)\s+", " "))
    key = F.regexp_replace(key, r"^(the|an|a) ", "")
    kept = F.array_join(F.filter(F.split(key, " "), lambda w: ~w.isin(*GENERIC)), " ")
    key = F.regexp_replace(F.when(kept != "", kept).otherwise(key), r"[.\-_\s]+$", "")
    if not singular:
        return key
    last = F.substring_index(key, " ", -1)
    folded = F.when((F.length(last) > 4) & F.endswith(last, F.lit("ies")), F.regexp_replace(key, "ies$", "y")).when((F.length(last) > 3) & last.rlike("s$") & ~last.rlike("(ss|us|is|as|os|es)$"), F.regexp_replace(key, "s$", ""))
    return F.coalesce(folded, key)


#: Characters without width, kinds of spaces, and tags that end a line or hide their content.
INVISIBLE = r"[\u200b-\u200d\u00ad\u034f\u2060\ufeff]"
SPACES = r"[ \t\f\x0b\u00a0\u2000-\u200a\u202f\u205f\u3000]+"
BLOCK_TAGS = (
    "address", "article", "blockquote", "br", "div", "dd", "dl", "dt", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "li", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
SKIP_TAGS = ("script", "style", "head", "title", "noscript")
#: Named characters; the ampersand comes last.
ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "deg": "°", "times": "×", "eacute": "é", "egrave": "è",
    "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "amp": "&",
}


def normalize_whitespace(text: Column) -> Column:
    """Line ends as line feeds, nothing invisible, runs of blanks as one, lines trimmed, one blank line at most."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), SPACES, " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def unescape(text: Column) -> Column:
    """Named and numbered characters as themselves; numbers beyond the basic plane stay as they are."""
    number = lambda e: F.when(e.rlike("^&#[xX]"), F.conv(F.substr(e, F.lit(4), F.length(e) - 4), 16, 10)).otherwise(F.substr(e, F.lit(3), F.length(e) - 3)).cast("int")
    char = lambda e: F.decode(F.unhex(F.lpad(F.hex(number(e)), 4, "0")), "UTF-16BE")
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{2,5}|[xX][0-9a-fA-F]{2,4});"), F.lit(0)))
    codes = F.filter(codes, lambda e: (number(e) < 0xD800) | number(e).between(0xE000, 0xFFFF))
    t = F.aggregate(codes, text, lambda t, e: F.replace(t, e, char(e)))
    # only the named characters that a text has are looked for in it; the ampersand comes last, so that nothing is read twice
    pattern = F.lit("&(?:" + "|".join(e for e in ENTITIES if e != "amp") + ");")
    shown = F.create_map(*[F.lit(x) for e, c in ENTITIES.items() for x in (f"&{e};", c)])
    told = F.element_at(F.transform(F.array(t), lambda x: F.aggregate(F.array_distinct(F.regexp_extract_all(x, pattern, F.lit(0))), x, lambda text, e: F.replace(text, e, F.element_at(shown, e)))), 1)
    return F.replace(told, F.lit("&amp;"), F.lit("&"))


def html_to_text(html: Column) -> Column:
    """Visible text of a page by patterns: hidden elements and comments go, block tags end lines, entities are read."""
    t = F.coalesce(html, F.lit(""))
    for tag in SKIP_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n")
    return normalize_whitespace(unescape(F.regexp_replace(t, r"</?[A-Za-z!][^>]*>", "")))


def normalize_topic(topic: Column) -> Column:
    """Lower case, quotes dropped, three words at most, ``other`` for none."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(topic, F.lit(""))), r"[\"'.]", ""))
    return F.coalesce(F.nullif(F.array_join(F.slice(F.split(t, r"\s+"), 1, 3), " "), F.lit("")), F.lit("other"))


def urgency_hits(subject: Column, body: Column | None = None) -> Column:
    text = F.lower(F.concat_ws("\n", subject, body) if body is not None else F.coalesce(subject, F.lit("")))
    return F.filter(F.array(*[F.lit(w) for w in URGENCY]), lambda w: F.contains(text, w))


def is_invite(content_type: Column) -> Column:
    """Whether a content type is that of a calendar invitation, or names a file of one."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.contains(kind, F.lit(".ics")) | reduce_or([F.contains(kind, F.lit(x)) for x in INVITES]) | reduce_or([F.contains(F.replace(kind, F.lit(" "), F.lit("")), F.lit(x)) for x in INVITE_METHODS])


def reduce_or(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def scheduling_signals(subject: Column, body: Column, content_type: Column, bulk: Column, most: int = 2000) -> Column:
    """struct<points, reasons, related>: whether a message arranges a time, and why.

    Subject and the first ``most`` characters of the body are searched: two points a strong phrase, one a weak one, each once. Bulk mail with weak ones only has none. Two points are enough, and an invitation is, whatever its points.
    """
    text = F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.left(F.coalesce(body, F.lit("")), F.lit(most)))
    invite, bulk = is_invite(content_type), F.coalesce(bulk, F.lit(False))
    # the text is named once, so that it isn't put together for each pattern
    holds = lambda low, needs: reduce(and_, [reduce(or_, [F.contains(low, F.lit(w)) for w in some]) for some in needs])
    hit = lambda t, patterns, whys, needs: [F.when(holds(t.low, need) & t.said.rlike("(?i)" + p), F.lit(why)) for p, why, need in zip(patterns, whys, needs, strict=True)]
    # repeated words are looked through once
    both = F.array(F.struct(text.alias("said"), F.array_join(F.array_distinct(F.split(F.lower(text), " ")), " ").alias("low")))
    found = F.transform(both, lambda t: F.struct(F.array_compact(F.array(*hit(t, STRONG, STRONG_WHY, STRONG_NEEDS))).alias("strong"), F.array_compact(F.array(*hit(t, WEAK, WEAK_WHY, WEAK_NEEDS))).alias("weak")))

    def judged(f: Column) -> Column:
        void = bulk & (F.size(f.strong) == 0) & ~invite
        points = F.when(void, 0).otherwise(2 * F.size(f.strong) + F.size(f.weak))
        reasons = F.concat(F.when(invite, F.array(F.lit(INVITE_WHY))).otherwise(F.array().cast("array<string>")), f.strong, f.weak, F.when(void, F.array(F.lit(BULK_WHY))).otherwise(F.array().cast("array<string>")))
        return F.struct(points.alias("points"), reasons.alias("reasons"), (invite | (points >= 2)).alias("related"))

    return F.element_at(F.transform(found, judged), 1)


def no_reply(sender: Column, precedence: Column, unsubscribe: Column, auto: Column, reply_to: Column) -> Column:
    """True or false where headers and sender decide it, else null."""
    local, precedence = local_part(sender), F.lower(F.trim(F.coalesce(precedence, F.lit(""))))
    weak = local.rlike("^(notifications|alerts)")
    distinct = reply_to.isNotNull() & (addr_only(reply_to) != addr_only(sender))
    auto_set = auto.isNotNull() & (F.lower(F.trim(auto)) != "no")
    certain = local.rlike("^(no-reply|noreply|donotreply|do-not-reply)") | precedence.isin("bulk", "junk", "list") | (unsubscribe & ~distinct) | (weak & unsubscribe)
    return F.when(certain, True).when(~weak & ~unsubscribe & ~auto_set & (precedence == ""), False)


def no_reply_reason(sender: Column, precedence: Column, unsubscribe: Column, auto: Column, reply_to: Column) -> Column:
    """Why ``no_reply`` decides as it does: the first rule that holds; null where it doesn't decide."""
    local, precedence = local_part(sender), F.lower(F.trim(F.coalesce(precedence, F.lit(""))))
    distinct = reply_to.isNotNull() & (addr_only(reply_to) != addr_only(sender))
    weak = local.rlike("^(notifications|alerts)")
    said = lambda before, value, after: F.concat(F.lit(before), value, F.lit(after))
    return (
        F.when(local.rlike("^(no-reply|noreply|donotreply|do-not-reply)"), said("sender local-part matches no-reply pattern (", local, "@...)"))
        .when(precedence.isin("bulk", "junk", "list"), said("Precedence header indicates bulk mail (Precedence: ", precedence, ")"))
        .when(unsubscribe & ~distinct, "List-Unsubscribe present with no distinct reply-to address")
        .when(weak & unsubscribe, said("sender matches automated pattern (", local, "@...) corroborated by bulk headers"))
        .when(~weak & ~unsubscribe & ~(auto.isNotNull() & (F.lower(F.trim(auto)) != "no")) & (precedence == ""), "personal sender, no bulk headers")
    )


def reply_effort(points: Column, scheduling: Column) -> Column:
    n = points + F.coalesce(scheduling, F.lit(False)).cast("int")
    return F.when(points > 0, F.when(n <= 2, "quick").when(n <= 4, "moderate").otherwise("involved"))


#: Fixed value: an address in brackets after reply prefixes.
RELAY_TAG = r"(?is)^((?:\s*(?:re|fwd|fw)\s*:\s*)*)\[\s*([^\]\s@]+@[^\]\s@]+\.[^\]\s@]+)\s*\]\s*(.*)$"


def split_relay_tag(subject: Column) -> Column:
    """struct<sender, rest>: the address of a leading tag and the subject without it. Reply prefixes stay, and so does a subject that is nothing but a tag."""
    rest = F.trim(F.regexp_extract(subject, RELAY_TAG, 3))
    tagged = subject.rlike(RELAY_TAG)
    bare = F.trim(F.concat(F.regexp_extract(subject, RELAY_TAG, 1), rest))
    return F.struct(F.when(tagged, F.regexp_extract(subject, RELAY_TAG, 2)).alias("sender"), F.when(tagged & (rest != ""), bare).otherwise(subject).alias("rest"))
