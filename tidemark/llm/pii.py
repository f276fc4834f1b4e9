"""Personal data found by pattern, and terms that reveal it by information theory, in DataFrame functions only.

*Protected entities* are e-mail addresses, IP addresses, payment cards, phone numbers and secrets. Each of the first four kinds is matched from the left without
overlaps; a match that fails its test (octets up to 255, Luhn, number of digits) is dropped and not tried again. The patterns use possessive
repeats and start only where a match can, which changes no match but keeps every text linear. A *secret* is an unbroken run of ``SECRET`` or more ASCII letters, digits and
low lines that has both letters and digits and whose characters carry at least ``BITS`` bits (length times the entropy of its own characters): keys, tokens, passwords, and not words.

*Revealing terms* are words of four letters or more. For entity e and term t, with the rows of the corpus as events, the
corpus gives p(e), p(t) and p(t, e); t discloses PMI(t; e) = log p(t, e) / p(t) p(e) of the IC(e) = -log p(e) bits that e holds (Sanchez and Batet, 2016). A term with
PMI / IC >= ``GENERALISE`` that stands with e in at least ``SUPPORT`` different texts is generalised, from ``REMOVE`` on it is removed, in every
document that has e, wherever in the text it stands. All four figures count every row, copies too; support counts different texts, so a document that is merely copied reveals nothing.

Pairs exist only for entities of ``SUPPORT`` different texts, and entities of the same texts share one set of pairs, so two versions of a long list of addresses cost
one pair a word. The number of rows with a term is counted over all texts, for the terms that the texts with entities don't already show to be too common. Sides are broadcast when counted to be
few, else joined by shuffle.

Defined cases: null text counts as empty; rows repeat as given; an empty table gives an empty result; extra columns pass through ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import save

SUPPORT = 2
GENERALISE, REMOVE = 0.9, 0.99
SECRET, BITS = 20, 64
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
FEW = 200_000
_BLOCK = 256

_LOCAL = "A-Za-z0-9._%+-"
#: A match starts where the run of its first characters does, or right after the match before it.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<![A-Za-z0-9_])[A-Za-z0-9_]{{{SECRET},}}+",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "secret": ""}
_WORD = r"\p{L}{4,}"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
_OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def running(values: Column, join, start: int = 0) -> Column:
    """``join`` (sum, greatest) of each element and all before it, in blocks, so that long arrays don't cost their length squared."""

    def all_of(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(start), lambda a, x: join(a, x))

    def of(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(xs)), lambda i: all_of(F.slice(xs, F.lit(1), i)))

    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    before = lambda t, i: F.when(i > 0, F.element_at(t, F.greatest(i, F.lit(1)))).otherwise(F.lit(start))
    many = F.transform(F.array(F.struct(blocks.alias("b"), of(F.transform(blocks, all_of)).alias("t"))), lambda s: F.flatten(F.transform(s.b, lambda xs, i: F.transform(of(xs), lambda x: join(x, before(s.t, i))))))[0]
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= _BLOCK, of(values)).otherwise(many)


def matches(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>> of the pattern's matches from the left (code points, end exclusive)."""
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    both = F.struct(found.alias("found"), gaps.alias("gaps"))

    def spans(p: Column) -> Column:
        sizes = F.transform(p.found, lambda m, i: F.length(m) + F.length(F.element_at(p.gaps, i + 1)))
        ends = F.transform(F.array(running(sizes, lambda a, x: a + x)), lambda e: e)[0]
        return F.zip_with(p.found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    return F.transform(F.array(both), spans)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _bits(value: Column) -> Column:
    """Length times the entropy of a value's own characters, in bits."""
    n = F.length(value)

    def share(c: Column) -> Column:
        times = n - F.length(F.replace(value, c, F.lit("")))
        return times * F.log2(n / times)

    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", F.lit(0.0)).otherwise(share(c)))


_HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda v: F.when(F.length(_digits(v)).between(12, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "secret": lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (_bits(v) >= BITS),
}


def entity_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, value>> of the protected entities of a text, by start, then kind."""
    none = F.array().cast(_SPANS)
    digit = text.rlike("[0-9]")
    parts = []

    def tested(rank: int, kind: str) -> Column:
        found = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda m: _HOLDS[kind](m.value))
        return F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(rank).alias("rank"), m.end.alias("end"), F.lit(kind).alias("kind"), m.value.alias("value")))

    for rank, kind in enumerate(KINDS[:-1]):
        found = tested(rank, kind)
        gate = F.contains(text, F.lit(_NEEDS[kind])) if kind == "email" else digit & (text.rlike(PATTERNS[kind]) if kind == "secret" else F.contains(text, F.lit(_NEEDS[kind])))
        parts.append(F.when(gate, found).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.lower(w)))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).when(kind == "secret", value).otherwise(F.lower(value)))


def _few(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast when they are counted to be few."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def revealing(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, of) and (of, term, share): the groups of entities of each text, and the terms that disclose at least ``GENERALISE`` of a group's entities.

    ``found`` has a row for each different text with entities (k, copies, entities, terms), ``texts`` all rows (text). ``of`` names the entities that the same texts have.
    """
    n = texts.count()
    held = found.select("k", "copies", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("of_entity"), F.hex(F.bit_xor(F.xxhash64("k"))).alias("x"), F.hex(F.bit_xor(F.xxhash64("k", F.lit(1)))).alias("y"))
    entities = save(entities.where(F.col("texts") >= SUPPORT).select("entity", "of_entity", F.concat("x", "y").alias("of")), "pii_entities")
    members = save(held.join(_few(entities), "entity").groupBy("k", "of").agg(F.max("of_entity").alias("of_entity")), "pii_members")
    # what the texts with entities say of a term is a lower bound of what all rows say
    said = found.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("least"))
    words = members.join(found.select("k", "copies", "terms"), "k").select("of", "of_entity", "copies", F.explode("terms").alias("term"))
    pairs = words.groupBy("of", "term").agg(F.count("*").alias("contexts"), F.sum("copies").alias("both"), F.max("of_entity").alias("of_entity")).where(F.col("contexts") >= SUPPORT)
    pairs = save(pairs.join(said, "term").where(_share(n, F.col("least")) >= GENERALISE).drop("contexts", "least"), "pii_pairs")
    terms = pairs.select("term").distinct()
    with_term = texts.select(F.explode(_terms_of(F.coalesce("text", F.lit("")))).alias("term")).join(_few(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("of_term"))
    share = pairs.join(with_term, "term").select("of", "term", _share(n, F.col("of_term")).alias("share"))
    return members.select("k", "of"), share.where(F.col("share") >= GENERALISE)


def _share(n: int, of_term: Column) -> Column:
    """PMI / IC of a pair (both, of_entity) over ``n`` rows; null where the entity is in every row and holds nothing."""
    pmi = F.log(F.col("both") * F.lit(float(n)) / (of_term * F.col("of_entity")))
    ic = F.log(F.lit(float(n)) / F.col("of_entity"))
    return F.when(ic > 0, pmi / ic)


def sanitise(docs: DataFrame) -> DataFrame:
    """(row, spans, base, sanitised) for every row of ``docs`` (doc_id, text): all spans, those of the four base kinds among them, and the text with all replaced."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"))
    spotted = rows.withColumn("spans", entity_spans(F.col("text")))
    some = save(spotted.where(F.size("spans") > 0).withColumn("k", F.md5("text")), "pii_found")
    named = F.array_distinct(F.transform("spans", lambda s: _entity(s.kind, s.value)))
    # one row for each different text
    texts = some.groupBy("k").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("spans").alias("spans"))
    texts = save(texts.select("k", "copies", "text", "spans", named.alias("entities"), _terms_of(F.col("text")).alias("terms")), "pii_texts")
    members, share = revealing(texts, rows)
    share = save(share, "pii_terms")
    # the places of revealing terms outside the entities, joined word by word, so that no text is read once for each of its terms
    members = members.join(_few(share.select("of").distinct()), "of", "left_semi")
    clear = _replaced(F.col("text"), F.col("spans"), lambda s, left: F.repeat(F.lit("#"), left))
    shown = texts.join(members.select("k").distinct(), "k", "left_semi").select("k", F.explode(matches(clear, F.lit(_WORD))).alias("m"))
    shown = shown.withColumn("term", F.lower("m.value")).join(_few(share.select("term").distinct()), "term", "left_semi")
    marked = shown.join(members, "k").join(_few(share), ["of", "term"]).groupBy("k", "m").agg(F.max("share").alias("share"))
    span = F.struct(F.col("m.start").alias("start"), F.lit(len(KINDS) - 1).alias("rank"), F.col("m.end").alias("end"), F.lit("term").alias("kind"), F.when(F.col("share") >= REMOVE, F.lit("")).otherwise(F.col("m.value")).alias("value"))
    of_text = marked.groupBy("k").agg(F.collect_list(span).cast(_SPANS).alias("said"))
    some = some.join(of_text, "k", "left")
    some = some.withColumn("all", F.array_sort(F.concat("spans", F.coalesce("said", F.array().cast(_SPANS)))))
    base = F.filter("spans", lambda s: s.rank < len(BASE))
    shown = some.select("row", F.col("all").alias("spans"), base.alias("base"), _replaced(F.col("text"), F.col("all"), _label).alias("sanitised"))
    rest = spotted.where(F.size("spans") == 0).select("row", "spans", F.col("spans").alias("base"), F.col("text").alias("sanitised"))
    return shown.unionByName(rest)


def _label(span: Column, left: Column) -> Column:
    """What stands for a span of which ``left`` code points are not in a span before it: its kind, nothing for a removed term."""
    hidden = (left == 0) | ((span.kind == "term") & (span.value == ""))
    return F.when(hidden, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(span.kind), F.lit("]")))


def _replaced(text: Column, spans: Column, label) -> Column:
    """The text with each span replaced by ``label`` (span, its code points that no earlier span has); of overlapping spans the first to start goes whole and the others from where it ends."""
    reach = F.struct(spans.alias("s"), running(F.transform(spans, lambda s: s.end), lambda a, x: F.greatest(a, x)).alias("e"))

    def pieces(p: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            done = F.when(i > 0, F.element_at(p.e, F.greatest(i, F.lit(1)))).otherwise(F.lit(0))
            return F.concat(F.substring(text, done + 1, F.greatest(s.start - done, F.lit(0))), label(s, F.greatest(s.end - F.greatest(done, s.start), F.lit(0))))

        return F.concat(F.array_join(F.transform(p.s, piece), ""), F.substring(text, F.element_at(p.e, -1) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(reach), pieces)[0])


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
