"""Document fingerprints as invertible Bloom lookup tables over paragraph digests, in DataFrame functions only.

A text's digests are 32-bit hashes of its distinct paragraphs, each with a check value of 32 bits beside it. Paragraphs end at line feeds. With ``few_lines`` None
the sentences of every text are further paragraphs, so texts are compared at one grain whatever their numbers of lines; with a number, only those of texts of fewer lines are,
and two texts on either side of it have little in common even where they are equal. Each digest goes into one cell of each of four subtables of eight
cells; a cell is the XOR of what it holds. Subtracting (XOR again) the cells of two versions leaves the digests that only one of them has. Peeling takes
those that are alone in a cell (their check value proves it), removes them from their other cells, and so on until the cells are empty.

The fingerprint of a text is such a table of 32 cells for about every ``OWN`` of its digests, dealt by further digest bits, and written as text behind their number. It can always be inverted: each table is peeled as soon as it
is made, and the digests of one that gets stuck follow the cells as a stash. So all digests of a text come back from its fingerprint (``tests`` do that), its tables fold by XOR into one,
and what a comparison says is a function of the two fingerprints alone.

A comparison first subtracts the two fingerprints folded to one table each, which gives back up to about 24 differing digests; when peeling gets stuck it retries with the digests of both in
2^i tables of about ``LOAD`` digests of both texts together, of which those that get stuck are dealt to two, four and eight tables. Stuck even then, the digests that both fingerprints give back are compared as they are.
With d differing digests the likeness of two texts of a and b digests is (a + b - d) / (a + b + d), the Jaccard
similarity of their paragraph sets; 1 for two texts without paragraphs.

Defined cases: null text counts as empty; a paragraph of white space alone doesn't count; repeated paragraphs count once; equal texts have equal
fingerprints; extra columns pass through ``row``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHES, CELLS, LOAD, OWN, ROUNDS, RETRIES = 4, 8, 6, 12, 10, 3
FEW_LINES = 4
#: Characters of which alone no paragraph is made.
_BLANK = " \t\r\f\v"
_LOW = 0xFFFFFFFF
_FEW = 1_000_000


def _checked(low: Column) -> Column:
    """A digest of 32 bits with its check value of 32 bits above it."""
    return low.bitwiseOR(F.shiftleft(F.xxhash64(low), 32))


def digests(text: Column, few_lines: int | None = FEW_LINES) -> Column:
    """array<bigint>: the checked digest of each distinct paragraph."""
    lines = F.filter(F.split(text, "\n", -1), lambda p: F.btrim(p, F.lit(_BLANK)) != "")
    sentences = F.flatten(F.transform(lines, lambda p: F.split(p, r"(?<=[.!?]) ", -1)))
    parts = F.concat(lines, sentences if few_lines is None else F.when(F.size(lines) < few_lines, sentences).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.transform(parts, lambda p: F.transform(F.array(F.xxhash64(p).bitwiseAND(F.lit(_LOW))), _checked)[0]))


#: Bits that tell the cell of a subtable, and the first of the bits that deal a digest to one of several tables.
_BITS, _DEAL = 3, 3 * HASHES


def _held(j: int, c: int) -> tuple[Column, Column]:
    """Mask and value of the bits of a digest that is in cell ``c`` of subtable ``j``."""
    return F.lit((CELLS - 1) << (_BITS * j)).cast("long"), F.lit(c << (_BITS * j)).cast("long")


def _xor(keys: Column, start: Column | None = None) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long") if start is None else start, lambda a, k: a.bitwiseXOR(k))


def _cells(keys: Column, start: Column | None = None) -> Column:
    """The 32 cells of the digests ``keys``, on top of the cells ``start``. Only digests that are in a cell are folded into it; the others cost one comparison of bits."""

    def cell(j: int, c: int) -> Column:
        mask, value = _held(j, c)
        return _xor(F.filter(keys, lambda k: k.bitwiseAND(mask) == value), None if start is None else F.get(start, F.lit(CELLS * j + c)))

    return F.array(*[cell(j, c) for j in range(HASHES) for c in range(CELLS)])


def table(keys: Column) -> Column:
    """The 32 cells of one table: subtable j has a digest in the cell of its bits 3j to 3j + 2."""
    return _cells(keys)


def _stuck(keys: Column) -> Column:
    """Whether the table of ``keys`` gets stuck when it is peeled, told from where its digests are: in each round those go that are alone in a cell. A set of cells is a word of 32 bits, so a round costs a few operations a digest."""
    one = F.lit(1).cast("long")
    places = F.transform(keys, lambda k: _any([F.call_function("shiftleft", one, F.shiftrightunsigned(k, _BITS * j).bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int") + CELLS * j) for j in range(HASHES)]))
    start = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))

    def step(left: Column, _: Column) -> Column:
        seen = F.aggregate(left, start, lambda s, p: F.struct(s.once.bitwiseOR(p).alias("once"), s.twice.bitwiseOR(s.once.bitwiseAND(p)).alias("twice")), lambda s: s.once.bitwiseAND(F.bitwise_not(s.twice)))
        # bound once: what a lambda only refers to would be computed again for each element
        fewer = F.transform(F.array(F.struct(left.alias("left"), seen.alias("alone"))), lambda s: F.filter(s.left, lambda p: p.bitwiseAND(s.alone) == 0))[0]
        return F.when(F.size(left) > 0, fewer).otherwise(left)

    return F.size(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), places, step)) > 0


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), columns)


def _peel(cells: Column) -> Column:
    """Number of digests recovered from subtracted cells, or null when peeling got stuck.

    Each digest is once in each subtable, so the cells of one fold to all that is left; when the digests found in a round fold to the same, nothing is left and they need not be removed.
    """

    def step(state: Column, _: Column) -> Column:
        found = F.array_distinct(F.filter(state.cs, lambda c: (c != 0) & (_checked(c.bitwiseAND(F.lit(_LOW))) == c)))
        left = _xor(F.slice(state.cs, 1, CELLS))

        def removed(f: Column) -> Column:
            d, last = state.d + F.size(f), F.struct(state.cs.alias("cs"), state.d.alias("d"), F.lit(False).alias("open"))
            done = F.struct(F.array_repeat(F.lit(0).cast("long"), HASHES * CELLS).alias("cs"), d.alias("d"), F.lit(False).alias("open"))
            return F.when(F.size(f) == 0, last).when(_xor(f) == left, done).otherwise(F.struct(_cells(f, state.cs).alias("cs"), d.alias("d"), F.lit(True).alias("open")))

        return F.when(state.open, F.transform(F.array(found), removed)[0]).otherwise(state)

    start = F.struct(cells.alias("cs"), F.lit(0).alias("d"), F.lit(True).alias("open"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.transform(F.array(end), lambda e: F.when(F.forall(e.cs, lambda c: c == 0), e.d))[0]


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def _part(keys: Column, mask: Column, at: Column) -> Column:
    return F.filter(keys, lambda k: F.shiftrightunsigned(k, _DEAL).bitwiseAND(mask) == at)


def _tables_for(n: Column, load: int) -> Column:
    """The least power of two of tables that holds ``n`` digests at ``load`` a table."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n / load, F.lit(1.0))))).cast("int")


def dealt(keys: Column, tables: Column) -> Column:
    """The digests of each of ``tables`` (a power of two) tables.

    They are dealt in two steps, first to about sqrt(tables) groups, so that long texts don't cost their length squared.
    """
    groups = F.pow(F.lit(2), F.floor(F.log2(tables) / 2)).cast("long")
    # bound once here: what a lambda only refers to would be computed again for each element
    bound = F.struct(keys.alias("keys"), (tables.cast("long") - 1).alias("tmask"), groups.alias("groups"))

    def of_group(p: Column, g: Column) -> Column:
        return F.transform(F.array(_part(p.keys, p.groups - 1, g)), lambda ks: F.transform(F.sequence(g, p.tmask, p.groups), lambda t: _part(ks, p.tmask, t)))[0]

    return F.transform(F.array(bound), lambda p: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), p.groups - 1), lambda g: of_group(p, g))))[0]


def _difference(both: Column, tables: Column) -> Column:
    """Differing digests of two texts, of which ``both`` holds the digests one after the other, by ``tables`` tables (a power of two), or null when one of them got stuck.

    A digest of both texts cancels itself where it is put in twice, which is what subtracting the cells of two tables does. The digests of a table that gets stuck are dealt to two, four and eight tables by their next bits; the other tables are not made again.
    """
    n = tables.cast("long")
    share = lambda i: F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << i) - 1).cast("long")), lambda v: F.struct((n * ((1 << i) - 1)).alias("mask"), (n * v).alias("value")))
    bound = F.struct(dealt(both, tables).alias("parts"), F.array(*[share(i) for i in range(RETRIES + 1)]).alias("levels"))

    def one(keys: Column, levels: Column) -> Column:
        def by(level: Column) -> Column:
            split = F.transform(level, lambda w: F.filter(keys, lambda k: F.shiftrightunsigned(k, _DEAL).bitwiseAND(w.mask) == w.value))
            return F.aggregate(F.transform(split, lambda ks: _peel(table(ks))), F.lit(0), lambda x, d: x + d)

        return F.when(F.size(keys) == 0, F.lit(0)).otherwise(F.aggregate(levels, F.lit(None).cast("int"), lambda d, level: F.when(d.isNotNull(), d).otherwise(by(level))))

    return F.transform(F.array(bound), lambda p: F.aggregate(F.transform(p.parts, lambda ks: one(ks, p.levels)), F.lit(0), lambda x, d: x + d))[0]


def likeness(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Likeness of two fingerprints, from them folded to one table each (``cells_*``) and, for retries, from the digests ``a`` and ``b`` that they give back."""
    both = F.size(a) + F.size(b)
    most = _tables_for(both, LOAD)
    # 24 differing digests are the most that 32 cells can give back; texts whose sizes differ by more need no first try
    first = F.when(F.abs(F.size(a) - F.size(b)) <= 24, _peel(_less(cells_a, cells_b)))
    retry = _difference(F.concat(a, b), F.least(most, F.lit(1 << 20)))
    plain = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    d = F.coalesce(first, retry, plain)
    # bound once: the difference would be computed again where it is named again
    told = F.transform(F.array(d), lambda d: (both - d).cast("double") / (both + d))[0]
    return F.when(both == 0, F.lit(1.0)).otherwise(told)


def tables_of(keys: Column) -> Column:
    """array<struct<keys, cells>>: the tables of a fingerprint, one for about every ``OWN`` digests, with their digests."""
    return F.transform(dealt(keys, _tables_for(F.size(keys), OWN)), lambda ks: F.struct(ks.alias("keys"), table(ks).alias("cells")))


def folded(tables: Column) -> Column:
    """The cells of all tables of a fingerprint as one table."""
    return F.aggregate(tables, F.array_repeat(F.lit(0).cast("long"), HASHES * CELLS), lambda a, t: _less(a, t.cells))


def as_text(n: Column, tables: Column) -> Column:
    """Number of digests and the cells of all tables, in hexadecimal, with the digests of tables that get stuck after a colon."""
    hexes = lambda xs: F.array_join(F.transform(xs, lambda c: F.hex(c)), "-")
    stash = F.flatten(F.transform(F.filter(tables, lambda t: _stuck(t["keys"])), lambda t: t["keys"]))
    said = F.transform(F.array(stash), lambda s: F.when(F.size(s) > 0, F.concat(F.lit(":"), hexes(s))).otherwise(F.lit("")))[0]
    return F.lower(F.concat(F.hex(n), F.lit("-"), hexes(F.flatten(F.transform(tables, lambda t: t.cells))), said))


def with_next(docs: DataFrame, per_group: int = 512) -> DataFrame:
    """(row, text, next): every row of ``docs`` (doc_id, text), its text apart from its other columns and empty for null, with the text after it in descending order of doc_id, the first after the last.

    Ids are cut into ranges for about ``per_group`` rows (``_ranges``); text is shuffled once, by range, and looks ahead inside it. Only the last row of each range
    takes its next from the first row of the nearest range below. Ties are taken in order of text; null ids come last.
    """
    rid = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), rid.alias("rid"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = _ranges(rows, per_group)
    w = Window.partitionBy("range").orderBy(F.desc("rid"), "text")
    inside = rows.withColumn("ahead", F.lead("text").over(w))
    # one row a range: its first text, for the last row of the range above; the ranges are broadcast only when counted to be few
    tops = rows.groupBy("range").agg(F.max("rid").alias("rid"))
    few = tops.limit(_FEW + 1).count() <= _FEW
    heads = rows.join(F.broadcast(tops) if few else tops, ["range", "rid"], "left_semi").groupBy("range").agg(F.min("text").alias("head"))
    below = _next_lower(tops.select("range"))
    heads = below.join(heads.withColumnRenamed("range", "lower"), "lower").select("range", "head")
    return inside.join(heads, "range").select("row", "text", F.coalesce("ahead", "head").alias("next"))


def _ranges(rows: DataFrame, per_group: int, levels: int = 8) -> DataFrame:
    """``rows`` with ``range``, the least id that the row's range may have. Ranges are of equal width at first; one that holds many more rows than meant is cut again between its own ends, so a few far-off ids don't leave the others in one range."""
    size = rows.where("rid > -9223372036854775808").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("n")).first()
    low = (size["lo"] or 0) - 1  # of null ids
    at = F.greatest("rid", F.lit(low))
    width = max(1, ((size["hi"] or 0) - low + 1) * per_group // max(1, size["n"]))
    rows = rows.withColumn("range", at - F.pmod(at - low, F.lit(width)))
    for _ in range(levels):
        held = rows.groupBy("range").agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
        wide = held.where((F.col("n") > 8 * per_group) & (F.col("hi") > F.col("lo"))).select("range", "lo", F.greatest(F.lit(1).cast("long"), ((F.col("hi") - F.col("lo") + 1) / F.col("n") * per_group).cast("long")).alias("width"))
        many = wide.limit(_FEW + 1).count()
        if not many:
            break
        cut = rows.join(F.broadcast(wide) if many <= _FEW else wide, "range", "left")
        rows = cut.withColumn("range", F.when(F.col("width").isNull(), F.col("range")).otherwise(at - F.pmod(at - F.col("lo"), F.col("width")))).drop("lo", "width")
    return rows


def _next_lower(keys: DataFrame, few: int = 10_000) -> DataFrame:
    """(range, lower): for each distinct key the next lower one, for the least the greatest. Keys meet in groups of neighbours, level by level."""
    ends = keys.agg(F.min("range").alias("lo"), F.max("range").alias("hi"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return keys.select("range", F.col("range").alias("lower"))
    if ends["n"] <= few:
        found = keys.select("range", F.lead("range").over(Window.orderBy(F.desc("range"))).alias("lower"))
    else:
        wide = keys.withColumn("wide", F.floor(F.col("range") / F.lit(max(2, (ends["hi"] - ends["lo"] + 1) * 1000 // ends["n"]))).cast("long"))
        inside = wide.select("range", "wide", F.lead("range").over(Window.partitionBy("wide").orderBy(F.desc("range"))).alias("inside"))
        tops = wide.groupBy("wide").agg(F.max("range").alias("top"))
        after = _next_lower(tops.select(F.col("wide").alias("range")), few).join(tops.withColumnRenamed("wide", "lower"), "lower").select(F.col("range").alias("wide"), "top")
        found = inside.join(after, "wide").select("range", F.coalesce("inside", "top").alias("lower"))
    return found.select("range", F.coalesce("lower", F.lit(ends["hi"])).alias("lower"))


def edited(text: Column, after: Column) -> Column:
    """``text`` with its last half of code points replaced by the first as many of ``after``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(after, half))


def fingerprints(docs: DataFrame, few_lines: int | None = FEW_LINES) -> DataFrame:
    """(row, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``; texts of fewer lines than ``few_lines`` count their sentences too, with None all texts do."""
    rows = with_next(docs).withColumn("edited_text", edited(F.col("text"), F.col("next")))
    keyed = rows.select("row", F.length("text").cast("long").alias("n_chars"), "edited_text", *[digests(F.col(c), few_lines).alias(k) for c, k in (("text", "own"), ("edited_text", "changed"), ("next", "other"))])
    made = keyed.select("*", *[tables_of(F.col(c)).alias(f"{c}_tables") for c in ("own", "changed")], table(F.col("other")).alias("other_cells"))
    tabled = made.select("*", *[folded(F.col(f"{c}_tables")).alias(f"{c}_cells") for c in ("own", "changed")])
    near = lambda c: likeness(F.col("own"), F.col(c), F.col("own_cells"), F.col(f"{c}_cells"))
    told = lambda c: as_text(F.size(c), F.col(f"{c}_tables"))
    return tabled.select("row", "n_chars", "edited_text", told("own").alias("fingerprint"), told("changed").alias("edited_fingerprint"), near("changed").alias("near_edited"), near("other").alias("near_next"))
