"""Resolving mentions to entities: exact key, alias, vector, else a new entity.

Mentions are resolved in the order of ``place``, and each sees what the ones before it have left: entities that they created, and names that they claimed for an entity, of which the first claim counts. Mentions of one
(kind, key, name) leave nothing new after their first, so only first mentions are ordered: ``resolve`` decides in rounds every first mention whose outcome no undecided earlier one can change, and then reads off the outcome of
all mentions. What an undecided mention may still leave is known from its key and its name alone: it may create the entity of its key, and claim its name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import nearness
from tidemark.sources.tables import dealt, keep, small

#: Cosines from which names are one entity, the lower where one name contains the other; kinds that vectors never join, kinds that are embedded, and kinds whose names lose a plural.
BAR, CONTAINED_BAR = 0.86, 0.65
NO_VECTOR = ("case", "document", "person")
EMBEDDED = ("project", "deliverable", "topic", "org")
SINGULAR = ("org", "project", "deliverable", "document", "topic")


def near(items: DataFrame, entities: DataFrame, bar: float = BAR, contained: float = CONTAINED_BAR) -> DataFrame:
    """(id, entity_id, score): pairs of the same kind and dimension whose cosine reaches the bar, or the lower one where one key contains the other; never of kinds that vectors don't join.

    ``items``: (id, kind, key, vec); ``entities``: (entity_id, kind, key, vec). Compared are only pairs that the triangle inequality leaves open (see ``nearness``).
    """
    some = lambda df: df.where(~F.col("kind").isin(*NO_VECTOR))
    return nearness.near(some(items), some(entities), bar, contained)


def best(pairs: DataFrame) -> DataFrame:
    """The best entity of each id, the smaller of equal ones."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "entity_id"))
    return pairs.withColumn("nth", nth).where("nth = 1").drop("nth")


def said_name(kind: Column, span: Column) -> Column:
    """The name that a mention's words claim."""
    return F.when(kind.isin(*SINGULAR), T.normalize_name(span, singular=True)).otherwise(T.normalize_name(span))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _first(claims: DataFrame) -> DataFrame:
    """(kind, name, entity_id, nk, place): the first claim of each name."""
    one = claims.groupBy("kind", "name").agg(F.min_by(F.struct("entity_id", "nk", "place"), F.struct("place", "entity_id")).alias("c"))
    return one.select("kind", "name", "c.*")


def _decide(open_: DataFrame, keys: DataFrame, claims: DataFrame, static: DataFrame, mutual: DataFrame) -> DataFrame:
    """``open_`` (kind, key, said, nid, place) with entity_id, nk (the entity's key) and rung where they are certain.

    An undecided mention for which something earlier is known, be it a name near its own, will not create an entity, so no later one waits for that; else of many names near each other only one would be decided in a round.
    """
    first = _first(claims)
    claim = lambda name, p: dealt(first.select("kind", F.col("name").alias(name), F.col("entity_id").alias(f"{p}_id"), F.col("nk").alias(f"{p}_nk"), F.col("place").alias(f"{p}_at")))
    waits = lambda df, column, name, alias: dealt(df.select("kind", F.col(column).alias(name), F.col("at").alias(alias)))
    c, place = F.col, F.col("place")
    earlier = lambda x: F.coalesce(c(x) < place, F.lit(False))
    known = keys.select("kind", "key", F.col("entity_id").alias("x_id"), F.col("place").alias("x_at"))
    # the vector rung: names created before, and stored entities
    others = open_.select("kind", "key", "place").join(dealt(mutual), ["kind", "key"])
    created = keys.where("place >= 0").select("kind", F.col("key").alias("other"), "entity_id", F.col("place").alias("made"))
    found = F.struct((-c("score")).alias("far"), c("made"), c("entity_id"), c("other").alias("nk"))
    made = others.join(dealt(created), ["kind", "other"]).where("made < place").groupBy("place").agg(F.min(found).alias("made"))
    stored = static.select("kind", "key", F.struct((-c("score")).alias("far"), F.lit(-1).cast("long").alias("made"), c("entity_id"), c("nk")).alias("stored"))
    rows = open_.join(dealt(known), ["kind", "key"], "left").join(claim("key", "k"), ["kind", "key"], "left").join(dealt(stored), ["kind", "key"], "left")
    rows = rows.join(claim("said", "s"), ["kind", "said"], "left").join(dealt(made), "place", "left").withColumn("found", F.least("made", "stored"))
    rows = keep(rows.drop("made", "stored").withColumn("may_create", ~(earlier("x_at") | earlier("k_at") | earlier("s_at") | c("found").isNotNull())), "seen")
    by_key = rows.where("may_create").groupBy("kind", "key").agg(F.min("place").alias("at"))
    by_name = rows.where("said != ''").groupBy("kind", F.col("said").alias("name")).agg(F.min("place").alias("at"))
    wait = rows.select("kind", "key", "place").join(dealt(mutual), ["kind", "key"]).join(waits(by_key, "key", "other", "w_other"), ["kind", "other"])
    wait = wait.where("w_other < place").select("place", F.lit(True).alias("wait")).distinct()
    joined = rows.join(waits(by_key, "key", "key", "w_key"), ["kind", "key"], "left").join(waits(by_name, "name", "key", "w_k"), ["kind", "key"], "left")
    joined = joined.join(waits(by_name, "name", "said", "w_s"), ["kind", "said"], "left").join(dealt(wait), "place", "left")
    # a claim is the first one unless an undecided mention before it may claim the same name
    sure = lambda p, w: earlier(f"{p}_at") & (c(w).isNull() | (c(f"{p}_at") < c(w)))
    step = F.when(earlier("x_at"), "exact").when(earlier("w_key"), "wait").when(sure("k", "w_k"), "alias").when(earlier("w_k"), "wait").when(sure("s", "w_s"), "said").when(earlier("w_s"), "wait").otherwise("vector")
    joined = joined.withColumn("step", step)
    new = F.concat(F.lit("ent_"), F.substring(F.sha1(F.concat_ws(":", "kind", "key")), 1, 16))
    rung = F.when(c("step").isin("exact", "alias"), c("step")).when(c("step") == "said", "alias").when((c("step") == "vector") & ~F.coalesce("wait", F.lit(False)), F.when(c("found").isNotNull(), "vector").otherwise("new"))
    entity = F.when(c("step") == "exact", c("x_id")).when(c("step") == "alias", c("k_id")).when(c("step") == "said", c("s_id")).when(rung == "vector", c("found").entity_id).when(rung == "new", new)
    nk = F.when(c("step") == "exact", c("key")).when(c("step") == "alias", c("k_nk")).when(c("step") == "said", c("s_nk")).when(rung == "vector", c("found").nk).when(rung == "new", c("key"))
    return joined.select("kind", "key", "said", "nid", "place", entity.alias("entity_id"), nk.alias("nk"), rung.alias("rung"))


def resolve_all(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, vectors: DataFrame, bar: float = BAR, contained: float = CONTAINED_BAR) -> tuple[DataFrame, DataFrame]:
    """``mentions`` (kind, key, span, place, and more) with entity_id and rung, and the names claimed anew: (kind, name, entity_id, place).

    ``entities``: (entity_id, kind, key, vec); ``aliases``: (kind, key, entity_id) with a ``place`` where the order of the claims is known, else the smaller entity_id is taken for the first; ``vectors``: (kind, key, vec) of mentioned keys.
    Places are unique and not negative. Mentions without a key are left out. Mentions of one (kind, key, name) that the vector rung joined stay with what their first mention found.
    """
    name = said_name(F.col("kind"), F.col("span"))
    rows = keep(mentions.where("coalesce(key, '') != ''").withColumn("said", F.coalesce(name, F.lit(""))), "mentions")
    types = rows.groupBy("kind", "key", "said").agg(F.min_by("span", "place").alias("span"), F.min("place").cast("long").alias("place"))
    open_ = types.select("kind", "key", "said", T.normalize_id(F.col("span")).alias("nid"), "place")
    stored = lambda df: df.withColumn("place", F.lit(-1).cast("long"))
    known = keep(entities.groupBy("kind", "key").agg(F.min("entity_id").alias("entity_id")), "known_keys")
    order = ["place", "entity_id"] if "place" in aliases.columns else ["entity_id"]
    named = aliases.groupBy("kind", F.col("key").alias("name")).agg(F.min_by("entity_id", F.struct(*order)).alias("entity_id"))
    named = keep(stored(named.join(dealt(entities.select("entity_id", F.col("key").alias("nk"))), "entity_id", "left").select("kind", "name", "entity_id", "nk")), "claims")
    # vectors are compared for names that no stored key or alias decides
    loose = open_.select("kind", "key").distinct().join(dealt(known), ["kind", "key"], "left_anti").join(dealt(named.select("kind", F.col("name").alias("key"))), ["kind", "key"], "left_anti")
    loose = keep(loose.join(dealt(vectors), ["kind", "key"]).select(F.concat_ws(":", "kind", "key").alias("id"), "kind", "key", "vec"), "loose_keys")
    static = best(near(loose, entities, bar, contained)).join(dealt(loose.select("id", "kind", "key")), "id").join(dealt(entities.select("entity_id", F.col("key").alias("nk"))), "entity_id")
    static = keep(static.select("kind", "key", "entity_id", "nk", "score"), "near_stored_entities")
    pairs = near(loose, loose.select(F.col("id").alias("entity_id"), "kind", "key", "vec"), bar, contained).where("id != entity_id")
    mutual = pairs.join(dealt(loose.select("id", "kind", "key")), "id").join(dealt(loose.select(F.col("id").alias("entity_id"), F.col("key").alias("other"))), "entity_id")
    mutual = keep(mutual.select("kind", "key", "other", "score"), "near_keys")
    decided: list[DataFrame] = []
    keys, claims = [stored(known)], [named]
    open_ = keep(open_, "open")
    while not open_.isEmpty():
        judged = keep(_decide(open_, _union(keys), _union(claims), static, mutual), "round")
        sure = judged.where("rung is not null")
        decided.append(sure)
        keys.append(sure.where("rung = 'new'").select("kind", "key", "entity_id", "place"))
        claims.append(sure.where("said != '' and said != nk and nid != nk").select("kind", F.col("said").alias("name"), "entity_id", "nk", "place"))
        open_ = judged.where("rung is null").select("kind", "key", "said", "nid", "place")
    first = keep(_first(_union(claims)), "claims")
    fresh = first.where("place >= 0").select("kind", "name", "entity_id", "place")
    if not decided:
        return rows.drop("said").withColumns({"entity_id": F.lit(None).cast("string"), "rung": F.lit(None).cast("string")}), fresh
    own = _union(decided).select("kind", "key", "said", F.col("entity_id").alias("d_id"), F.col("rung").alias("d_rung"), F.col("place").alias("d_at"))
    exact = _union(keys).groupBy("kind", "key").agg(F.min_by("entity_id", "place").alias("x_id"), F.min("place").alias("x_at"))
    by = lambda column, p: first.select("kind", F.col("name").alias(column), F.col("entity_id").alias(f"{p}_id"), F.col("place").alias(f"{p}_at"))
    # all that decides a mention but its place is known from its kind, key and name, so mentions are joined once
    own = own.join(dealt(exact), ["kind", "key"], "left").join(dealt(by("key", "k")), ["kind", "key"], "left").join(dealt(by("said", "s")), ["kind", "said"], "left")
    joined = rows.join(small(keep(own, "outcomes"), 500_000), ["kind", "key", "said"])
    before = lambda x: F.coalesce(F.col(f"{x}_at") < F.col("place"), F.lit(False))
    itself = F.col("d_at") == F.col("place")
    entity = F.when(itself, F.col("d_id")).when(before("x"), F.col("x_id")).when(before("k"), F.col("k_id")).when(before("s"), F.col("s_id")).otherwise(F.col("d_id"))
    rung = F.when(itself, F.col("d_rung")).when(before("x"), "exact").when(before("k") | before("s"), "alias").otherwise(F.col("d_rung"))
    return joined.select(*mentions.columns, entity.alias("entity_id"), rung.alias("rung")), fresh


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, vectors: DataFrame, bar: float = BAR, contained: float = CONTAINED_BAR) -> DataFrame:
    """The mentions of ``resolve_all`` alone."""
    return resolve_all(mentions, entities, aliases, vectors, bar, contained)[0]


def rung_counts(resolved: DataFrame) -> DataFrame:
    """(rung, n): how many mentions each rung answered."""
    return resolved.groupBy("rung").agg(F.count("*").alias("n"))


def fold(resolved: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(entity_id, kind, name, first_seen, last_seen, mentions): each entity's name, span of time and number of mentions, from resolved mentions (kind, key, span, place, seen, entity_id).

    The name is the stored one, else the words of the first mention, else its key. Counts and times of ``stored`` (the same columns) go on; its entities without a mention are left out.
    """
    said = F.coalesce(F.nullif(F.trim("span"), F.lit("")), F.col("key"))
    new = resolved.groupBy("entity_id").agg(F.min_by("kind", "place").alias("kind"), F.min_by(said, "place").alias("name"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count("*").alias("mentions"))
    if stored is None:
        return new
    old = stored.select("entity_id", *[F.col(c).alias(f"old_{c}") for c in ("name", "first_seen", "last_seen", "mentions")])
    both = new.join(old, "entity_id", "left")
    return both.select(
        "entity_id", "kind", F.coalesce("old_name", "name").alias("name"), F.least("old_first_seen", "first_seen").alias("first_seen"), F.greatest("old_last_seen", "last_seen").alias("last_seen"),
        (F.coalesce("old_mentions", F.lit(0)) + F.col("mentions")).alias("mentions"),
    )


def new_aliases(resolved: DataFrame, folded: DataFrame) -> DataFrame:
    """(entity_id, alias): the other words by which an entity is mentioned, each once."""
    both = resolved.select("entity_id", F.trim("span").alias("alias")).where("alias != ''").distinct()
    return both.join(folded.select("entity_id", "name"), "entity_id").where("alias != name").drop("name")


def texts_to_embed(mentions: DataFrame) -> DataFrame:
    """(kind, key, text): one text for each distinct name of the kinds that vectors may join."""
    some = mentions.where(F.col("kind").isin(*EMBEDDED))
    return some.groupBy("kind", "key").agg(F.min_by("span", "place").alias("text"))


def consolidate(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """All of the graph from mentions (email_id, kind, key, span, place, seen, confidence) in one call, as saved tables: resolved mentions, entities, aliases and claimed names, salience and relations. Running it again on its own entities and claims changes nothing."""
    from tidemark.operators import graph, merge

    found, claimed = resolve_all(mentions, entities, aliases, vectors)
    resolved = keep(found, "resolved")
    folded = keep(fold(resolved), "entities")
    linked = keep(resolved.select("email_id", "entity_id", "kind", "confidence"), "linked")
    known = entities.select("entity_id", "kind", "key")
    added = merge.latest(resolved.where("rung = 'new'").select("entity_id", "kind", "key"), ["entity_id"], F.col("key"))
    return {
        "resolved": resolved,
        "entities": folded,
        "index": known.unionByName(added.join(known, "entity_id", "left_anti")),
        "aliases": new_aliases(resolved, folded),
        "claims": aliases.select("kind", "key", "entity_id").unionByName(claimed.select("kind", F.col("name").alias("key"), "entity_id")),
        "salience": graph.salience(linked),
        "relations": graph.relations(linked),
    }
