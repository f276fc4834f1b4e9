"""Keyed table maintenance: every function takes the stored and the new rows and returns the table to write next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in ``order``, which must end in something unique."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", newest).where("_nth = 1").drop("_nth")


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """New rows replace old ones of the same key. Of several new rows of a key the first in ``order`` is kept; without an order they must be of different keys."""
    new = latest(new, keys, *order) if order else new
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_by_parent(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced, with all of theirs."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The rows whose parent is still there, as after ``replace_by_parent``."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def insert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases (entity_id, normalized_alias, alias): unknown ones are added, the first of each; blank ones never."""
    some = new.where("trim(coalesce(normalized_alias, '')) != ''")
    return insert_ignore(old, some, ["entity_id", "normalized_alias"], F.col("alias"))


def upsert_vectors(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """Keyed vectors (key, vec, dim): new ones replace old ones, empty ones are dropped."""
    some = new.where(F.size("vec") > 0).withColumn("dim", F.size("vec"))
    return merge_latest(old, some.select(*old.columns), [key], *order)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Relations (src, dst, rel, weight, evidence): new ones replace old ones; evidence is kept sorted, each once."""
    tidy = new.withColumn("evidence", F.array_sort(F.array_distinct("evidence")))
    return merge_latest(old, tidy, ["src", "dst", "rel"], F.desc("weight"), F.desc("evidence"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows of unknown keys are added, the first of each."""
    return old.unionByName(latest(new.join(old.select(*keys), keys, "left_anti"), keys, *order))


def merge_spans(old: DataFrame, new: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Keyed merge that keeps the least ``low`` and the greatest ``high`` and takes other columns from the new rows."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, keys, "full")
    pick = {low: F.least(f"a.{low}", f"b.{low}"), high: F.greatest(f"a.{high}", f"b.{high}")}
    return both.select(*keys, *[pick.get(c, F.coalesce(f"b.{c}", f"a.{c}")).alias(c) for c in old.columns if c not in keys])


def remap_keys(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """``key`` is replaced where ``mapping`` (old, new) knows it."""
    return rows.join(mapping.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")


def apply_updates(rows: DataFrame, edits: DataFrame, key: str, column: str, allowed: Column) -> DataFrame:
    """The last edit (key, value, at) of each row sets ``column`` where ``allowed`` holds for the row as it was."""
    last = edits.groupBy(key).agg(F.max_by("value", F.struct("at", "value")).alias("_value"))
    return rows.join(last, key, "left").withColumn(column, F.when(allowed & F.col("_value").isNotNull(), F.col("_value")).otherwise(F.col(column))).drop("_value")


def conform(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that are missing, with their defaults; drops none."""
    return rows.select("*", *[v.alias(c) for c, v in defaults.items() if c not in rows.columns])


def _conformed(value: Column, have: DataType, want: DataType, path: str, defaults: dict[str, Column]) -> Column:
    """``value`` of the type ``have`` as ``want``, with what only ``have`` holds kept behind."""
    if isinstance(have, StructType) and isinstance(want, StructType):
        known = {f.name: f.dataType for f in have.fields}
        at = lambda name: f"{path}.{name}" if path else name
        fields = [(_conformed(value[f.name], known[f.name], f.dataType, at(f.name), defaults) if f.name in known else defaults.get(at(f.name), F.lit(None)).cast(f.dataType)).alias(f.name) for f in want.fields]
        more = [value[n].alias(n) for n in known if n not in want.fieldNames()]
        return F.when(value.isNotNull(), F.struct(*fields, *more))
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return F.transform(value, lambda x: _conformed(x, have.elementType, want.elementType, path, defaults))
    if isinstance(have, MapType) and isinstance(want, MapType):
        return F.transform_values(value, lambda k, x: _conformed(x, have.valueType, want.valueType, path, defaults))
    return value if have == want else value.try_cast(want)


def conform_to(rows: DataFrame, schema: StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` of an older version with the columns of ``schema`` in its order, then all others: missing columns, and missing fields of structs at any depth, in arrays and maps too, get their default by path (``a.b.c``), else null; changed types are cast, to null where a value can't be. Nothing is dropped."""
    defaults = defaults or {}
    have = {f.name: f.dataType for f in rows.schema.fields}
    new = [(_conformed(F.col(f"`{f.name}`"), have[f.name], f.dataType, f.name, defaults) if f.name in have else defaults.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return rows.select(*new, *[F.col(f"`{c}`") for c in rows.columns if c not in schema.fieldNames()])


def encode_structs(rows: DataFrame) -> DataFrame:
    """``rows`` with structs, arrays and maps as JSON text, as a table of plain columns stores them; null stays null."""
    nested = (StructType, ArrayType, MapType)
    return rows.select(*[(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)) for f in rows.schema.fields])


def decode_structs(rows: DataFrame, schema: StructType) -> DataFrame:
    """The inverse of ``encode_structs`` by the columns' types in ``schema``: text that can't be read gives an empty list, and null for structs and maps."""
    kinds = {f.name: f.dataType for f in schema.fields}

    def read(name: str) -> Column:
        kind = kinds.get(name)
        if not isinstance(kind, StructType | ArrayType | MapType):
            return F.col(name)
        value = F.from_json(name, kind)
        if isinstance(kind, ArrayType):
            value = F.when(F.col(name).isNotNull(), F.coalesce(value, F.array().cast(kind)))
        elif isinstance(kind, StructType):
            # of broken text the parser makes a struct of nulls
            value = F.when(F.try_parse_json(name).isNotNull(), value)
        return value.alias(name)

    return rows.select(*[read(c) for c in rows.columns])
