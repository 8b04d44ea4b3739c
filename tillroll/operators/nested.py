"""Items of documents as VARIANT, however deep they nest.

The fixed schema of `structure` ends three levels down. Here a document stays one VARIANT value, from the raw zone on, and
an entry of `Items` that isn't an item is opened in its place: a list of entries (departments, pages, split lists), or an
object that holds `Items` of its own, as values or as JSON text. Opening is an expression over one document, a level a
step until nothing is left to open: no shuffle, no limit of depth.

A document that is null, corrupt or without `Items` has no items, nor has a list without entries, and an object whose `Items` is such a list is no item; what is neither an item nor
a list of them is skipped. An item's id is that of its place among the entries (`2`, or `2/0` for one within), so that flat
documents give the rows that `structure.items_from` gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import schemas as S
from tillroll.operators.structure import typed_item

OBJECT, LIST = "map<string,variant>", "array<variant>"
ENTRIES = f"array<struct<place:string,data:{OBJECT},within:{LIST}>>"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often `then` names it; within lambdas Spark shares no common part."""
    return F.get(F.transform(F.array(value), then), 0)


def variant_documents(raw: DataFrame, column: str = "json") -> DataFrame:
    """raw with `document`, the JSON text as VARIANT in place of the text; null where it is missing or corrupt."""
    return raw.withColumn("document", F.try_parse_json(column)).drop(column)


def _opened(value: Column) -> Column:
    """A value that is JSON text as what the text says; null where it doesn't read. Other values as they are."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_parse_json(F.try_variant_get(value, "$", "string"))).otherwise(value)


def _object(entry: Column) -> Column:
    """An entry's own fields: `value` of a dictionary, else `value_object`; null if it has none."""
    value = F.try_variant_get(entry, "$.value", "variant")
    dictionary = (F.try_variant_get(entry, "$.value_type", "string") == "dictionary") & (F.schema_of_variant(value) != "VOID")
    return F.try_variant_get(F.when(dictionary, _opened(value)).otherwise(F.try_variant_get(entry, "$.value_object", "variant")), "$", OBJECT)


def _list(field: Column) -> Column:
    """A field's entries: `value_array` unless it is empty, else the list in `value`; null if it has neither."""
    other = _once(F.try_variant_get(field, "$.value", "variant"), lambda v: F.try_variant_get(_opened(v), "$", LIST))
    return _once(F.try_variant_get(field, "$.value_array", LIST), lambda held: F.when(F.size(held) > 0, held).otherwise(other))


def _looked(place: Column, entry: Column) -> Column:
    """(place, data, within) of an entry: its own fields, and the entries that stand in its place; `within` is null for items, and for what holds nothing."""
    inner = lambda f: F.coalesce(_list(f), F.try_variant_get(f, "$.value_array", LIST))
    within = lambda own: F.when(own.isNull(), _list(entry)).when(own["Items"].isNotNull(), _once(own["Items"], inner))
    return _once(_object(entry), lambda own: F.struct(place.alias("place"), own.alias("data"), within(own).alias("within")))


def entries(items: Column) -> Column:
    """Of a field `Items` as VARIANT: array of (place, data, within) in order, with nothing left to open. Each entry is looked into once a level."""
    first = F.transform(_list(items), lambda e, i: _looked(i.cast("string"), e)).cast(ENTRIES)
    closed = lambda held: ~F.exists(held, lambda e: e["within"].isNotNull())

    def one(e: Column) -> Column:
        return F.when(e["within"].isNull(), F.array(e)).otherwise(F.transform(e["within"], lambda c, i: _looked(F.concat_ws("/", e["place"], i.cast("string")), c)).cast(ENTRIES))

    def opened(held: Column) -> Column:
        text = F.to_json(items)
        levels = F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))  # no list nests deeper than there are brackets; steps after the last that opened something cost little
        step = lambda acc, _: F.when(closed(acc), acc).otherwise(F.flatten(F.transform(acc, one)).cast(ENTRIES))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), held, step)

    return _once(first, lambda held: F.when(closed(held), held).otherwise(opened(held)))


def deep_item_list(document: str = "document", receipt_id: str = "receipt_id", ts: str = "ingest_ts") -> Column:
    """A document's items as an array of typed structs, from any depth; null where it has no list."""
    found = F.filter(entries(F.try_variant_get(F.col(document), "$.fields.Items", "variant")), lambda e: e["data"].isNotNull())
    texts = F.transform(found, lambda e: F.struct(e["place"].alias("place"), *(F.try_variant_get(e["data"][name], "$.value", "string").alias(name) for name in ("Description", "Quantity", "Price", "TotalPrice"))))
    return F.transform(texts, lambda e: typed_item(lambda name: e[name], e["place"], receipt_id, ts))


def deep_items(docs: DataFrame) -> DataFrame:
    """Typed items of docs (receipt_id, ingest_ts, document), a row for each item of deep_item_list()."""
    items = docs.where("document is not null").select(F.explode_outer(deep_item_list()).alias("item")).where("item is not null")  # before explode() Spark filters by its array, and works that out twice more
    return items.select(*(F.col(f"item.{c}") for c in S.ITEM_COLUMNS))
