"""Queries and changes over the receipts and items tables, as frames; tillroll.operators.versions stores them."""

from __future__ import annotations

import contextlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll import schemas as S
from tillroll.operators.versions import latest

ITEM_VIEW = [c for c in S.ITEM_COLUMNS if c != "receipt_id"]


def nested_items(items: DataFrame) -> DataFrame:
    """(receipt_id, items): a receipt's items in one array, by item_id."""
    return items.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in ITEM_VIEW if c in items.columns]))).alias("items"))


def with_items(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Receipts with their items; an empty array where there are none. Filters on receipts should come before."""
    wanted = items.join(receipts.select("receipt_id"), "receipt_id", "left_semi")
    out = receipts.join(nested_items(wanted), "receipt_id", "left")
    empty = F.array().cast(out.schema["items"].dataType)
    return out.withColumn("items", F.coalesce("items", empty))


def get_receipt(receipts: DataFrame, items: DataFrame, receipt_id) -> DataFrame:
    return with_items(receipts.where(F.col("receipt_id") == receipt_id).limit(1), items)


def user_receipts(receipts: DataFrame, items: DataFrame, user_id: str) -> DataFrame:
    """A user's receipts with items, newest first."""
    return with_items(receipts.where(F.col("user_id") == user_id), items).orderBy(F.desc("created_at"), "receipt_id")


def recent_of(receipts: DataFrame, user_id: str, k: int = 20) -> DataFrame:
    return receipts.where(F.col("user_id") == user_id).orderBy(F.desc("purchase_date"), "receipt_id").limit(k)


def recent_by_user(receipts: DataFrame, k: int = 20) -> DataFrame:
    """The k latest receipts of every user; the rank filter is pushed before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("purchase_date"), "receipt_id"))
    return receipts.withColumn("rank", rank).where(F.col("rank") <= k)


def store_search(receipts: DataFrame, part: str) -> DataFrame:
    return receipts.where(F.col("store_name").contains(part))


def date_range(receipts: DataFrame, start, end) -> DataFrame:
    return receipts.where(F.col("purchase_date").between(start, end))


def document_contains(raw: DataFrame, key: str, value: str, column: str = "json") -> DataFrame:
    """Raw documents whose top-level key has the value; broken JSON never matches."""
    return raw.where(F.try_variant_get(F.try_parse_json(column), f"$.{key}", "string") == value)


def by_status(receipts: DataFrame, status: int) -> DataFrame:
    return receipts.where(F.col("status") == status)


def items_named(items: DataFrame, name: str) -> DataFrame:
    return items.where(F.col("name") == name)


def upsert(base: DataFrame, changed: DataFrame, now: Column, key: str = "receipt_id", order: str = "updated_at") -> DataFrame:
    """base with the changed rows in place of, or beside, the old ones; replaced and new rows get updated_at. Of several changes of a key the last by `order` counts."""
    last = latest(changed, key, order)
    return base.join(last.select(key), key, "left_anti").unionByName(last.withColumn("updated_at", now.cast(base.schema["updated_at"].dataType)).select(*base.columns))


def delete(receipts: DataFrame, items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Receipts and items without those of ids (receipt_id), and the ids that were found."""
    ids = ids.select("receipt_id").distinct()
    return receipts.join(ids, "receipt_id", "left_anti"), items.join(ids, "receipt_id", "left_anti"), ids.join(receipts.select("receipt_id"), "receipt_id", "left_semi")


def unexpired(rows: DataFrame, ts: str, today: Column, days: int) -> DataFrame:
    """Rows no older than `days`; a plain comparison on ts, so partitions and row groups are pruned."""
    return rows.where(F.col(ts) >= F.date_sub(today, days).cast("timestamp"))


def receipt_view(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """What is shown of receipts: all but the object key, with items that don't repeat their receipt_id."""
    return with_items(receipts.select(*[c for c in receipts.columns if c != "s3_key"]), items)


@contextlib.contextmanager
def hot(receipts: DataFrame, items: DataFrame, since: Column):
    """Receipts created since then, with their items, held in memory (on disk where it is short) while several queries read them."""
    held = with_items(receipts.where(F.col("created_at") >= since), items).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()
