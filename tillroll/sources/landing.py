"""Where files and documents come from and go to."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.checks import MAX_BYTES, MIN_BYTES
from tillroll.operators.store import with_items
from tillroll.session import spread

#: Day folders only: a few users may own most rows, so the user is an order within a day, not a folder.
DAY = ["yyyy", "mm", "dd"]


def landing_scan(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Files below a path as (path, file_name, length, content, content_type); the manifest (file_name, content_type) says what senders claimed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("file_name", F.regexp_extract("path", "([^/]+)$", 1)).select("path", "file_name", "length", "content")
    return files.join(manifest, "file_name", "left") if manifest is not None else files.withColumn("content_type", F.lit(None).cast("string"))


def _head(path: str, size: int) -> bytes | None:
    """The first bytes of a file, by one ranged read; null if it can't be read."""
    from pyarrow import fs

    try:
        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_file(at) as file:
            return file.read_at(min(size, file.size()), 0)
    except (OSError, ValueError):
        return None


def header_scan(spark: SparkSession, path: str, manifest: DataFrame | None = None, size: int = 8, least: int = MIN_BYTES, most: int = MAX_BYTES) -> DataFrame:
    """landing_scan() whose content is the first `size` bytes, enough to screen files by.

    Paths and lengths come from the listing, which opens no file; of files between `least` and `most` bytes the executors then
    fetch the first bytes, one short read each. What is too small or too large is refused by its length and never opened: its content is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")  # content isn't asked for, so it isn't read
    wanted = files.where(F.col("length").between(least, most))

    def task(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([_head(p, size) for p in batch.column(0).to_pylist()], pa.binary())], names=["path", "length", "content"])

    rows = spread(wanted).mapInArrow(task, "path string, length long, content binary")
    rows = rows.unionByName(files.where(~F.col("length").between(least, most)).withColumn("content", F.lit(None).cast("binary")))
    rows = rows.withColumn("file_name", F.regexp_extract("path", "([^/]+)$", 1)).select("path", "file_name", "length", "content")
    return rows.join(manifest, "file_name", "left") if manifest is not None else rows.withColumn("content_type", F.lit(None).cast("string"))


def object_key(user: Column, ts: Column, receipt: Column, file: Column) -> Column:
    """users/{user}/receipts/{yyyy}/{MM}/{dd}/{receipt}/{file}"""
    return F.concat_ws("/", F.lit("users"), user, F.lit("receipts"), F.date_format(ts, "yyyy/MM/dd"), receipt, file)


def key_parts(key: Column) -> Column:
    """struct(user_id, day, receipt_id, file_name) of an object key."""
    pattern = r"users/([^/]+)/receipts/(\d{4}/\d{2}/\d{2})/([^/]+)/([^/]+)$"
    part = lambda i: F.when(key.rlike(pattern), F.regexp_extract(key, pattern, i))
    return F.struct(part(1).alias("user_id"), F.to_date(part(2), "yyyy/MM/dd").alias("day"), part(3).alias("receipt_id"), part(4).alias("file_name"))


def with_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"yyyy": F.date_format(ts, "yyyy"), "mm": F.date_format(ts, "MM"), "dd": F.date_format(ts, "dd")})


def write_by_day(df: DataFrame, path: str, ts: str, kind: str = "json", mode: str = "append", **options: str) -> None:
    """Writes rows under day folders, by user within a file. Adaptive execution cuts a large day into several files and leaves small ones whole, from the sizes of what was shuffled: rows aren't made a second time to sample them. options: the writer's."""
    with_day(df, ts).hint("rebalance", *map(F.col, DAY)).sortWithinPartitions(*DAY, "user_id").write.mode(mode).partitionBy(*DAY).format(kind).options(**options).save(path)


def write_extracted(receipts: DataFrame, items: DataFrame, path: str, ts: str = "created_at") -> None:
    """Receipts as compressed JSON under day folders, each with its items nested; keys are most of what they write."""
    write_by_day(with_items(receipts, items), path, ts, compression="gzip")


def read_by_day(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(f"{schema}, yyyy string, mm string, dd string").option("basePath", path).format(kind).load(path)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def api_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One `json` column: the row in camel case, nulls left out."""
    return df.select(F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in (columns or df.columns)))).alias("json"))
