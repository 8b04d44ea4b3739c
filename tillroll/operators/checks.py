"""Screening of files, validity of documents, and the tables' contract."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import schemas as S

# Bounds, types, signatures and messages of the screening.
MAX_BYTES, MIN_BYTES = 10 * 1024 * 1024, 1024
PDF_TYPES = ["application/pdf"]
IMAGE_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/tiff", "image/tif"]
PDF_SIGNATURE = "25504446"
SIGNATURES = [("FFD8FF", "JPEG Image"), ("89504E470D0A1A0A", "PNG Image"), ("49492A00", "TIFF Image"), ("4D4D002A", "TIFF Image")]
EMPTY = "No file uploaded or file is empty"
PDF = "PDF files are not supported. Please upload an image file (JPEG, PNG, or TIFF)"
SHORT_HEADER = "Unable to read file header for validation"
NO_SIGNATURE = "File signature does not match any supported image format (JPEG, PNG, TIFF). The file may be corrupted or have the wrong extension."
MIN_CONFIDENCE = 0.7


def screen_files(files: DataFrame) -> DataFrame:
    """files (content_type, length, content, ...) with is_valid, error_message, detected_file_type and file_size; the first failed check decides."""
    size, kind = F.coalesce(F.col("length"), F.lit(0)), F.lower("content_type")
    head = F.substring("content", 1, 8)
    starts = lambda sig: F.coalesce(F.startswith(F.hex(head), F.lit(sig)), F.lit(False))
    image = F.coalesce(*(F.when(starts(sig), name) for sig, name in SIGNATURES))
    mb = F.floor(size / F.lit(1024 * 1024)).cast("string")
    error = (
        F.when(size == 0, EMPTY)
        .when(size > MAX_BYTES, F.concat(F.lit("File size ("), mb, F.lit(f"MB) exceeds maximum allowed size ({MAX_BYTES // 1024 // 1024}MB)")))
        .when(size < MIN_BYTES, F.concat(F.lit("File size ("), size.cast("string"), F.lit(" bytes) is too small to be a valid receipt")))
        .when(kind.isin(PDF_TYPES), PDF)
        .when(~F.coalesce(kind.isin(IMAGE_TYPES), F.lit(False)), F.concat(F.lit("Invalid file type '"), F.coalesce("content_type", F.lit("")), F.lit("'. Allowed types: JPEG, PNG, TIFF images only")))
        .when(F.coalesce(F.octet_length(head), F.lit(0)) < 4, SHORT_HEADER)
        .when(starts(PDF_SIGNATURE), PDF)
        .when(image.isNull(), NO_SIGNATURE)
    )
    out = files.withColumn("error_message", error).withColumn("is_valid", F.col("error_message").isNull())
    found = F.when(F.col("is_valid"), image).when(F.col("error_message") == PDF, "PDF Document")
    return out.withColumns({"detected_file_type": found, "file_size": F.when(size > 0, size).otherwise(0).cast("long")})


def validity(doc_type: Column, confidence: Column, least: float = MIN_CONFIDENCE) -> Column:
    """struct(is_valid_receipt, confidence, message, doc_type) of a document."""
    kind, sure = F.coalesce(doc_type, F.lit("unknown")), F.coalesce(confidence, F.lit(0.0))
    receipt, confident = F.lower(kind).contains("receipt"), sure >= least
    percent = F.format_string("%.2f%%", sure * 100)
    message = (
        F.when(~receipt, F.concat(F.lit("Document type '"), kind, F.lit("' is not a receipt")))
        .when(~confident, F.concat(F.lit("Low confidence ("), percent, F.lit("). Document may not be a clear receipt image")))
        .otherwise(F.concat(F.lit("Valid receipt detected with "), percent, F.lit(" confidence")))
    )
    return F.struct((receipt & confident).alias("is_valid_receipt"), sure.alias("confidence"), message.alias("message"), kind.alias("doc_type"))


def status_of(valid: Column) -> Column:
    """0 without a verdict, 1 for valid, 2 for invalid."""
    return F.when(valid.isNull(), 0).when(valid, 1).otherwise(2)


def problems(of: Callable[[str], Column], columns: list[str], required: list[str], lengths: dict[str, int], prefix: str = "") -> Column:
    """An array of what a row breaks: columns that miss a value or are too long. of: a column of the row by its name."""
    tests = [F.when(of(c).isNull(), F.lit(f"{prefix}{c}: required")) for c in required if c in columns]
    tests += [F.when(F.char_length(of(c)) > n, F.lit(f"{prefix}{c}: longer than {n}")) for c, n in lengths.items() if c in columns]
    return F.array_compact(F.array(*tests))


def breaks(of: Callable[[str], Column], columns: list[str], required: list[str], lengths: dict[str, int]) -> Column:
    """Whether problems() would find any."""
    tests = [of(c).isNull() for c in required if c in columns] + [F.coalesce(F.char_length(of(c)) > n, F.lit(False)) for c, n in lengths.items() if c in columns]
    return reduce(or_, tests, F.lit(False))


def violations(df: DataFrame, required: list[str], lengths: dict[str, int]) -> DataFrame:
    """df with violations: the columns that miss a value or are too long."""
    return df.withColumn("violations", problems(F.col, df.columns, required, lengths))


def nested_violations(receipts: DataFrame, items: str = "items") -> Column:
    """What a receipt with its items nested breaks, its items included: both are stored or neither is. Only of one that breaks something is it told what."""
    bad = breaks(F.col, receipts.columns, S.RECEIPT_REQUIRED, S.RECEIPT_LENGTHS) | F.exists(F.coalesce(F.col(items), F.array()), lambda i: breaks(i.getField, list(S.ITEM_COLUMNS), S.ITEM_REQUIRED, S.ITEM_LENGTHS))
    own = problems(F.col, receipts.columns, S.RECEIPT_REQUIRED, S.RECEIPT_LENGTHS)
    of_items = F.flatten(F.transform(F.coalesce(F.col(items), F.array()), lambda i: problems(i.getField, list(S.ITEM_COLUMNS), S.ITEM_REQUIRED, S.ITEM_LENGTHS, "item ")))
    return F.when(bad, F.sort_array(F.array_distinct(F.concat(own, of_items)))).otherwise(F.array().cast("array<string>"))


def split_by_contract(df: DataFrame, items: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that the tables accept, and those for quarantine."""
    checked = violations(df, *((S.ITEM_REQUIRED, S.ITEM_LENGTHS) if items else (S.RECEIPT_REQUIRED, S.RECEIPT_LENGTHS)))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def rejected(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """(receipt_id, violations) of receipts that break the contract, or one of whose items does: both are stored or neither is."""
    of_items = split_by_contract(items, items=True)[1].select("receipt_id", F.transform("violations", lambda v: F.concat(F.lit("item "), v)).alias("violations"))
    both = split_by_contract(receipts)[1].select("receipt_id", "violations").union(of_items)
    return both.groupBy("receipt_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("violations")))).alias("violations"))


def utc(ts: Column, zone: Column | None = None) -> Column:
    """A time without a zone counts as UTC; one with a zone is converted."""
    return ts if zone is None else F.when(zone.isNull(), ts).otherwise(F.to_utc_timestamp(ts, zone))


def utc_times(df: DataFrame, zone: str = "zone", converted: tuple[str, ...] = ("created_at", "updated_at", "processed_at")) -> DataFrame:
    """df with its times in UTC, by the zone that a row names (null: the time is UTC already). The purchase date is what the receipt says and is never shifted."""
    return df.withColumns({c: utc(F.col(c), F.col(zone)) for c in converted if c in df.columns})
