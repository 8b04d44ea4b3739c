"""Location details and totals of OCR texts, one row in and one row out: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import text as T

LOCATION = ["store_name", "address", "phone", "postal_code", "country", "confidence", "full_location_text"]


def extract_locations(df: DataFrame, text: str = "text", prefix: str = "", lists: T.Lists | None = None) -> DataFrame:
    """df with the columns of LOCATION. Null texts find nothing. lists: a job's own word lists and patterns."""
    k = lists or T.Lists()
    lines, whole = F.col("_lines"), F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_lines", T.lines_of(whole)).withColumns({
        "store_name": T.store_name(lines, k.noise_marks, k.noise_words),
        "address": T.address(lines, k.address_words),
        "phone": T.phone(lines, k.phone_patterns),
        "postal_code": T.postal_code(whole, k.postal_exclusions, k.labelled_postal, k.city_postal, k.country_postal),
        "country": T.country(whole, k.country_words, k.country_phones, k.usa_context, k.country_postal),
        "full_location_text": T.location_section(lines, k.section_stops),
    })
    out = out.withColumn("confidence", T.confidence({c: F.col(c) for c in T.WEIGHTS})).drop("_lines")
    return out.withColumnsRenamed({c: prefix + c for c in LOCATION}) if prefix else out


def locations_of(texts: Column, lists: T.Lists | None = None) -> Column:
    """An array of structs with `text`, each with the columns of LOCATION but the full text of the location, read where the array lies."""
    k = lists or T.Lists()
    lined = F.transform(texts, lambda t: t.withField("_lines", T.lines_of(F.coalesce(t["text"], F.lit("")))).withField("_whole", F.coalesce(t["text"], F.lit(""))))
    found = F.transform(lined, lambda t: t.withField("store_name", T.store_name(t["_lines"], k.noise_marks, k.noise_words)).withField("address", T.address(t["_lines"], k.address_words)).withField("phone", T.phone(t["_lines"], k.phone_patterns))
        .withField("postal_code", T.postal_code(t["_whole"], k.postal_exclusions, k.labelled_postal, k.city_postal, k.country_postal))
        .withField("country", T.country(t["_whole"], k.country_words, k.country_phones, k.usa_context, k.country_postal)))
    return F.transform(found, lambda t: t.dropFields("_lines", "_whole").withField("confidence", T.confidence({c: t[c] for c in T.WEIGHTS})))


def text_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """df with store (the first line), total_amount and tax_amount read from plain lines."""
    lines = T.lines_of(F.coalesce(F.col(text), F.lit("")))
    return df.withColumns({"store": F.get(lines, 0), "total_amount": T.plain_amount(lines, "total"), "tax_amount": T.plain_amount(lines, "tax")})
