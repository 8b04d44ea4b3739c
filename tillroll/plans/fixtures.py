"""Receipt data derived from the star-schema tables: receipts, items, texts, OCR documents, readings and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import spread

#: By o_orderkey % 16: a receipt's text, and what must be read from it (name, address, phone, postal code, country, confidence).
CASES = [
    ("CORNER SHOP\n12 Jalan Ampang\nTel: 03-22831117", "CORNER SHOP", "12 Jalan Ampang", "0322831117", None, "Malaysia", 0.85),
    ("C1TY MART\nS 123456", "CITY MART", None, None, "S 123456", None, 0.40),
    ("12345\n===\nHamburger House\nCorner Shop\nLevel 3, Plaza Damai", "Corner Shop", "Level 3, Plaza Damai", None, "12345", None, 0.70),
    ("GREEN GROCER\n$9200 KUALA LUMPUR", "GREEN GROCER", "59200 KUALA LUMPUR", None, "59200", "Malaysia", 0.80),
    ("BOOK NOOK\nZip: 12345", "BOOK NOOK", None, None, "12345", None, 0.40),
    ("BOOK NOOK\nPostal Code: 12345", "BOOK NOOK", None, None, "C0de", None, 0.40),
    ("TOOL BARN\nInvoice 56789", "TOOL BARN", None, None, None, None, 0.25),
    ("TEA ROOM\nM1 1AE", "TEA ROOM", None, None, "M1 1AE", "Uk", 0.50),
    ("MAPLE STORE\nK1A 0B1", "MAPLE STORE", None, None, "K1A 0B1", "Canada", 0.50),
    ("+65 6123 4567\nNOODLE BAR", "NOODLE BAR", None, "+6561234567", None, "Singapore", 0.55),
    ("PIZZA PLACE\nPhone: 12345", "PIZZA PLACE", None, None, "12345", None, 0.40),
    ("DELI DELUXE\nTel: 2345678", "DELI DELUXE", None, "2345678", None, None, 0.45),
    ("..\n--", None, None, None, None, None, 0.0),
    ("URBAN OUTFIT\n10 Lakeview Road\nSydney", "URBAN OUTFIT", "10 Lakeview Road", None, None, "Australia", 0.65),
    ("FRESH FARM\nUnit 5, Bldg B, 90210-1234", "FRESH FARM", "Unit 5, Bldg B, 90210-1234", "02101234", "90210", None, 0.90),
    ("TAXI KIOSK\nCash 12345 Texas", "TAXI KIOSK", "Cash 12345 Texas", None, "12345", "Usa", 0.80),
]
STRATEGIES = ["enhanced", "simple", "high_contrast"]
INGESTED = "2024-03-05 10:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_text(k) -> F.Column:
    return F.element_at(F.array(*(F.lit(c[0]) for c in CASES)), (k + 1).cast("int"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id, k, text) of every order."""
    return spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), (F.col("o_orderkey") % 16).alias("k"))).withColumn("text", case_text(F.col("k")))


def total_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id, text) with a total, a second total and a tax, as plain lines."""
    price = F.format_string("%.2f", "o_totalprice")
    body = F.concat(F.lit("Shop "), F.col("o_custkey").cast("string"), F.lit("\nSubtotal $1.00\nTotal $"), price, F.lit("\nTax $"), F.format_string("%.2f", F.col("o_totalprice").cast("int") / F.lit(10)), F.when(F.col("o_orderkey") % 3 == 0, F.lit("\nTOTAL $.")).otherwise(F.lit("\nTOTAL due later")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), body.alias("text"))


def _reading(receipt_id: F.Column, strategy_ord) -> tuple[F.Column, F.Column]:
    """text_a and text_b of an order's reading by a strategy."""
    text, m = case_text(F.when(receipt_id % 5 == 0, 12).otherwise((receipt_id + 5 * strategy_ord) % 16)), receipt_id % 3
    return F.when(m == 1, "x").otherwise(text).alias("text_a"), F.when(m == 2, "").otherwise(text).alias("text_b")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id, strategy, strategy_ord, text_a, text_b): three readings of every order; every fifth order can't be read."""
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("receipt_id"), F.posexplode(F.array(*map(F.lit, STRATEGIES))).alias("strategy_ord", "strategy"))
    return rows.select("receipt_id", "strategy", "strategy_ord", *_reading(F.col("receipt_id"), F.col("strategy_ord")))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id, readings): the three candidates of every order as one row, made where the order lies."""
    key = F.col("o_orderkey")
    made = (F.struct(F.lit(name).alias("strategy"), F.lit(k).alias("strategy_ord"), *_reading(key, k), F.lit(None).cast("string").alias("error")) for k, name in enumerate(STRATEGIES))
    return table(spark, sf_dir, "orders").select(key.cast("string").alias("receipt_id"), F.array(*made).alias("readings"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of orders: the store is the supplier with the smallest key, the user the customer."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left")
    return rows.select(
        F.col("o_orderkey").alias("receipt_id"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_id"), F.coalesce("s_name", F.lit("")).alias("store_name"), F.lit("").alias("store_address"),
        F.col("o_orderdate").cast("timestamp").alias("purchase_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"), (F.col("o_orderkey") % 3).cast("int").alias("status"),
        ((F.col("o_orderkey") % 100) / 100.0).cast("double").alias("validation_confidence"), F.lit(None).cast("double").alias("location_confidence"), (F.col("o_orderkey") % 3 == 1).alias("is_valid_receipt"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.concat(F.lit("users/user-"), F.col("o_custkey").cast("string")).alias("s3_key"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of line items, named by part."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    key = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns)), 256)
    return rows.select(key.alias("item_id"), F.col("l_orderkey").alias("receipt_id"), F.coalesce("p_name", F.lit("")).alias("name"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_quantity").cast("int").alias("quantity"))


def documents_json(spark: SparkSession, sf_dir: str, nested: bool = False) -> DataFrame:
    """(receipt_id, user_id, file_name, ingest_ts, json): an OCR document for every order, in twelve shapes by o_orderkey % 12.

    nested: by o_orderkey % 7 the items stand one level (1), two (2) or four (3) deeper, as a list in a list, under an object's own Items (4), or as JSON text (5); else as ever."""
    k = F.col("receipt_id") % 12
    leaf = lambda v: F.concat(F.lit('{"value":"'), v, F.lit('"}'))
    price, qty = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("price", "quantity"))
    qty = F.concat(qty, F.lit(".9"))
    body = F.concat(
        F.lit('{"Description":'), leaf(F.col("name")),
        F.when(k == 4, "").otherwise(F.concat(F.lit(',"Quantity":'), leaf(qty))),
        F.when(k == 5, F.concat(F.lit(',"TotalPrice":{"value":"x"},"Price":'), leaf(price))).when(k == 6, F.concat(F.lit(',"Price":'), leaf(price))).otherwise(F.concat(F.lit(',"TotalPrice":'), leaf(price))), F.lit("}"),
    )
    entry = F.when(k == 2, F.concat(F.lit('{"value_type":"dictionary","value":'), body, F.lit("}"))).otherwise(F.concat(F.lit('{"value_type":"object","value_object":'), body, F.lit("}")))
    lists = items(spark, sf_dir).select("receipt_id", entry.alias("e")).groupBy("receipt_id").agg(F.array_join(F.sort_array(F.collect_list("e")), ",").alias("entries"))
    rows = receipts(spark, sf_dir).join(lists, "receipt_id", "left")
    inner = F.coalesce("entries", F.lit(""))
    if nested:
        d = F.col("receipt_id") % 7
        level = lambda e, key="value_array": F.concat(F.lit(f'{{"{key}":['), e, F.lit("]}"))
        as_text = F.concat(F.lit('{"value":"['), F.replace(inner, F.lit('"'), F.lit('\\"')), F.lit(']"}'))
        inner = F.when(d == 1, level(inner)).when(d == 2, level(level(inner, "value"))).when(d == 3, level(level(level(level(inner))))).when(d == 4, F.concat(F.lit('{"value_object":{"Items":'), level(inner), F.lit("}}"))).when(d == 5, as_text).otherwise(inner)
    held = F.concat(F.lit(',"Items":{"'), F.when(k == 1, "value").otherwise("value_array"), F.lit('":['), inner, F.lit("]}"))
    total = F.when(k == 7, "1,234.50").otherwise(F.col("total_amount").cast("string"))
    day = F.when(k == 8, "not a date").otherwise(F.date_format("purchase_date", "yyyy-MM-dd"))
    json = F.concat(
        F.lit('{"doc_type":"'), F.when(k == 11, "invoice").otherwise("receipt.retail"), F.lit('","confidence":'), F.when(k == 3, "0.7").otherwise("0.95"), F.lit(',"fields":{"MerchantName":'), leaf(F.col("store_name")),
        F.lit(',"TransactionDate":'), leaf(day), F.lit(',"Total":'), leaf(total), F.when(k == 9, "").otherwise(held), F.lit("}}"),
    )
    return rows.select(F.col("receipt_id").cast("string").alias("receipt_id"), "user_id", F.concat(F.lit("r"), F.col("receipt_id").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(INGESTED).cast("timestamp").alias("ingest_ts"), F.when(k == 10, '{"doc_type": broken').otherwise(json).alias("json"))


def full_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(receipt_id, user_id, file_name, ingest_ts, json): a document with every merchant, type and amount field for each order, by receipt_id % 4: 1 lacks the type, the transaction, the tax and the tip,
    2 has amounts that can't be read, 3 has thousands separators and half cents."""
    id_, text = F.col("receipt_id"), F.col("receipt_id").cast("string")
    k = id_ % 4
    field = lambda name, v: F.concat(F.lit(f'"{name}":{{"value":"'), v, F.lit('"}'))
    amount = lambda plain, odd: F.when(k == 2, "n/a").when(k == 3, odd).otherwise(plain)
    some = lambda v: F.when(k != 1, v)
    money, tax = F.col("total_amount").cast("string"), (id_ % 90).cast("string")
    fields = [
        field("MerchantName", F.col("store_name")), field("MerchantAddress", F.concat(F.lit("12 "), "user_id", F.lit(" Road"))), field("MerchantPhoneNumber", F.concat(F.lit("03"), (id_ + 10000000).cast("string"))),
        some(field("ReceiptType", F.lit("Itemized"))), some(field("TransactionId", F.concat(F.lit("T-"), text))), field("Total", amount(money, money)), field("Subtotal", amount(money, "1,234.50")),
        some(field("TotalTax", amount(F.concat(tax, F.lit(".13")), F.concat(tax, F.lit(".125"))))), some(field("Tip", amount(F.lit("1.01"), "1.005"))),
    ]
    json = F.concat(F.lit('{"doc_type":"receipt","confidence":0.9,"fields":{'), F.concat_ws(",", *fields), F.lit("}}"))
    return receipts(spark, sf_dir).select(text.alias("receipt_id"), "user_id", F.lit("f.jpg").alias("file_name"), F.lit(INGESTED).cast("timestamp").alias("ingest_ts"), json.alias("json"))


def odd_documents(spark: SparkSession, sf_dir: str, copies: bool = False) -> DataFrame:
    """(receipt_id, user_id, file_name, ingest_ts, json) of every order, in nine shapes by o_orderkey % 9: 1 has a store name that is too long, 2 an item whose name is too long, 3 no user, 4 broken JSON, 5 no fields,
    6 a quantity with a thousands separator, 7 no JSON, 8 (with `copies`) a broken copy delivered beside it; the rest are plain."""
    key = F.col("o_orderkey")
    k, text = key % 9, key.cast("string")
    name = F.when(k == 1, F.repeat(F.lit("x"), F.lit(201))).otherwise(F.concat(F.lit("Shop "), text))
    item = F.when(k == 2, F.repeat(F.lit("y"), F.lit(301))).otherwise(F.concat(F.lit("Thing "), text))
    quantity = F.when(k == 6, "1,250").otherwise((key % 7).cast("string"))
    whole = F.concat(F.lit('{"doc_type":"receipt","confidence":0.9,"fields":{"MerchantName":{"value":"'), name, F.lit('"},"Items":{"value_array":[{"value_object":{"Description":{"value":"'), item, F.lit('"},"Quantity":{"value":"'), quantity, F.lit('"}}}]}}}'))
    broken = F.lit('{"doc_type": "receipt", "fields": {')
    json = F.when(k == 4, broken).when(k == 5, '{"doc_type":"receipt","confidence":0.9}').when(k != 7, whole)
    rows = table(spark, sf_dir, "orders").select(text.alias("receipt_id"), F.when(k != 3, F.concat(F.lit("user-"), F.col("o_custkey").cast("string"))).alias("user_id"), F.concat(F.lit("r"), text, F.lit(".jpg")).alias("file_name"), F.lit(INGESTED).cast("timestamp").alias("ingest_ts"), json.alias("json"), k.alias("k"))
    out = rows.unionByName(rows.where("k = 8").withColumn("json", broken)) if copies else rows
    return out.drop("k")


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with the zone their times are in: every third is from Singapore, the rest say nothing."""
    return receipts(spark, sf_dir).withColumn("zone", F.when(F.col("receipt_id") % 3 == 0, "Asia/Singapore"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content_type, length, content): pages as files, with headers, types and lengths by page_id."""
    p = F.col("page_id")
    head = F.element_at(F.array(*map(F.lit, ["FFD8FF", "89504E470D0A1A0A", "49492A00", "4D4D002A", "25504446", ""])), (p % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["image/jpeg", "IMAGE/PNG", "image/tiff", "image/jpg", "image/tif", "application/pdf", "text/html"])), (p % 7 + 1).cast("int"))
    length = F.when(p % 8 == 0, 0).when(p % 8 == 1, 1023).when(p % 8 == 2, 1024).when(p % 8 == 3, 10485760).when(p % 8 == 4, 10485761).otherwise(F.octet_length("html") + 2048)
    return table(spark, sf_dir, "pages").select(p.alias("file_id"), kind.alias("content_type"), length.cast("long").alias("length"), F.concat(F.unhex(head), F.encode(F.lit("xxxx"), "utf-8"), F.encode("html", "utf-8")).alias("content"))
