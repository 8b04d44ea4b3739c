"""All queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import text as T
from tillroll.operators import analytics, candidates, checks, extract, nested, store, structure, versions
from tillroll.plans import fixtures as X
from tillroll.session import scratch, spread
from tillroll.sources import landing
from tillroll.streaming import ingest
from tillroll.streaming.ingest import ingest_stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _literal(v) -> str:
    return "NULL" if v is None else f"{v!r}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


CASES = "(VALUES " + ", ".join(f"({k}, " + ", ".join(map(_literal, c)) + ")" for k, c in enumerate(X.CASES)) + ") c(k, text, store_name, address, phone, postal_code, country, confidence)"
RECEIPTS = """(SELECT o_orderkey AS receipt_id, 'user-' || o_custkey AS user_id, coalesce(s_name, '') AS store_name, o_orderdate AS purchase_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, CAST(o_orderkey % 3 AS INTEGER) AS status, (o_orderkey % 100) / 100.0 AS validation_confidence, o_custkey
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = sk)"""
ITEMS = """(SELECT l_orderkey AS receipt_id, coalesce(p_name, '') AS name, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(trunc(l_quantity) AS INTEGER) AS quantity
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
LANDED = 1_000_000  # documents a landed file: a micro-batch, some files, stays of one size whatever the input
ROW_GROUP = 8 << 20  # bytes
PAID = "coalesce(CAST(sum(price) AS DOUBLE), 0.0) AS paid"


# ---------------------------------------------------------------- screening


@query("""
SELECT page_id AS file_id, e IS NULL AS is_valid, e AS error_message, CASE WHEN e IS NULL THEN sig WHEN e LIKE 'PDF files%' THEN 'PDF Document' END AS detected_file_type, n AS file_size
FROM (SELECT *, CASE WHEN n = 0 THEN 'No file uploaded or file is empty'
    WHEN n > 10485760 THEN 'File size (' || n // 1048576 || 'MB) exceeds maximum allowed size (10MB)'
    WHEN n < 1024 THEN 'File size (' || n || ' bytes) is too small to be a valid receipt'
    WHEN page_id % 7 = 5 THEN 'PDF files are not supported. Please upload an image file (JPEG, PNG, or TIFF)'
    WHEN page_id % 7 = 6 THEN 'Invalid file type ''text/html''. Allowed types: JPEG, PNG, TIFF images only'
    WHEN page_id % 6 = 4 THEN 'PDF files are not supported. Please upload an image file (JPEG, PNG, or TIFF)'
    WHEN page_id % 6 = 5 THEN 'File signature does not match any supported image format (JPEG, PNG, TIFF). The file may be corrupted or have the wrong extension.' END AS e,
    CASE page_id % 6 WHEN 0 THEN 'JPEG Image' WHEN 1 THEN 'PNG Image' ELSE 'TIFF Image' END AS sig
  FROM (SELECT page_id, CAST(CASE page_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 1023 WHEN 2 THEN 1024 WHEN 3 THEN 10485760 WHEN 4 THEN 10485761 ELSE strlen(html) + 2048 END AS BIGINT) AS n FROM pages))
""")
def file_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.screen_files(X.files(spark, sf_dir)).select("file_id", "is_valid", "error_message", "detected_file_type", "file_size")


@query("""
SELECT doc_id, kind LIKE '%receipt%' AND conf >= 0.7 AS is_valid_receipt, conf AS confidence, kind AS doc_type,
  CASE WHEN labelled IS NULL THEN 0 WHEN kind LIKE '%receipt%' AND conf >= 0.7 THEN 1 ELSE 2 END AS status,
  CASE WHEN kind NOT LIKE '%receipt%' THEN 'Document type ''' || kind || ''' is not a receipt'
    WHEN conf < 0.7 THEN 'Low confidence (' || printf('%.2f', conf * 100) || '%). Document may not be a clear receipt image'
    ELSE 'Valid receipt detected with ' || printf('%.2f', conf * 100) || '% confidence' END AS message
FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'invoice' WHEN d.doc_id % 7 = 0 THEN 'unknown' ELSE 'receipt.retail' END AS kind,
    CASE WHEN n_chars % 4 = 0 THEN 0.7::DOUBLE ELSE (n_chars % 100)::DOUBLE / 100 END AS conf, l.doc_id AS labelled
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)
""")
def receipt_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 5 == 0, "invoice").when(d % 7 == 0, F.lit(None)).otherwise("receipt.retail")
    conf = F.when(F.col("n_chars") % 4 == 0, 0.7).otherwise((F.col("n_chars") % 100).cast("double") / 100)
    labelled = X.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    rows = X.table(spark, sf_dir, "documents").select("doc_id", checks.validity(kind, conf).alias("v")).join(labelled, "doc_id", "left")
    return rows.select("doc_id", "v.is_valid_receipt", "v.confidence", "v.doc_type", checks.status_of(F.when(F.col("seen"), F.col("v.is_valid_receipt"))).alias("status"), "v.message")


@query(f"""
SELECT receipt_id, concat_ws('; ', CASE WHEN receipt_id % 11 = 0 THEN 'total_amount: required' END, CASE WHEN receipt_id % 13 = 0 THEN 'store_name: longer than 200' END) AS problems
FROM {RECEIPTS} WHERE receipt_id % 11 = 0 OR receipt_id % 13 = 0
""")
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, whole = F.col("receipt_id"), X.receipts(spark, sf_dir)
    rows = whole.withColumns({"total_amount": F.when(id_ % 11 != 0, F.col("total_amount")), "store_name": F.when(id_ % 13 == 0, F.repeat(F.lit("n"), F.lit(201))).otherwise(F.col("store_name"))})
    return checks.split_by_contract(rows)[1].select("receipt_id", F.array_join("violations", "; ").alias("problems"))


@query(f"""
SELECT receipt_id, purchase_date::TIMESTAMP AS purchase_date, CASE WHEN receipt_id % 3 = 0 THEN purchase_date::TIMESTAMP - INTERVAL 8 HOUR ELSE purchase_date::TIMESTAMP END AS created_at FROM {RECEIPTS}
""".replace("purchase_date::TIMESTAMP AS purchase_date", "strftime(purchase_date, '%Y-%m-%d %H:%M') AS purchase_date").replace("CASE WHEN", "strftime(CASE WHEN").replace("END AS created_at", "END, '%Y-%m-%d %H:%M') AS created_at"))
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return checks.utc_times(X.zoned(spark, sf_dir)).select("receipt_id", stamp("purchase_date"), stamp("created_at"))


# ---------------------------------------------------------------- text


@query(f"SELECT o_orderkey AS receipt_id, store_name, address, phone, postal_code, country, confidence FROM orders JOIN {CASES} ON c.k = o_orderkey % 16")
def location_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_locations(X.texts(spark, sf_dir)).select("receipt_id", "store_name", "address", "phone", "postal_code", "country", "confidence")


@query(f"SELECT country, count(*) AS n, avg(confidence) AS avg_confidence FROM orders JOIN {CASES} ON c.k = o_orderkey % 16 GROUP BY country".replace("avg(confidence)", "round(avg(confidence), 6)"))
def locations_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_locations(X.texts(spark, sf_dir)).groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query(r"""
WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10))[1:15], lambda x: regexp_replace(regexp_replace(x, '^[\s\x0b\x1c-\x1f]+', ''), '[\s\x0b\x1c-\x1f]+$', '')) AS ls FROM documents),
s AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(lower(x), 'date|time|cashier|terminal')), true) AS stop FROM l)
SELECT doc_id, array_to_string(list_filter(CASE WHEN stop > 0 THEN ls[1:stop] ELSE ls END, lambda x: x <> ''), chr(10)) AS section FROM s
""")
def location_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.lines_of(F.coalesce("text", F.lit("")))
    return X.table(spark, sf_dir, "documents").select("doc_id", T.location_section(lines).alias("section"))


@query(f"""SELECT o_orderkey AS receipt_id, CASE WHEN store_name = 'BOOK NOOK' THEN NULL ELSE store_name END AS store_name, CASE WHEN contains(text, 'Sydney') THEN 'Down Under' END AS country FROM orders JOIN {CASES} ON c.k = o_orderkey % 16""")
def location_own_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's own word lists: one more noise word, and countries by its own names."""
    own = T.Lists(noise_words=[*T.NOISE_WORDS, "book", "zip", "postal"], country_words=[("Down Under", ["sydney"])], country_phones=[], usa_context=[])
    found = extract.extract_locations(X.texts(spark, sf_dir), lists=own)
    return found.select("receipt_id", "store_name", F.when(F.col("country") == "Down Under", F.col("country")).alias("country"))


_STRIP = lambda c: rf"regexp_replace(regexp_replace({c}, '^[\s\x0b\x1c-\x1f]+', ''), '[\s\x0b\x1c-\x1f]+$', '')"
_TWICE = lambda c, a, b: f"regexp_replace(regexp_replace({c}, '{a}', '{b}', 'g'), '{a}', '{b}', 'g')"  # noqa: E731  # what look-arounds do in one go
_NAME = _STRIP(r"regexp_replace(x, '[\s\x0b\x1c-\x1f]+', ' ', 'g')")
for _mark, _letter in ((r"\|", "I"), ("0", "O"), ("1", "I")):
    _NAME = _TWICE(_NAME, rf"([A-Z]){_mark}([A-Z])", rf"\1{_letter}\2")
_ADDRESS = rf"regexp_replace({_TWICE("replace(x, '$', '5')", r"(\d)[Oo](\d)", r"\10\2")}, '(\d)[Oo](\s|$)', '\10\2', 'g')"
_PLAIN = lambda c: rf"regexp_replace(regexp_replace({c}, '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}]', '~', 'g'), '[^\x00-\x7F]', '_', 'g')"  # noqa: E731  # DuckDB's word boundaries know ASCII alone
_DIGITS = lambda p: rf"regexp_replace(regexp_replace(regexp_extract(r, '(?i){p}'), '(?i)(?:Tel|Phone|Ph|Contact)[:\s]*', '', 'g'), '[^\d+]', '', 'g')"
_PHONES = "coalesce(" + ", ".join(f"CASE WHEN length(replace({_DIGITS(p)}, '+', '')) >= 7 THEN {_DIGITS(p)} END" for p in T.PHONE_PATTERNS) + ")"
_FOUND = lambda p: f"CASE WHEN regexp_matches(t, '(?i){p}') THEN translate({_STRIP(f"regexp_extract(t, '(?i){p}', 1)")}, '$Oo', '500') END"
_CITY = rf"translate(string_split_regex(nullif(regexp_extract(t, '(?i){T.CITY_POSTAL}'), ''), '\s+')[1], '$Oo', '500')"
_COUNTRY = "CASE " + " ".join(
    [f"WHEN regexp_matches(low, '{'|'.join(held)}') THEN '{name}'" for name, held in T.COUNTRY_WORDS]
    + [f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in T.COUNTRY_PHONES]
    + [rf"WHEN len(list_filter(string_split(low, chr(10)), lambda x: regexp_matches({_PLAIN("x")}, '(?s)\b[5-9]\d{{4}}\b.*(kuala|lumpur|malaysia)'))) > 0 THEN 'Malaysia'"]
    + [f"WHEN regexp_matches(t, '{T.COUNTRY_POSTAL[3]}') THEN 'Uk' WHEN regexp_matches(t, '{T.COUNTRY_POSTAL[4]}') THEN 'Canada' WHEN regexp_matches(low, '{'|'.join(T.USA_CONTEXT)}') AND regexp_matches(t, '{T.COUNTRY_POSTAL[2]}') THEN 'Usa'"]
) + " END"


@query(rf"""
WITH d AS (SELECT doc_id, {_PLAIN("coalesce(text, '')")} AS t, lower(coalesce(text, '')) AS low, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, i, {_STRIP("ls[i]")} AS x, translate(ls[i], 'Oo?', '007') AS r FROM d, unnest(range(1, 21)) u(i) WHERE i <= len(ls)),
c AS (SELECT *, {_NAME} AS name, {_ADDRESS} AS a, {_PHONES} AS p FROM n),
g AS (
  SELECT doc_id, arg_min(name, i) FILTER (i <= 10 AND length(x) >= 3 AND NOT regexp_matches(translate(x, ' .-', ''), '^\d+$') AND NOT regexp_matches(x, '\||===|---|___|\*\*\*') AND NOT regexp_matches(lower(x), 'date|time|am|pm')
      AND length(regexp_replace(name, '[^\p{{L}}]', '', 'g')) >= 3) AS store_name,
    string_agg(a, ' ' ORDER BY i) FILTER (i <= 15 AND x <> '' AND (regexp_matches(lower(a), '{"|".join(T.ADDRESS_WORDS)}') OR regexp_matches({_PLAIN("a")}, '\b\d+[-\s]+[A-Za-z]'))) AS address,
    arg_min(p, i) FILTER (p IS NOT NULL) AS phone, min(i) FILTER (i <= 15 AND regexp_matches(lower(x), '{"|".join(T.SECTION_STOPS)}')) AS stop FROM c GROUP BY 1
), s AS (SELECT n.doc_id, string_agg(x, chr(10) ORDER BY i) FILTER (i <= 15 AND i <= coalesce(stop, 15) AND x <> '') AS section FROM n JOIN g ON g.doc_id = n.doc_id GROUP BY 1),
h AS (SELECT doc_id, k, t, regexp_extract_all(t, '(?i)' || p) AS hits, string_split_regex(t, '(?i)' || p) AS pieces FROM d, (VALUES {", ".join(f"({k}, '{p}')" for k, p in enumerate(T.COUNTRY_POSTAL))}) v(k, p)),
e AS (SELECT doc_id, k, i, t, hits[i] AS hit, 1 + list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS pos FROM h, unnest(range(1, len(hits) + 1)) u(i)),
o AS (SELECT doc_id, arg_min(translate({_STRIP("hit")}, '$Oo', '500'), k * 1000000 + i) AS code FROM e
  WHERE NOT regexp_matches(lower(substr(t, CAST(greatest(1, pos - 30) AS BIGINT), CAST(pos - greatest(1, pos - 30) + length(hit) + 30 AS BIGINT))), '{"|".join(f"(?:{x})" for x in T.POSTAL_EXCLUSIONS)}') GROUP BY 1),
f AS (SELECT d.doc_id, store_name, address, phone, coalesce({_FOUND(T.LABELLED_POSTAL[0])}, {_FOUND(T.LABELLED_POSTAL[1])}, CASE WHEN regexp_matches({_CITY}, '^\d+$') AND CAST({_CITY} AS INTEGER) BETWEEN 50000 AND 99999 THEN {_CITY} END, code) AS postal_code,
  {_COUNTRY} AS country, coalesce(section, '') AS full_location_text FROM d JOIN g ON g.doc_id = d.doc_id JOIN s ON s.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id)
SELECT *, CAST((CASE WHEN store_name <> '' THEN 25 ELSE 0 END + CASE WHEN address <> '' THEN 30 ELSE 0 END + CASE WHEN phone <> '' THEN 20 ELSE 0 END + CASE WHEN postal_code <> '' THEN 15 ELSE 0 END + CASE WHEN country <> '' THEN 10 ELSE 0 END) / 100.0 AS DOUBLE) AS confidence FROM f
""")
def location_extract_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_locations(spread(X.table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")


@query("""
SELECT o_orderkey AS receipt_id, 'Shop ' || o_custkey AS store, round(o_totalprice, 2) AS total_amount, CAST(trunc(o_totalprice) AS INTEGER) / 10.0 AS tax_amount FROM orders
""")
def text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.text_totals(X.total_texts(spark, sf_dir)).select("receipt_id", "store", "total_amount", "tax_amount")


READINGS = f"""(SELECT o_orderkey AS receipt_id, s.ord, s.name AS strategy, c.*, c.confidence + CASE WHEN c.store_name IS NOT NULL THEN 0.2 ELSE 0 END AS score,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY c.confidence + CASE WHEN c.store_name IS NOT NULL THEN 0.2 ELSE 0 END DESC, s.ord) AS rn
  FROM orders CROSS JOIN (VALUES (0, 'enhanced'), (1, 'simple'), (2, 'high_contrast')) s(ord, name)
  JOIN {CASES} ON c.k = CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE (o_orderkey + 5 * s.ord) % 16 END)"""


@query(f"""
SELECT receipt_id, score > 0 AS success, CASE WHEN score > 0 THEN strategy END AS strategy_used, CASE WHEN score > 0 THEN store_name END AS store_name, CASE WHEN score > 0 THEN substr(text, 1, 500) END AS raw_text,
  CASE WHEN score > 0 THEN confidence END AS confidence, CASE WHEN score > 0 THEN NULL ELSE 'All preprocessing strategies failed' END AS error FROM {READINGS} WHERE rn = 1
""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.best_candidates(X.candidates(spark, sf_dir)).select("receipt_id", "success", "strategy_used", "store_name", "raw_text", "confidence", "error")


@query(f"""
SELECT receipt_id, score > 0 AS success, CASE WHEN score > 0 THEN strategy END AS strategy_used FROM (
  SELECT receipt_id, strategy, score, row_number() OVER (PARTITION BY receipt_id ORDER BY CASE WHEN failed THEN -1 ELSE score END DESC, ord) AS rn, failed
  FROM (SELECT *, receipt_id % 4 = ord AS failed FROM {READINGS})) WHERE rn = 1
""")
def failed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading of most receipts failed with an error: the others decide."""
    rows = X.candidates(spark, sf_dir).withColumn("error", F.when(F.col("receipt_id") % 4 == F.col("strategy_ord"), "image could not be read"))
    return candidates.best_candidates(rows).select("receipt_id", "success", "strategy_used")


@query(f"""
SELECT country, strategy AS strategy_used, wins, avg_score, CAST(rank() OVER (PARTITION BY country ORDER BY wins DESC, strategy) AS BIGINT) AS rank FROM (
  SELECT coalesce(country, 'unknown') AS country, strategy, count(*) AS wins, round(avg(score), 6) AS avg_score FROM {READINGS} WHERE rn = 1 AND score > 0 GROUP BY 1, 2)
""")
def strategy_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.strategy_board(X.candidates(spark, sf_dir)).select("country", "strategy_used", "wins", F.round("avg_score", 6).alias("avg_score"), F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- documents


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.parse_documents(X.documents_json(spark, sf_dir))


@query(f"""
SELECT CAST(r.receipt_id AS VARCHAR) AS receipt_id, r.store_name, CASE WHEN r.receipt_id % 12 = 8 THEN NULL ELSE strftime(purchase_date, '%Y-%m-%d') END AS day,
  CASE WHEN r.receipt_id % 12 = 7 THEN 1234.5 ELSE CAST(total_amount AS DOUBLE) END AS total_amount, CASE WHEN r.receipt_id % 12 = 11 THEN 2 ELSE 1 END AS status, r.receipt_id % 12 <> 11 AS is_valid_receipt,
  CASE WHEN r.receipt_id % 12 = 3 THEN 0.7 ELSE 0.95 END::DOUBLE AS validation_confidence, 'users/' || user_id || '/receipts/2024/03/05/' || r.receipt_id || '/r' || r.receipt_id || '.jpg' AS s3_key
FROM {RECEIPTS} r WHERE r.receipt_id % 12 <> 10
""")
def receipts_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.receipts_from(_docs(spark, sf_dir))
    return rows.select("receipt_id", "store_name", F.date_format("purchase_date", "yyyy-MM-dd").alias("day"), F.col("total_amount").cast("double").alias("total_amount"), "status", "is_valid_receipt", "validation_confidence", "s3_key")


@query(f"""
SELECT CAST(receipt_id AS VARCHAR) AS receipt_id, name, CASE WHEN receipt_id % 12 = 4 THEN 1 ELSE quantity END AS quantity, CASE WHEN receipt_id % 12 = 5 THEN 0.0 ELSE CAST(price AS DOUBLE) END AS price
FROM {ITEMS} WHERE receipt_id % 12 NOT IN (9, 10) AND receipt_id IN (SELECT o_orderkey FROM orders)
""")
def items_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.items_from(_docs(spark, sf_dir)).select("receipt_id", "name", "quantity", F.col("price").cast("double").alias("price"))


@query(ORACLES["items_from_json"])
def items_from_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose items nest up to four levels deeper lie as VARIANT under day folders, and give the items that flat ones give."""
    path = scratch(spark, "variant-zone")
    landing.write_by_day(nested.variant_documents(X.documents_json(spark, sf_dir, nested=True)), path, "ingest_ts", "parquet")
    back = landing.read_by_day(spark, path, "receipt_id string, user_id string, file_name string, ingest_ts timestamp, document variant", "parquet")
    return nested.deep_items(back).select("receipt_id", "name", "quantity", F.col("price").cast("double").alias("price"))


@query(f"""
SELECT CAST(receipt_id AS VARCHAR) AS receipt_id, store_name, '12 ' || user_id || ' Road' AS store_address, '03' || (10000000 + receipt_id) AS phone, CASE WHEN receipt_id % 4 <> 1 THEN 'Itemized' END AS receipt_type,
  CASE WHEN receipt_id % 4 <> 1 THEN 'T-' || receipt_id END AS transaction_id, CASE receipt_id % 4 WHEN 2 THEN NULL WHEN 3 THEN 1234.5 ELSE CAST(total_amount AS DOUBLE) END AS subtotal, CASE WHEN receipt_id % 4 NOT IN (1, 2) THEN CAST((receipt_id % 90) + 0.13 AS DOUBLE) END AS tax,
  CASE WHEN receipt_id % 4 NOT IN (1, 2) THEN 1.01::DOUBLE END AS tip, CASE receipt_id % 4 WHEN 2 THEN 0 ELSE CAST(total_amount AS DOUBLE) END AS total FROM {RECEIPTS}
""")
def fields_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field that a document may have: present, absent, unreadable, and with a thousands separator or a half cent, by receipt_id % 4."""
    rows = structure.receipts_from(structure.parse_documents(X.full_documents(spark, sf_dir)))
    amount = lambda c, name: F.col(c).cast("double").alias(name)
    return rows.select("receipt_id", "store_name", "store_address", F.col("store_phone_number").alias("phone"), "receipt_type", "transaction_id", amount("subtotal_amount", "subtotal"), amount("tax_amount", "tax"), amount("tip_amount", "tip"), amount("total_amount", "total"))


@query(f"""
SELECT CAST(r.receipt_id AS VARCHAR) AS receipt_id, coalesce(CASE WHEN w.score > 0 THEN w.store_name END, r.store_name) AS store_name, CASE WHEN w.score > 0 THEN w.address END AS store_address,
  CASE WHEN w.score > 0 THEN w.phone END AS phone, CASE WHEN w.score > 0 THEN w.postal_code END AS postal_code, CASE WHEN w.score > 0 THEN w.country END AS country,
  CASE WHEN w.score > 0 THEN w.confidence END AS location_confidence, CASE WHEN w.score > 0 THEN w.strategy END AS ocr_strategy
FROM {RECEIPTS} r JOIN (SELECT * FROM {READINGS} WHERE rn = 1) w ON w.receipt_id = r.receipt_id WHERE r.receipt_id % 12 <> 10
""")
def merchant_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = candidates.best_candidates(X.candidates(spark, sf_dir)).withColumn("receipt_id", F.col("receipt_id").cast("string"))
    rows = structure.receipts_from(structure.override_merchant(_docs(spark, sf_dir), located))
    return rows.select("receipt_id", "store_name", F.nullif("store_address", F.lit("")).alias("store_address"), F.col("store_phone_number").alias("phone"), "postal_code", "country", "location_confidence", "ocr_strategy")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS receipt_id, o_orderkey % 12 <> 10 AS success, CASE WHEN o_orderkey % 12 = 10 THEN 'Corrupt document' END AS error FROM orders""")
def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = candidates.best_candidates(X.candidates(spark, sf_dir)).withColumn("receipt_id", F.col("receipt_id").cast("string"))
    return structure.receipt_results(_docs(spark, sf_dir), located).select("receipt_id", "success", "error")


@query(f"SELECT CAST(receipt_id AS VARCHAR) AS receipt_id, store_name, CAST(NULL AS VARCHAR) AS country, receipt_id % 12 <> 10 AS success FROM {RECEIPTS} WHERE receipt_id % 12 <> 10")
def results_without_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location step left out: what the document says stays, and nothing is located."""
    located = candidates.best_candidates(X.candidates(spark, sf_dir)).withColumn("receipt_id", F.col("receipt_id").cast("string"))
    found = structure.receipt_results(_docs(spark, sf_dir), located, extract_location=False)
    return structure.receipts_from(found, ("success",)).select("receipt_id", "store_name", "country", "success")


@query(f"""
SELECT CAST(w.receipt_id AS VARCHAR) AS receipt_id, w.receipt_id % 9 NOT IN (4, 7) AS success, CASE w.receipt_id % 9 WHEN 4 THEN 'Corrupt document' WHEN 7 THEN 'No receipt data found' END AS error,
  CASE WHEN score > 0 THEN country END AS country, CASE WHEN w.receipt_id % 9 IN (4, 7) THEN NULL WHEN score > 0 AND w.store_name IS NOT NULL THEN w.store_name WHEN w.receipt_id % 9 = 5 THEN ''
    WHEN w.receipt_id % 9 = 1 THEN repeat('x', 201) ELSE 'Shop ' || w.receipt_id END AS store_name
FROM {READINGS} w WHERE rn = 1
""")
def document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without fields, missing and corrupt ones: what was located stays beside the error, and makes up for missing fields."""
    located = candidates.best_candidates(X.candidates(spark, sf_dir)).withColumn("receipt_id", F.col("receipt_id").cast("string"))
    found = structure.receipt_results(structure.parse_documents(X.odd_documents(spark, sf_dir)), located)
    rows = structure.receipts_from(found, ("success", "error", F.col("location.country").alias("located")), every=True)
    return rows.select("receipt_id", "success", "error", F.col("located").alias("country"), F.when(F.col("success"), F.col("store_name")).alias("store_name"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS receipt_id, CASE WHEN o_orderkey % 9 = 6 THEN 1250 ELSE o_orderkey % 7 END AS quantity FROM orders WHERE o_orderkey % 9 NOT IN (4, 5, 7)")
def item_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.items_from(structure.parse_documents(X.odd_documents(spark, sf_dir))).select("receipt_id", F.col("quantity").cast("long").alias("quantity"))


@query(f"""
SELECT receipt_id, n_words AS quantity FROM (SELECT o_orderkey AS receipt_id, CASE o_orderkey % 10 WHEN 0 THEN 1234 WHEN 1 THEN 7 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN -2 WHEN 5 THEN 100 WHEN 6 THEN 1 WHEN 7 THEN 0 WHEN 8 THEN 12 ELSE 1 END AS n_words FROM orders)
""".replace("n_words", "q"))
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as they are written: separators, blanks, signs, exponents, and what doesn't read as a number."""
    forms = ["1,234.9", " 7 ", "0.5", "x", "-2.9", "1e2", "5f", ".9", "+12", ""]
    written = F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.coalesce(structure.number(written).cast("int"), F.lit(1)).alias("quantity"))


# ---------------------------------------------------------------- store


@query(f"SELECT r.receipt_id, user_id, CAST(total_amount AS DOUBLE) AS total, count(i.receipt_id) AS n_items, {PAID} FROM {RECEIPTS} r LEFT JOIN {ITEMS} i ON i.receipt_id = r.receipt_id GROUP BY 1, 2, 3")
def receipt_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(store.with_items(X.receipts(spark, sf_dir), X.items(spark, sf_dir)))


def _summed(nested: DataFrame) -> DataFrame:
    paid = F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda a, i: (a + i.price).cast("decimal(28,2)")).cast("double")
    return nested.select("receipt_id", "user_id", F.col("total_amount").cast("double").alias("total"), F.size("items").cast("long").alias("n_items"), paid.alias("paid"))


@query(f"SELECT r.receipt_id, user_id, CAST(total_amount AS DOUBLE) AS total, count(i.receipt_id) AS n_items, {PAID} FROM {RECEIPTS} r LEFT JOIN {ITEMS} i ON i.receipt_id = r.receipt_id WHERE user_id = 'user-7' GROUP BY 1, 2, 3")
def user_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(store.user_receipts(X.receipts(spark, sf_dir), X.items(spark, sf_dir), "user-7"))


@query(f"SELECT r.receipt_id, user_id, CAST(total_amount AS DOUBLE) AS total, count(i.receipt_id) AS n_items, {PAID} FROM {RECEIPTS} r LEFT JOIN {ITEMS} i ON i.receipt_id = r.receipt_id WHERE r.receipt_id = 33 GROUP BY 1, 2, 3")
def receipt_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(store.get_receipt(X.receipts(spark, sf_dir), X.items(spark, sf_dir), 33))


@query(f"SELECT receipt_id, user_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY purchase_date DESC, receipt_id) AS rank FROM {RECEIPTS}) WHERE rank <= 20")
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent_by_user(X.receipts(spark, sf_dir)).select("receipt_id", "user_id", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT receipt_id FROM {RECEIPTS} WHERE user_id = 'user-3' ORDER BY purchase_date DESC, receipt_id LIMIT 20")
def recent_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.recent_of(X.receipts(spark, sf_dir), "user-3").select("receipt_id")


@query(f"SELECT user_id, count(*) AS n FROM {RECEIPTS} GROUP BY 1")
def receipts_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.receipts(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"SELECT receipt_id, store_name FROM {RECEIPTS} WHERE contains(store_name, '05')")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_search(X.receipts(spark, sf_dir), "05").select("receipt_id", "store_name")


@query(f"SELECT receipt_id FROM {RECEIPTS} WHERE purchase_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.date_range(X.receipts(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")).select("receipt_id")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS receipt_id FROM orders WHERE o_orderkey % 12 = 11")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.document_contains(X.documents_json(spark, sf_dir), "doc_type", "invoice").select("receipt_id")


@query(f"SELECT receipt_id FROM {RECEIPTS} WHERE status = 2")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_status(X.receipts(spark, sf_dir), 2).select("receipt_id")


@query(f"SELECT receipt_id, quantity, CAST(price AS DOUBLE) AS price FROM {ITEMS} WHERE name = (SELECT min(p_name) FROM part)")
def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = X.table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]
    return store.items_named(X.items(spark, sf_dir), name).select("receipt_id", "quantity", F.col("price").cast("double").alias("price"))


@query(f"""
SELECT (SELECT count(*) FROM {RECEIPTS} WHERE receipt_id % 10 <> 0) AS receipts, (SELECT count(*) FROM {ITEMS} WHERE receipt_id % 10 <> 0 OR receipt_id NOT IN (SELECT o_orderkey FROM orders)) AS items,
  (SELECT count(*) FROM {RECEIPTS} WHERE receipt_id % 10 = 0) AS found
""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = X.receipts(spark, sf_dir)
    ids = receipts.where(F.col("receipt_id") % 10 == 0).select("receipt_id").union(spark.range(1).select(F.lit(-5).cast("long")))
    kept, items, found = store.delete(receipts, X.items(spark, sf_dir), ids)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(kept, "receipts").crossJoin(count(items, "items")).crossJoin(count(found, "found"))  # three single rows


@query(f"""
SELECT receipt_id, CASE WHEN receipt_id % 4 = 0 THEN 'renamed' ELSE store_name END AS store_name, receipt_id % 4 = 0 AS updated FROM {RECEIPTS}
UNION ALL SELECT -1 - receipt_id, 'renamed', true FROM {RECEIPTS} WHERE receipt_id % 4 = 0
""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = X.receipts(spark, sf_dir)
    old = base.where(F.col("receipt_id") % 4 == 0).withColumn("store_name", F.lit("renamed"))
    new = old.withColumn("receipt_id", -1 - F.col("receipt_id"))
    out = store.upsert(base, old.unionByName(new), F.lit(X.INGESTED).cast("timestamp"))
    return out.select("receipt_id", "store_name", F.col("updated_at").isNotNull().alias("updated"))


@query(f"SELECT receipt_id FROM {RECEIPTS} WHERE created_at >= TIMESTAMP '2000-12-31' - INTERVAL 365 DAY".replace("created_at", "purchase_date"))
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.unexpired(X.receipts(spark, sf_dir), "created_at", F.lit("2000-12-31").cast("date"), 365).select("receipt_id")


@query(f"SELECT receipt_id, user_id, store_name, CAST(total_amount AS DOUBLE) AS total, (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id = r.receipt_id) AS n_items FROM {RECEIPTS} r")
def receipt_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = store.receipt_view(X.receipts(spark, sf_dir), X.items(spark, sf_dir))
    return view.select("receipt_id", "user_id", "store_name", F.col("total_amount").cast("double").alias("total"), F.size("items").cast("long").alias("n_items"))


@query("SELECT o_orderkey AS receipt_id, 'users/user-' || o_custkey || '/receipts/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || o_orderkey || '/original.jpg' AS object_key, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = landing.object_key(F.col("user_id"), F.col("created_at"), F.col("receipt_id").cast("string"), F.lit("original.jpg"))
    rows = X.receipts(spark, sf_dir).select("receipt_id", key.alias("object_key"))
    return rows.select("receipt_id", "object_key", landing.key_parts(F.col("object_key"))["day"].cast("string").alias("day"))


@query("""SELECT '{"receiptId":' || o_orderkey || ',"userId":"user-' || o_custkey || '","status":' || o_orderkey % 3 || '}' AS json FROM orders""")
def api_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.api_json(X.receipts(spark, sf_dir), ["receipt_id", "user_id", "status", "updated_at"])


@query(f"SELECT CAST(r.receipt_id AS VARCHAR) AS receipt_id, strftime(purchase_date, '%Y-%m-%d') AS day, CAST(total_amount AS DOUBLE) AS total FROM {RECEIPTS} r WHERE receipt_id % 12 <> 10 AND receipt_id % 12 <> 7 AND receipt_id % 12 <> 8")
def raw_zone_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as JSON under day folders, read back and parsed."""
    path = scratch(spark, "raw-zone")
    rows = X.documents_json(spark, sf_dir)
    landing.write_by_day(rows, path, "ingest_ts")
    back = landing.read_by_day(spark, path, "receipt_id string, user_id string, file_name string, ingest_ts timestamp, json string")
    found = structure.receipts_from(structure.parse_documents(back)).where((F.col("receipt_id").cast("long") % 12).isin(7, 8) == F.lit(False))
    return found.select("receipt_id", F.date_format("purchase_date", "yyyy-MM-dd").alias("day"), F.col("total_amount").cast("double").alias("total"))


@query("SELECT CAST(page_id % 50 AS INTEGER) AS folder, CAST(sum(strlen(html) + 1) AS BIGINT) AS bytes, 'text/html' AS content_type FROM pages GROUP BY 1, 3")
def landing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages land as files, and are scanned with a manifest of what their senders said they are."""
    path = scratch(spark, "landed")
    X.table(spark, sf_dir, "pages").select((F.col("page_id") % 50).cast("int").alias("folder"), "html").repartition("folder").write.partitionBy("folder").text(path)
    names = landing.landing_scan(spark, path).select("file_name", F.lit("text/html").alias("content_type")).distinct()
    found = landing.landing_scan(spark, path, names).withColumn("folder", F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("int"))
    return found.groupBy("folder", "content_type").agg(F.sum("length").alias("bytes"))


@query("""
SELECT folder, n AS file_size, CASE WHEN n < 1024 THEN 'File size (' || n || ' bytes) is too small to be a valid receipt' WHEN n > 10485760 THEN 'File size (' || n // 1048576 || 'MB) exceeds maximum allowed size (10MB)'
  ELSE 'File signature does not match any supported image format (JPEG, PNG, TIFF). The file may be corrupted or have the wrong extension.' END AS error_message, CASE WHEN n BETWEEN 1024 AND 10485760 THEN 8 ELSE 0 END AS fetched
FROM (SELECT CAST(page_id % 40 AS INTEGER) AS folder, CAST(sum(strlen(html) + 1) AS BIGINT) AS n FROM pages GROUP BY 1)
""")
def header_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages land as files and are screened by their lengths and first bytes alone."""
    path = scratch(spark, "headers")
    X.table(spark, sf_dir, "pages").select((F.col("page_id") % 40).cast("int").alias("folder"), "html").repartition("folder").write.partitionBy("folder").text(path)
    files = landing.header_scan(spark, path).withColumns({"content_type": F.lit("image/png"), "folder": F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("int")})
    return checks.screen_files(files).select("folder", "file_size", "error_message", F.coalesce(F.octet_length("content"), F.lit(0)).alias("fetched"))


@query(f"SELECT r.receipt_id, user_id, CAST(total_amount AS DOUBLE) AS total, count(i.receipt_id) AS n_items, {PAID} FROM {RECEIPTS} r LEFT JOIN {ITEMS} i ON i.receipt_id = r.receipt_id GROUP BY 1, 2, 3")
def extracted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with nested items are written as JSON under day folders and read back."""
    path, receipts, items = scratch(spark, "extracted"), X.receipts(spark, sf_dir), X.items(spark, sf_dir)
    receipts = receipts.withColumn("landed", F.date_trunc("month", "purchase_date"))  # a folder a month, as these receipts spread over thousands of days
    landing.write_extracted(receipts, items, path, "landed")
    shape = store.with_items(receipts.limit(0), items.limit(0)).schema
    return _summed(landing.read_by_day(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape)))


@query(f"SELECT (SELECT count(*) FROM {RECEIPTS}) AS receipts, (SELECT count(*) FROM {ITEMS}) AS items, (SELECT count(*) FROM {RECEIPTS} WHERE receipt_id % 13 = 0) AS rejected, 2 AS version".replace("(SELECT count(*) FROM {ITEMS}) AS items".format(ITEMS=ITEMS), f"(SELECT count(*) FROM {ITEMS} WHERE receipt_id % 13 <> 0 AND receipt_id IN (SELECT o_orderkey FROM orders)) AS items").replace(f"SELECT (SELECT count(*) FROM {RECEIPTS}) AS receipts", f"SELECT (SELECT count(*) FROM {RECEIPTS} WHERE receipt_id % 13 <> 0) AS receipts"))
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts are created in two appends, each with its items in one unit; those that break the contract stay out with their items."""
    root, id_ = scratch(spark, "appended"), F.col("receipt_id")
    receipts = X.zoned(spark, sf_dir).withColumn("user_id", F.when(id_ % 13 != 0, F.col("user_id")))
    items = X.items(spark, sf_dir).withColumn("created_at", F.lit(X.INGESTED).cast("timestamp")).join(receipts.select("receipt_id"), "receipt_id", "left_semi")
    out = [versions.create(spark, root, receipts.where(id_ % 2 == k), items.where(id_ % 2 == k), period="yyyy") for k in (0, 1)]
    stored, kept = versions.load(spark, root)
    bad = out[0][1].union(out[1][1])
    return stored.agg(F.count("*").alias("receipts")).crossJoin(kept.agg(F.count("*").alias("items"))).crossJoin(bad.agg(F.count("*").alias("rejected"))).withColumn("version", F.lit(out[1][0]))  # single rows


@query(f"""
SELECT (SELECT count(*) FROM {RECEIPTS} WHERE receipt_id % 10 <> 0) AS receipts, (SELECT count(*) FROM {ITEMS} WHERE receipt_id % 10 <> 0 OR receipt_id NOT IN (SELECT o_orderkey FROM orders)) AS items, 2 AS version
""")
def versioned_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables are saved, receipts are deleted, and the next version is read through the pointer."""
    root = scratch(spark, "store")
    versions.save(spark, root, X.receipts(spark, sf_dir), X.items(spark, sf_dir), period="yyyy")
    receipts, items = versions.load(spark, root)
    kept, left, _ = store.delete(receipts, items, receipts.where(F.col("receipt_id") % 10 == 0))
    version = versions.save(spark, root, kept, left)
    receipts, items = versions.load(spark, root)
    return receipts.agg(F.count("*").alias("receipts")).crossJoin(items.agg(F.count("*").alias("items"))).withColumn("version", F.lit(version))


@query(f"""
SELECT 'stored' AS place, r.receipt_id, r.store_name, (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id = r.receipt_id) + (r.receipt_id % 5 = 0)::BIGINT AS n_items FROM {RECEIPTS} r
UNION ALL SELECT 'receipt_id: already stored', receipt_id, NULL, NULL FROM {RECEIPTS} WHERE receipt_id % 5 = 0 UNION ALL SELECT 'item receipt_id: no such receipt', -receipt_id, NULL, NULL FROM {RECEIPTS} WHERE receipt_id % 5 = 0 AND receipt_id > 0
""")
def store_create_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All receipts are created; then some come again with another name, beside an item more for each of them, which comes twice, and items of receipts that don't exist."""
    root, id_ = scratch(spark, "created"), F.col("receipt_id")
    receipts, items = X.receipts(spark, sf_dir), X.items(spark, sf_dir).withColumn("created_at", F.lit(X.INGESTED).cast("timestamp"))
    versions.create(spark, root, receipts, items, period="yyyy")
    again = receipts.where(id_ % 5 == 0)
    more = again.select(F.concat(F.lit("more-"), id_.cast("string")).alias("item_id"), "receipt_id", F.lit("bag").alias("name"), F.lit(1).cast("decimal(18,2)").alias("price"), F.lit(1).alias("quantity"), F.lit(X.INGESTED).cast("timestamp").alias("created_at"))
    _, turned = versions.create(spark, root, again.withColumn("store_name", F.lit("Again")), items.join(again.select("receipt_id"), "receipt_id", "left_semi").select(more.columns))
    for _ in range(2):
        _, lost = versions.create(spark, root, receipts.limit(0), more.unionByName(more.where(id_ > 0).withColumns({"receipt_id": -id_})))
    stored, kept = versions.load(spark, root)
    counts = kept.groupBy("receipt_id").agg(F.count("*").alias("n"))
    rows = stored.join(counts, "receipt_id", "left").select(F.lit("stored").alias("place"), "receipt_id", "store_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))
    return rows.union(turned.union(lost).select(F.explode("violations"), "receipt_id", F.lit(None).cast("string"), F.lit(None).cast("long")))


@query(f"""
SELECT 'id' AS lookup, r.receipt_id, (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id = r.receipt_id) AS n FROM {RECEIPTS} r WHERE r.receipt_id = 33
UNION ALL SELECT 'user', r.receipt_id, (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id = r.receipt_id) FROM {RECEIPTS} r WHERE user_id = 'user-7'
UNION ALL SELECT 'item', receipt_id, count(*) FROM {ITEMS} WHERE name = (SELECT min(p_name) FROM part) GROUP BY 2
""")
def store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts by id and by user, and items by name, from a store: one bucket for an id, Bloom filters for the others."""
    root = scratch(spark, "looked-up")
    versions.save(spark, root, X.receipts(spark, sf_dir), X.items(spark, sf_dir), period="yyyy")
    receipts, items = versions.load(spark, root)
    name = X.table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]
    sized = lambda df, how: df.select(F.lit(how).alias("lookup"), "receipt_id", F.size("items").cast("long").alias("n"))
    named = store.items_named(items, name).groupBy("receipt_id").agg(F.count("*").alias("n")).select(F.lit("item"), "receipt_id", "n")
    return sized(store.get_receipt(receipts, items, 33), "id").union(sized(store.user_receipts(receipts, items, "user-7"), "user")).union(named)


@query(f"""
SELECT receipt_id, CASE WHEN receipt_id % 40 = 0 THEN 'second' ELSE store_name END AS store_name, receipt_id % 40 = 0 AS updated, (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id = r.receipt_id) AS n_items FROM {RECEIPTS} r WHERE receipt_id % 40 <> 7
UNION ALL SELECT -1 - receipt_id, 'second', true, 0 FROM {RECEIPTS} WHERE receipt_id % 40 = 0
""")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored receipts are changed twice in one batch, others are new, and some are deleted with their items."""
    root, id_ = scratch(spark, "changed"), F.col("receipt_id")
    receipts = X.receipts(spark, sf_dir)
    versions.save(spark, root, receipts, X.items(spark, sf_dir), period="yyyy")
    some = receipts.where(id_ % 40 == 0)
    some = some.unionByName(some.withColumn("receipt_id", -1 - id_))
    at = lambda name, day: some.withColumns({"store_name": F.lit(name), "updated_at": F.lit(day).cast("timestamp")})
    versions.update(spark, root, at("second", "2024-02-02").unionByName(at("first", "2024-02-01")), F.lit(X.INGESTED).cast("timestamp"))
    versions.remove(spark, root, receipts.where(id_ % 40 == 7))
    rows, items = versions.load(spark, root)
    return store.with_items(rows, items).select("receipt_id", "store_name", F.col("updated_at").isNotNull().alias("updated"), F.size("items").cast("long").alias("n_items"))


@query(f"SELECT year(purchase_date) AS year, count(*) AS receipts, CAST(sum(n) AS BIGINT) AS items, true AS few FROM (SELECT *, (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id = r.receipt_id) AS n FROM {RECEIPTS} r) WHERE year(purchase_date) >= 1998 GROUP BY 1")
def store_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends pile up and are merged by size, old years expire, and what no version names is deleted."""
    root, id_ = scratch(spark, "upkeep"), F.col("receipt_id")
    receipts, items = X.receipts(spark, sf_dir), X.items(spark, sf_dir)
    for k in range(4):
        versions.append(spark, root, receipts.where(id_ % 4 == k), items.where(id_ % 4 == k), fan=3, period="yyyy")
    versions.expire(spark, root, "1998")
    versions.vacuum(spark, root, older_than=0)
    rows, kept = versions.load(spark, root)
    few = max(sum(e["table"] == "receipts" and e["period"] == p for e in versions.folders(spark, root)) for p in ("1998", "1999", "2000")) <= 3
    return store.with_items(rows, kept).groupBy(F.year("created_at").cast("long").alias("year")).agg(F.count("*").alias("receipts"), F.sum(F.size("items")).cast("long").alias("items")).withColumn("few", F.lit(few))


def _writers(spark: SparkSession, sf_dir: str, least: int) -> int:
    """Files that a landing is written to side by side: `least`, or more for more orders than these hold."""
    return max(least, math.ceil(X.table(spark, sf_dir, "orders").count() / (0.9 * LANDED)))


def _land(docs: DataFrame, sf_dir: str, path: str, *more: str) -> None:
    """Documents as files that a stream takes in: four, or more for more orders than these hold, written side by side; in small row groups, so that all cores read the few files of a micro-batch."""
    docs.repartition(_writers(docs.sparkSession, sf_dir, 4), "receipt_id", *more).write.options(**{"maxRecordsPerFile": LANDED, "parquet.block.size": ROW_GROUP}).parquet(path)


@query(f"""
SELECT CAST(r.receipt_id AS VARCHAR) AS receipt_id, CASE WHEN r.receipt_id % 12 = 7 THEN 1234.5 ELSE CAST(total_amount AS DOUBLE) END AS total,
  (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id = r.receipt_id AND r.receipt_id % 12 <> 9) AS n_items FROM {RECEIPTS} r WHERE r.receipt_id % 12 <> 10
""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw documents land as files, some twice, and a stream takes them in; receipts with the number of their items."""
    source, root = scratch(spark, "landing"), scratch(spark, "ingested")
    _land(X.documents_json(spark, sf_dir), sf_dir, source)
    spark.read.parquet(source).where(F.col("receipt_id").cast("long") % 50 == 0).repartition(1).write.mode("append").parquet(source)
    ingest_stream(spark, source, root, files=3).awaitTermination()
    receipts, items = versions.load(spark, root)
    return receipts.join(items.groupBy("receipt_id").agg(F.count("*").alias("n")), "receipt_id", "left").select("receipt_id", F.col("total_amount").cast("double").alias("total"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"))


def _workflow(spark: SparkSession, sf_dir: str) -> str:
    """A store into which a stream has taken documents and their readings; some of both came twice, documents also dated 60 days later."""
    source, readings, root = scratch(spark, "landing"), scratch(spark, "readings"), scratch(spark, "workflow")
    _land(X.documents_json(spark, sf_dir), sf_dir, source)
    spark.read.parquet(source).where(F.col("receipt_id").cast("long") % 50 == 0).withColumn("ingest_ts", F.col("ingest_ts") + F.expr("interval 60 days")).repartition(1).write.mode("append").parquet(source)
    X.readings(spark, sf_dir).repartition(_writers(spark, sf_dir, 2), "receipt_id").write.option("maxRecordsPerFile", LANDED).parquet(readings)  # three of each
    ingest_stream(spark, source, root, readings=readings, files=3).awaitTermination()
    return root


@query(f"""
SELECT CAST(r.receipt_id AS VARCHAR) AS receipt_id, coalesce(CASE WHEN w.score > 0 THEN w.store_name END, r.store_name) AS store_name, CASE WHEN w.score > 0 THEN w.postal_code END AS postal_code, CASE WHEN w.score > 0 THEN w.country END AS country,
  CASE WHEN w.score > 0 THEN w.confidence END AS location_confidence, CASE WHEN w.score > 0 THEN w.strategy END AS ocr_strategy, (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id = r.receipt_id AND r.receipt_id % 12 <> 9) AS n_items
FROM {RECEIPTS} r JOIN (SELECT * FROM {READINGS} WHERE rn = 1) w ON w.receipt_id = r.receipt_id WHERE r.receipt_id % 12 <> 10
""")
def stream_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole upload workflow as a stream: documents meet their readings, the best one is laid over the document, and what comes of it is stored once."""
    receipts, items = versions.load(spark, _workflow(spark, sf_dir))
    return store.with_items(receipts, items).select("receipt_id", "store_name", "postal_code", "country", "location_confidence", "ocr_strategy", F.size("items").cast("long").alias("n_items"))


@query(f"""
SELECT count(*) AS receipts, round(CAST(sum(CASE WHEN receipt_id % 12 = 7 THEN 1234.5 ELSE total_amount END) AS DOUBLE), 2) AS total, count(*) FILTER (receipt_id % 12 <> 11) AS valid, count(*) FILTER (receipt_id % 12 = 11) AS invalid,
  (SELECT count(*) FROM {ITEMS} i WHERE i.receipt_id IN (SELECT o_orderkey FROM orders) AND i.receipt_id % 12 NOT IN (9, 10)) AS items, (SELECT count(*) FROM orders WHERE o_orderkey % 12 = 10) AS quarantined FROM {RECEIPTS} WHERE receipt_id % 12 <> 10
""")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that a stream's batches leave, summed."""
    source, root = scratch(spark, "landing"), scratch(spark, "measured")
    _land(X.documents_json(spark, sf_dir), sf_dir, source)
    ingest_stream(spark, source, root, files=2).awaitTermination()
    total = lambda c: F.sum(c).cast("long").alias(c)
    return ingest.metrics(spark, root).agg(total("receipts"), F.round(F.sum("total"), 2).alias("total"), *map(total, ("valid", "invalid", "items", "quarantined")))


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS receipt_id, 'receipts' AS place, NULL AS error, CASE WHEN o_orderkey % 9 = 6 THEN 1250 WHEN o_orderkey % 9 <> 5 THEN o_orderkey % 7 END AS quantity FROM orders WHERE o_orderkey % 9 NOT IN (1, 2, 3, 4, 7)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'quarantine', CASE o_orderkey % 9 WHEN 1 THEN 'store_name: longer than 200' WHEN 2 THEN 'item name: longer than 300' WHEN 3 THEN 'user_id: required' WHEN 7 THEN 'No receipt data found' ELSE 'Corrupt document' END, NULL
  FROM orders WHERE o_orderkey % 9 IN (1, 2, 3, 4, 7, 8)
""")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of odd documents: what is corrupt or breaks the contract goes to quarantine with the reason, whole; of a broken and a good copy the good one is stored."""
    source, root = scratch(spark, "odd-landing"), scratch(spark, "odd-ingested")
    _land(X.odd_documents(spark, sf_dir, copies=True), sf_dir, source, "json")
    ingest_stream(spark, source, root, files=2).awaitTermination()
    receipts, items = versions.load(spark, root)
    quantity = items.select("receipt_id", F.col("quantity").cast("long").alias("quantity"))
    stored = receipts.join(quantity, "receipt_id", "left").select("receipt_id", F.lit("receipts").alias("place"), F.lit(None).cast("string").alias("error"), "quantity")
    return stored.union(ingest.quarantined(spark, root).select("receipt_id", F.lit("quarantine"), "error", F.lit(None).cast("long")))


@query(f"SELECT count(*) AS receipts, CAST(sum(total_amount) AS DOUBLE) AS total, sum((status = 1)::BIGINT)::BIGINT AS valid, sum((status = 2)::BIGINT)::BIGINT AS invalid, round(avg(validation_confidence::DOUBLE), 6) AS confidence FROM {RECEIPTS}")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run that writes receipts observes while it writes."""
    rows, seen = analytics.observed_run(X.receipts(spark, sf_dir))
    rows.write.parquet(scratch(spark, "run"))
    m = seen.get
    return spark.createDataFrame([(m["receipts"], m["total"], m["valid"], m["invalid"], round(m["confidence"], 6))], "receipts long, total double, valid long, invalid long, confidence double")


@query(f"SELECT user_id, count(*) AS n, (SELECT count(*) FROM {RECEIPTS} WHERE purchase_date >= TIMESTAMP '1998-01-01') AS of_all FROM {RECEIPTS} WHERE purchase_date >= TIMESTAMP '1998-01-01' GROUP BY 1")
def hot_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent receipts are held in memory while two queries read them."""
    path = scratch(spark, "hot")
    with store.hot(X.receipts(spark, sf_dir), X.items(spark, sf_dir), F.lit("1998-01-01").cast("timestamp")) as held:
        n = held.count()
        held.groupBy("user_id").agg(F.count("*").alias("n")).write.parquet(path)
    return spark.read.parquet(path).withColumn("of_all", F.lit(n))


# ---------------------------------------------------------------- extensions


@query(f"""
SELECT name, store_name, CAST(min(price) AS DOUBLE) AS min_price, count(*) AS n, CAST(rank() OVER (PARTITION BY name ORDER BY min(price)) AS BIGINT) AS rank
FROM {ITEMS} i JOIN {RECEIPTS} r ON r.receipt_id = i.receipt_id GROUP BY name, store_name
""")
def price_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.price_comparison(X.receipts(spark, sf_dir), X.items(spark, sf_dir))
    return rows.select("name", "store_name", F.col("min_price").cast("double").alias("min_price"), "n", F.col("rank").cast("long").alias("rank"))


@query(f"""
SELECT user_id, month, CAST(spent AS DOUBLE) AS spent, n, CAST(spent - lag(spent) OVER (PARTITION BY user_id ORDER BY month) AS DOUBLE) AS change
FROM (SELECT user_id, strftime(purchase_date, '%Y-%m-01') AS month, sum(total_amount) AS spent, count(*) AS n FROM {RECEIPTS} GROUP BY 1, 2)
""")
def spend_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.spending_trend(X.receipts(spark, sf_dir)).select("user_id", F.col("month").cast("string").alias("month"), F.col("spent").cast("double").alias("spent"), "n", F.col("change").cast("double").alias("change"))


@query(f"""
SELECT status, store_name, n, total, mean, median, CAST(rank() OVER (PARTITION BY status ORDER BY total DESC) AS BIGINT) AS rank FROM (
  SELECT status, store_name, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) AS total, round(avg(CAST(total_amount AS DOUBLE)), 4) AS mean, CAST(quantile_disc(total_amount, 0.5) AS DOUBLE) AS median FROM {RECEIPTS} GROUP BY 1, 2)
""")
def store_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.store_comparison(X.receipts(spark, sf_dir), within="status")
    mean = F.round(F.col("mean") * 10000) / 10000  # as SQL rounds a double: not by its shortest decimal form
    return rows.select("status", "store_name", "n", F.col("total").cast("double").alias("total"), mean.alias("mean"), F.col("median").cast("double").alias("median"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH RECURSIVE a AS (SELECT receipt_id * 4 AS receipt_id, user_id, lower(store_name) AS name, CAST(purchase_date AS DATE) AS d, total_amount FROM {RECEIPTS}
  UNION ALL SELECT receipt_id * 4 + 1, user_id, 'elsewhere', CAST(purchase_date AS DATE), total_amount FROM {RECEIPTS} WHERE receipt_id % 5 = 0
  UNION ALL SELECT receipt_id * 4 + 2, user_id, lower(store_name) || CASE WHEN receipt_id % 2 = 0 THEN 'x' ELSE 'xyz' END, CAST(purchase_date AS DATE) + 1, total_amount FROM {RECEIPTS} WHERE receipt_id % 5 = 0
  UNION ALL SELECT receipt_id * 4 + 3, user_id, 's' || lower(store_name) || 'y', CAST(purchase_date AS DATE) + 2, total_amount FROM {RECEIPTS} WHERE receipt_id % 5 = 0),
l AS (SELECT a.receipt_id AS x, b.receipt_id AS y FROM a JOIN a b ON a.user_id = b.user_id AND a.total_amount = b.total_amount AND a.receipt_id <> b.receipt_id AND abs(date_diff('day', a.d, b.d)) <= 1 AND levenshtein(a.name, b.name) <= 2),
r AS (SELECT x AS n, x AS g FROM l UNION SELECT l.y, r.g FROM r JOIN l ON l.x = r.n WHERE r.g < l.y)
SELECT n AS receipt_id, min(g) AS group_id FROM r GROUP BY 1
""")
def near_dup_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts, some of them again on the days after under like names, with another store's receipt of that total in between; the SQL compares all pairs."""
    id_, k = F.col("receipt_id"), F.col("k")
    rows = X.receipts(spark, sf_dir).withColumn("k", F.explode(F.when(id_ % 5 == 0, F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))))
    second, third = F.concat("store_name", F.when(id_ % 2 == 0, "x").otherwise("xyz")), F.concat(F.lit("s"), "store_name", F.lit("y"))
    name = F.when(k == 1, "Elsewhere").when(k == 2, second).when(k == 3, third).otherwise(F.col("store_name"))
    date = F.col("purchase_date") + F.make_dt_interval(F.greatest(k - 1, F.lit(0)))
    return analytics.near_duplicate_receipts(rows.withColumns({"receipt_id": id_ * 4 + k, "store_name": name, "purchase_date": date}))


@query(f"""
SELECT receipt_id, original_id, copies FROM (SELECT receipt_id, min(receipt_id) OVER w AS original_id, count(*) OVER w AS copies
  FROM (SELECT receipt_id // 2 AS receipt_id, user_id, store_name, purchase_date, total_amount FROM {RECEIPTS}
    UNION ALL SELECT -receipt_id, user_id, store_name, purchase_date, total_amount FROM {RECEIPTS} WHERE receipt_id % 7 = 0)
  WINDOW w AS (PARTITION BY user_id, store_name, CAST(purchase_date AS DATE), total_amount)) WHERE copies > 1
""".replace("receipt_id // 2 AS receipt_id", "receipt_id"))
def dup_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.receipts(spark, sf_dir)
    again = rows.where(F.col("receipt_id") % 7 == 0).withColumn("receipt_id", -F.col("receipt_id"))
    return analytics.duplicate_receipts(rows.unionByName(again))


@query(f"SELECT receipt_id, validation_confidence::DOUBLE AS sureness FROM {RECEIPTS} WHERE validation_confidence < 0.7")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.review_queue(X.receipts(spark, sf_dir)).select("receipt_id", "sureness")


@query(f"""
WITH n AS (SELECT DISTINCT lower(store_name) AS name FROM {RECEIPTS} WHERE store_name <> ''), c AS (SELECT DISTINCT s_name AS chain, lower(s_name) AS low FROM supplier WHERE s_suppkey % 5 = 0),
b AS (SELECT name, chain, levenshtein(name, low) AS edits, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, low), chain) AS rn FROM n, c WHERE levenshtein(name, low) <= 2)
SELECT receipt_id, r.store_name, chain, CAST(edits AS INTEGER) AS edits FROM {RECEIPTS} r LEFT JOIN b ON b.name = lower(r.store_name) AND rn = 1
""")
def chain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = X.table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 5 == 0).select(F.col("s_name").alias("chain"))
    return analytics.chain_match(X.receipts(spark, sf_dir), chains)


@query("SELECT o_orderkey AS receipt_id, CASE WHEN o_orderkey % 2 = 0 THEN 'MY' || (100000000 + o_orderkey) END AS tax_number, CASE WHEN o_orderkey % 3 = 0 THEN '9am - 10pm' END AS opening_hours FROM orders")
def tax_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(F.lit("SHOP\n"), F.when(key % 2 == 0, F.concat(F.lit("GST No: MY"), (key + 100000000).cast("string"), F.lit("\n"))).otherwise(""), F.when(key % 3 == 0, "Open 9am - 10pm daily").otherwise("Open daily"))
    return analytics.tax_and_hours(X.table(spark, sf_dir, "orders").select(key.alias("receipt_id"), text.alias("text"))).select("receipt_id", "tax_number", "opening_hours")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which countries can be read from receipt texts, and how surely."""
    return locations_by_country(spark, sf_dir)
