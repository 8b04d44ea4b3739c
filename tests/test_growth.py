import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from test_duplicates import FORM, frame, plain_groups
from test_ingest import document, raw, readings
from tillroll.functions import text as T
from tillroll.operators import analytics, candidates, nested, structure, versions
from tillroll.plans import fixtures as X
from tillroll.plans import queries
from tillroll.plans.fixtures import CASES
from tillroll.sources import landing
from tillroll.streaming import ingest


def moved(spark, act):
    """How many rows the stages of act() write to shuffles."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    listed = lambda: store.stageList(None, False, False, gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    total = lambda: sum((s := listed().apply(i)).shuffleWriteRecords() for i in range(listed().size()))
    before = total()
    act()
    return total() - before


def test_small_groups_meet_without_pieces_of_names(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, f"u{i // 4}", Decimal("1.00"), day + datetime.timedelta(days=i % 4), f"some store {i // 4}{'x' * (i % 4)}") for i in range(2000)]
    df = spark.createDataFrame(rows, FORM).cache()
    assert moved(spark, lambda: analytics.near_duplicate_receipts(df)) < 40 * df.count()


def test_large_groups_against_all_pairs(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, "u", "1.00", day + datetime.timedelta(days=i * 7 % 30), ["", "a", "ab", f"Shop#{i % 97:06d}", f"Shop{i % 13}"][i % 5]) for i in range(150)]
    for few in (1, 32, 1000):
        assert sorted(map(tuple, analytics.near_duplicate_receipts(frame(spark, rows), few=few).collect())) == plain_groups(rows)


def test_names_that_begin_alike_meet_few_others(spark):
    names = spark.range(2000).select(F.format_string("supplier#%09d", F.col("id") * 37).alias("name"))
    keys = names.withColumn("key", F.explode(analytics.name_keys(F.col("name"), 1)))
    assert keys.join(keys.withColumnRenamed("name", "other"), "key").count() < 60 * names.count()


def test_an_entry_is_looked_into_once_a_level(spark):
    items = nested.entries(F.try_variant_get(F.try_parse_json(F.lit("{}")), "$", "variant"))
    assert spark.range(1).select(items.alias("x"))._jdf.queryExecution().analyzed().toString().count("variant_get") < 80


def test_dates_are_tried_only_where_marks_fit(spark):
    plan = spark.createDataFrame([("1998-02-06",)], "v string").select(structure.date_of(F.col("v")).alias("d"))
    assert plan.first().d == datetime.datetime(1998, 2, 6) and plan._jdf.queryExecution().analyzed().toString().lower().count("contains") >= 9


def test_a_text_is_lowered_once_and_only_matches_are_worked_on(spark):
    text = F.col("text")
    plan = spark.createDataFrame([("Shop\nS 123456",)], "text string").select(T.country(text).alias("c"), T.store_name(T.lines_of(text)).alias("s"))
    assert plan._jdf.queryExecution().analyzed().toString().count("lower(") <= 2 and tuple(plan.first()) == (None, "Shop")


def test_white_space_at_ends_is_that_of_the_pattern(spark):
    char = F.when(~F.col("id").between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    ends = spark.range(0x110000).select("id", F.concat(char, F.lit("a"), char, F.lit("b"), char).alias("t")).where("t is not null")
    by_pattern = F.regexp_replace("t", r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")
    assert ends.where(T.stripped(F.col("t")) != by_pattern).count() == 0 and ends.where(T.stripped(F.col("t")) != F.col("t")).count() == len(T.WHITE)


def test_patterns_look_at_their_first_character_where_they_have_one():
    assert T.led(r"\b[5-9]\d{4}\b") == r"(?=[5-9])(?:\b[5-9]\d{4}\b)" and T.led(r"\+65|^65[-\s]") == r"(?=[\+6])(?:\+65|^65[-\s])"
    assert all(T.led(p) == p for p in (r"\bS?a", "ab|c*d", "(?:a|b)c", "[^a]b", "a{0,2}b", ""))


def test_extracted_receipts_are_written_compressed(spark, tmp_path):
    receipts = spark.sql("select 'a' as receipt_id, 'u' as user_id, timestamp'2024-01-02 00:00:00' as created_at")
    landing.write_extracted(receipts, spark.sql("select 'i' as item_id, 'a' as receipt_id, 'x' as name"), str(tmp_path / "out"))
    assert [f.name.endswith(".json.gz") for f in tmp_path.rglob("part-*")] == [True]


def test_document_errors_reads_its_documents_once(spark):
    plan = queries.document_errors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_a_batch_is_dealt_out_once_with_its_items_nested(spark, tmp_path):
    batch = raw(spark, [(str(k), "2024-03-05", document(f"Shop {k}", *range(20))) for k in range(100)])
    assert moved(spark, lambda: ingest.ingest_batch(batch, str(tmp_path), 0, known=False, copies=False)) < 1000  # 2,000 items
    assert spark.read.parquet(str(tmp_path / "items")).count() == 2000


def test_rows_of_a_batch_are_made_in_one_pass(spark):
    docs = structure.parse_documents(raw(spark, [("a", "2024-03-05", document("Shop", 1)), ("b", "2024-03-05", "{broken"), (None, "2024-03-05", document("None", 1)), ("c", "2024-03-05", document("x" * 201, 1)), ("d", "2024-03-05", document("Shop"))]))
    rows = ingest.rows_of(docs.withColumn("_k", ingest.read_key()))
    assert "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = {r.receipt_id: (r.violations, r.json is None, r["items"] and len(r["items"])) for r in rows.collect()}
    assert found == {"a": ([], True, 1), "b": ([structure.CORRUPT], False, None), None: ([ingest.NO_ID], False, None), "c": (["store_name: longer than 200"], False, 1), "d": ([], True, found["d"][2])} and not found["d"][2]


def test_only_short_documents_are_lowered_to_see_if_there_is_one(spark):
    docs = structure.parse_documents(spark.createDataFrame([("",), (" NULL ",), ("null",), ("nulls",), (None,), ('{"doc_type":"x"}',), ("  ",)], "json string"))
    assert [r.error for r in docs.collect()] == [structure.NO_DATA] * 3 + [structure.CORRUPT, structure.NO_DATA, None, structure.NO_DATA]
    assert "octet_length" in docs._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_go_to_day_folders_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda i: made.add(1) or f"u{i % 7}", "string").asNondeterministic()
    rows = spark.range(40).select("id", count("id").alias("user_id"), F.expr("timestamp'2024-03-05 00:00:00' + make_dt_interval(id % 3)").alias("ts"))
    landing.write_by_day(rows, str(tmp_path / "zone"), "ts")
    assert made.value == 40 and sorted(r.id for r in landing.read_by_day(spark, str(tmp_path / "zone"), "id long, user_id string").collect()) == list(range(40))


def test_a_large_day_has_several_files_by_user_within_each(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "65536")
    try:
        rows = spark.range(0, 20000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("body"), F.format_string("u%d", F.col("id") % 50).alias("user_id"), F.expr("timestamp'2024-03-05 00:00:00' + make_dt_interval(if(id < 10, 1, 0))").alias("ts"))
        landing.write_by_day(rows, str(tmp_path / "zone"), "ts")
    finally:
        spark.conf.set(size, before)
    files = {day: sorted((tmp_path / "zone/yyyy=2024/mm=03" / f"dd={day}").glob("part-*")) for day in ("05", "06")}
    assert len(files["05"]) > 4 and len(files["06"]) == 1
    for file in files["05"]:
        users = [r.user_id for r in spark.read.json(str(file)).select("user_id").collect()]
        assert users == sorted(users)


def test_items_of_a_stream_are_named_behind_its_shuffles(spark, tmp_path):
    batch = raw(spark, [(str(k), "2024-03-05", document(f"Shop {k}", *range(k + 1))) for k in range(5)])
    docs = structure.parse_documents(batch)
    assert all(len(i.item_id) < 64 for r in ingest.rows_of(docs.withColumn("_k", ingest.read_key())).collect() for i in r["items"])
    ingest.ingest_batch(batch, str(tmp_path), 0)
    columns = ["receipt_id", "item_id", "name", "price"]
    assert sorted(versions.load(spark, str(tmp_path))[1].select(columns).collect()) == sorted(structure.items_from(docs).select(columns).collect())


def test_a_best_reading_is_found_where_the_readings_lie(spark):
    texts = [c[0] for c in CASES]
    rows = [(str(k), [("enhanced", texts[k]), ("simple", texts[(k + 5) % 16]), ("high_contrast", None)]) for k in range(16)] + [("none", []), ("blank", [("simple", "..")]), ("tie", [("late", texts[0]), ("later", texts[0])])]
    read = readings(spark, rows).withColumn("readings", F.when(F.col("receipt_id") != "3", F.col("readings")).otherwise(F.transform("readings", lambda r: r.withField("error", F.lit("x")))))
    columns = ["store_name", "address", "phone", "postal_code", "country", "confidence", "strategy_used", "score"]
    best = read.select("receipt_id", candidates.best_reading(F.col("readings")).alias("b")).where("b is not null")
    want = candidates.best_candidates(read.select("receipt_id", F.explode("readings").alias("r")).select("receipt_id", "r.*")).where("success")
    assert sorted(map(str, best.select("receipt_id", *(f"b.{c}" for c in columns)).collect())) == sorted(map(str, want.select("receipt_id", *columns).collect()))
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()


def test_a_batch_with_readings_is_shuffled_no_more_than_one_without(spark, tmp_path):
    batch = raw(spark, [(str(k), "2024-03-05", document(f"Shop {k}", 1)) for k in range(200)])
    read = batch.withColumn("readings", F.array(F.struct(F.lit("simple").alias("strategy"), F.lit(0).alias("strategy_ord"), F.lit(CASES[0][0]).alias("text_a"), F.lit(None).cast("string").alias("text_b"), F.lit(None).cast("string").alias("error"))))
    plain, more = (moved(spark, lambda df=df, n=n: ingest.ingest_batch(df, str(tmp_path / n), 0, known=False, copies=False)) for df, n in ((batch, "plain"), (read, "read")))
    assert more <= plain + 20 and {r.store_name for r in versions.load(spark, str(tmp_path / "read"))[0].collect()} == {"CORNER SHOP"}


def test_the_readings_of_orders_are_their_candidates(spark):
    sf = "/root/testdata/sf0.001"
    flat = X.readings(spark, sf).select("receipt_id", F.explode("readings").alias("r")).select("receipt_id", "r.strategy", "r.strategy_ord", "r.text_a", "r.text_b")
    want = X.candidates(spark, sf).withColumn("receipt_id", F.col("receipt_id").cast("string"))
    assert flat.exceptAll(want).count() == 0 and want.exceptAll(flat).count() == 0
