import json

from pyspark.sql import functions as F

from tillroll.operators import candidates, structure, versions
from tillroll.plans.fixtures import CASES
from tillroll.streaming import ingest

FORM = "receipt_id string, user_id string, file_name string, ts string, json string"


def document(name, *prices):
    items = [{"value_object": {"Description": {"value": f"item {k}"}, "TotalPrice": {"value": str(p)}}} for k, p in enumerate(prices)]
    return json.dumps({"doc_type": "receipt", "confidence": 0.9, "fields": {"MerchantName": {"value": name}, "Total": {"value": str(sum(prices))}, "Items": {"value_array": items}}})


def raw(spark, rows):
    return spark.createDataFrame([(i, "u", "f.jpg", ts, j) for i, ts, j in rows], FORM).withColumn("ingest_ts", F.col("ts").cast("timestamp")).drop("ts").select(*(c.split()[0] for c in ingest.RAW.split(", ")))


def readings(spark, rows):
    return spark.createDataFrame([(i, [(s, k, t, None, None) for k, (s, t) in enumerate(texts)]) for i, texts in rows], ingest.READINGS)


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_a_copy_is_known_whenever_it_comes_and_whatever_its_date(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    land(raw(spark, [("a", "2024-03-05", document("Shop", 1, 2)), ("b", "2024-03-05", "{broken"), (None, "2024-03-05", document("None", 1))]), source)
    ingest.ingest_stream(spark, source, root).awaitTermination()
    land(raw(spark, [("a", "2024-05-04", document("Late", 9)), ("b", "2024-03-06", "{broken"), ("c", "2020-01-01", document("Old", 3)), ("b", "2024-07-01", document("Whole", 4))]), source)
    ingest.ingest_stream(spark, source, root).awaitTermination()
    land(raw(spark, [("a", "2019-05-04", document("Early", 9)), ("c", "2020-01-01", document("Old", 3))]), source)
    ingest.ingest_stream(spark, source, root).awaitTermination()
    receipts, items = versions.load(spark, root)
    assert {(r.receipt_id, r.store_name, float(r.total_amount)) for r in receipts.collect()} == {("a", "Shop", 3.0), ("b", "Whole", 4.0), ("c", "Old", 3.0)}
    assert sorted(r.receipt_id for r in items.collect()) == ["a", "a", "b", "c"]
    assert sorted((r.receipt_id or "", r.error) for r in ingest.quarantined(spark, root).collect()) == [("", ingest.NO_ID), ("b", structure.CORRUPT)]
    assert [(r.receipts, r["items"], r.quarantined) for r in ingest.metrics(spark, root).orderBy("batch").collect()] == [(1, 2, 2), (2, 2, 0)]


def test_a_batch_that_comes_again_is_not_added_again(spark, tmp_path):
    root, batch = str(tmp_path), raw(spark, [("a", "2024-03-05", document("Shop", 1, 2)), ("b", "2024-03-05", "{broken")])
    for k in (0, 0, 1):
        ingest.ingest_batch(batch, root, k, known=k == 1)
    receipts, items = versions.load(spark, root)
    assert receipts.count() == 1 and items.count() == 2 and versions.marks(spark, root) == {"ingest": 1}
    assert sorted(r.batch for r in ingest.quarantined(spark, root).collect()) == [0, 1]


def test_the_stream_locates_like_the_batch(spark, tmp_path):
    source, spoken, root = (str(tmp_path / n) for n in ("in", "readings", "store"))
    docs = raw(spark, [(str(k), "2024-03-05", document(f"Given {k}", k + 1)) for k in range(16)] + [("x", "2024-03-05", "{broken")])
    read = readings(spark, [(str(k), [("enhanced", CASES[12][0]), ("simple", CASES[k][0]), ("high_contrast", None)]) for k in range(16)] + [("x", [("simple", CASES[0][0])]), ("nobody", [("simple", CASES[1][0])])])
    land(read.where("receipt_id < '5'"), spoken)  # some readings come before their documents, some after
    land(docs, source)
    ingest.ingest_stream(spark, source, root, readings=spoken).awaitTermination()
    assert versions.load(spark, root)[0].count() == read.where("receipt_id < '5'").count()
    land(read.where("receipt_id >= '5'"), spoken)
    land(docs.where("receipt_id = '3'"), source)
    ingest.ingest_stream(spark, source, root, readings=spoken).awaitTermination()
    best = candidates.best_candidates(read.select("receipt_id", F.explode("readings").alias("r")).select("receipt_id", "r.*"))
    want = structure.receipts_from(structure.override_merchant(structure.parse_documents(docs), best))
    columns = ["receipt_id", "store_name", "store_address", "store_phone_number", "postal_code", "country", "location_confidence", "ocr_strategy", "total_amount"]
    got = sorted(map(str, versions.load(spark, root)[0].select(columns).collect()))
    assert got == sorted(map(str, want.select(columns).collect())) and len(got) == 16
    assert [r.receipt_id for r in ingest.quarantined(spark, root).collect()] == ["x"]


def test_a_document_goes_on_without_readings(spark, tmp_path):
    source, spoken, root = (str(tmp_path / n) for n in ("in", "readings", "store"))
    land(raw(spark, [("a", "2024-03-05", document("Shop", 1))]), source)
    land(readings(spark, [("other", [("simple", "TEXT")])]), spoken)
    run = lambda: ingest.ingest_stream(spark, source, root, readings=spoken, patience="1 second").awaitTermination()
    run()
    for k in range(2):  # its patience ends with the time of later arrivals
        land(raw(spark, [(f"later{k}", "2024-03-05", document("Later", 1))]), source)
        land(readings(spark, [(f"else{k}", [("simple", "TEXT")])]), spoken)
        run()
    found = {r.receipt_id: (r.store_name, r.ocr_strategy) for r in versions.load(spark, root)[0].collect()}
    assert found["a"] == ("Shop", None)
