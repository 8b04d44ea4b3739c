import os
import random

import pytest
from pyspark.sql import functions as F

from tillroll import schemas as S
from tillroll.operators import analytics, candidates, checks, nested, store, structure, versions
from tillroll.plans import fixtures as X
from tillroll.plans import queries as Q
from tillroll.session import scratch
from tillroll.sources import landing
from tillroll.streaming.ingest import ingest_batch

SF = "/root/testdata/sf0.001"


def test_screening(spark):
    rows = [(1, "image/jpeg", 0, b""), (2, "image/jpeg", 11 << 20, b"\xff\xd8\xff"), (3, "image/jpeg", 5, b""), (4, "Application/PDF", 5000, b"%PDF"), (5, None, 5000, b""), (6, "image/png", 5000, b"\xff\xd8\xff\x00"), (7, "image/png", 5000, b"ab"), (8, "image/png", 5000, b"%PDF-"), (9, "image/png", 5000, b"none")]
    got = {r.id: r for r in checks.screen_files(spark.createDataFrame(rows, "id int, content_type string, length long, content binary")).collect()}
    assert got[1].error_message == checks.EMPTY and got[1].file_size == 0
    assert got[2].error_message.startswith("File size (11MB)")
    assert "too small" in got[3].error_message
    assert got[4].detected_file_type == "PDF Document" and not got[4].is_valid
    assert got[5].error_message.startswith("Invalid file type")
    assert got[6].is_valid and got[6].detected_file_type == "JPEG Image"  # claimed and found types aren't compared
    assert got[7].error_message == checks.SHORT_HEADER
    assert got[8].detected_file_type == "PDF Document"
    assert got[9].error_message == checks.NO_SIGNATURE


def test_validity(spark):
    rows = spark.createDataFrame([("receipt.retail", 0.7), ("Receipt", 0.699), (None, None)], "t string, c double")
    got = [r.v for r in rows.select(checks.validity(F.col("t"), F.col("c")).alias("v")).collect()]
    assert got[0].is_valid_receipt and got[0].message == "Valid receipt detected with 70.00% confidence"
    assert not got[1].is_valid_receipt and got[1].message.startswith("Low confidence (69.90%)")
    assert got[2].doc_type == "unknown" and got[2].confidence == 0.0


def test_candidates_ties_errors_and_order(spark):
    good, none = X.CASES[0][0], X.CASES[12][0]
    rows = [(1, "enhanced", 0, good, None), (1, "simple", 1, good, None), (2, "enhanced", 0, none, none), (3, "enhanced", 0, None, None), (4, "simple", 1, "x", good), (4, "enhanced", 0, "x", "")]
    random.Random(1).shuffle(rows)
    got = {r.receipt_id: r for r in candidates.best_candidates(spark.createDataFrame(rows, "receipt_id int, strategy string, strategy_ord int, text_a string, text_b string")).collect()}
    assert got[1].strategy_used == "enhanced" and got[4].strategy_used == "simple" and got[4].raw_text == good
    assert not got[2].success and got[2].error == candidates.FAILED and not got[3].success


def docs(spark, *bodies):
    rows = [(str(i), "u", "f.jpg", b) for i, b in enumerate(bodies)]
    raw = spark.createDataFrame(rows, "receipt_id string, user_id string, file_name string, json string").withColumn("ingest_ts", F.lit(X.INGESTED).cast("timestamp"))
    return structure.parse_documents(raw)


def test_items_quirks(spark):
    entry = lambda body: '{"doc_type":"receipt","confidence":1,"fields":{"Items":{"value_array":[{"value_object":%s}]}}}' % body
    found = docs(spark, entry('{"Quantity":{"value":2.9},"TotalPrice":{"value":"x"},"Price":{"value":"3.00"}}'), entry('{"Quantity":{"value":"x"},"Price":{"value":"1,003.005"}}'), entry('{"Quantity":{"value":0.5}}'), '{"fields":{"Items":{"value_array":[{"value_type":"string"}]}}}', "{broken", None)
    got = {r.receipt_id: r for r in structure.items_from(found).collect()}
    assert set(got) == {"0", "1", "2"}
    assert (got["0"].quantity, float(got["0"].price)) == (2, 0.0)
    assert (got["1"].quantity, float(got["1"].price)) == (1, 1003.01)
    assert got["2"].quantity == 0
    assert {r.receipt_id: r.error for r in found.where("doc is null").collect()} == {"4": structure.CORRUPT, "5": structure.NO_DATA}


def test_items_of_any_depth(spark):
    """Flat documents give the rows of the fixed schema, ids too; deeper ones are opened in place."""
    flat = X.documents_json(spark, SF)
    odd = [
        '{"fields":{"Items":{"value_array":[{"value_object":{"Quantity":{"value":2.9},"TotalPrice":{"value":"x"},"Price":{"value":"3.00"}}},{"value_type":"string"},null,{"value_object":{"Description":{"value":"b"}}}]}}}',
        '{"fields":{"Items":{"value_array":[],"value":"[{\\"value_type\\":\\"dictionary\\",\\"value\\":{\\"Description\\":{\\"value\\":\\"c\\"}}}]"}}}',
        '{"fields":{"Items":{"value_array":[{"value_type":"dictionary","value":null,"value_object":{"Description":{"value":"d"}}},{"value_type":"dictionary","value":"no json"}]}}}',
        '{"fields":{"Items":{"value":"no list"}}}', '{"fields":{}}', "{broken", "null", "", None,
    ]
    raw = spark.createDataFrame([(str(i), "u", "f.jpg", b) for i, b in enumerate(odd)], "receipt_id string, user_id string, file_name string, json string").withColumn("ingest_ts", F.lit("2024-01-01").cast("timestamp"))
    for rows in (flat, raw):
        want = structure.items_from(structure.parse_documents(rows)).select("item_id", "receipt_id", "name", "quantity", "price").collect()
        got = nested.deep_items(nested.variant_documents(rows)).select("item_id", "receipt_id", "name", "quantity", "price").collect()
        assert sorted(got) == sorted(want) and got

    leaf = lambda n: '{"value_object":{"Description":{"value":"%s"}}}' % n
    bodies = {d: "".join(['{"value_array":['] * d) + f"{leaf('a')},{leaf('b')}" + "]}" * d for d in (1, 4, 30)}
    mixed = f'{{"value_array":[{leaf("a")},{{"value_array":[{leaf("b")},{{"value_array":[{leaf("c")}]}}]}},7,{{"value_object":{{"Items":{{"value":[{leaf("d")}]}}}}}},{leaf("e")}]}}'
    rows = [(str(k), f'{{"fields":{{"Items":{v}}}}}') for k, v in {**bodies, "mixed": mixed}.items()]
    docs = nested.variant_documents(spark.createDataFrame(rows, "receipt_id string, json string").withColumn("ingest_ts", F.current_timestamp()))
    got = {r.receipt_id: [i.name for i in r.found] for r in docs.select("receipt_id", nested.deep_item_list().alias("found")).collect()}
    assert got == {"1": ["a", "b"], "4": ["a", "b"], "30": ["a", "b"], "mixed": ["a", "b", "c", "d", "e"]}
    places = docs.where("receipt_id = 'mixed'").select(F.transform(nested.entries(F.try_variant_get("document", "$.fields.Items", "variant")), lambda e: e["place"]).alias("p")).first().p
    assert places == ["0", "1/0", "1/1/0", "2", "3/0", "4"]
    assert "Exchange" not in nested.deep_items(docs)._jdf.queryExecution().toString()


def test_dates_in_every_format(spark):
    forms = ["2024-03-05T10:20:30", "2024-03-05T10:20:30.123Z", "2024-03-05 10:20:30", "2024-03-05", "03/05/2024 10:20:30", "03/05/2024", "3/5/2024", "2024/03/05", "05 Mar 2024", "Mar 5, 2024", "yesterday", None]
    got = [str(r.d)[:10] for r in spark.createDataFrame([(f,) for f in forms], "v string").select(structure.date_of(F.col("v")).alias("d")).collect()]
    assert got == ["2024-03-05"] * 10 + ["None"] * 2


def test_override(spark):
    found = docs(spark, '{"doc_type":"receipt","confidence":0.9,"fields":{"MerchantName":{"value":"Old"},"MerchantAddress":{"value":"Here"}}}')
    located = spark.createDataFrame([("0", True, "New", "", "0322831117", "59200", "Malaysia", 0.7, "simple")], "receipt_id string, success boolean, store_name string, address string, phone string, postal_code string, country string, confidence double, strategy_used string")
    r = structure.receipts_from(structure.override_merchant(found, located)).first()
    assert (r.store_name, r.store_address, r.store_phone_number, r.postal_code, r.country, r.location_confidence, r.ocr_strategy) == ("New", "Here", "0322831117", "59200", "Malaysia", 0.7, "simple")
    assert structure.receipts_from(structure.receipt_results(found, located, extract_location=False)).first().store_name == "Old"


def test_contract(spark):
    row = spark.createDataFrame([("r", "u" * 451)], "receipt_id string, user_id string").withColumns({c: F.lit(None).cast(t) for c, t in S.RECEIPT_COLUMNS.items() if c not in ("receipt_id", "user_id")})
    ok, bad = checks.split_by_contract(row)
    assert ok.count() == 0 and "user_id: longer than 450" in bad.first().violations


def test_store_versions(spark, tmp_path):
    root = str(tmp_path)
    empty, _ = versions.load(spark, root)
    assert empty.count() == 0
    receipts, items = X.receipts(spark, SF), X.items(spark, SF)
    assert versions.save(spark, root, receipts, items, period="yyyy") == 1
    kept, left, found = store.delete(*versions.load(spark, root), receipts.limit(3))
    assert versions.save(spark, root, kept, left, base=1) == 2
    assert versions.load(spark, root)[0].count() == receipts.count() - 3
    with pytest.raises(versions.ConcurrentChange):  # made from version 1, which is no longer the latest
        versions.save(spark, root, kept, left, base=1)
    assert versions.append(spark, root, receipts.limit(3), items.limit(0)) == 3
    assert versions.load(spark, root)[0].count() == receipts.count() and versions.load(spark, root, 1)[0].count() == receipts.count()


def test_create_keeps_receipt_and_items_together(spark, tmp_path):
    root = str(tmp_path)
    rows = X.receipts(spark, SF).limit(3).withColumn("created_at", F.lit("2024-01-01 08:00:00").cast("timestamp")).withColumn("zone", F.lit("Asia/Singapore"))
    ids = [r.receipt_id for r in rows.select("receipt_id").collect()]
    items = spark.createDataFrame([(f"i{k}", k, "n" * (301 if k == ids[0] else 5)) for k in ids], "item_id string, receipt_id long, name string").withColumns({"price": F.lit(1).cast("decimal(18,2)"), "quantity": F.lit(1), "created_at": F.lit("2024-01-01").cast("timestamp")})
    version, bad = versions.create(spark, root, rows.where(F.col("receipt_id").isin(ids)), items)
    receipts, kept = versions.load(spark, root)
    assert version == 1 and [(r.receipt_id, r.violations) for r in bad.collect()] == [(ids[0], ["item name: longer than 300"])]
    assert {r.receipt_id for r in receipts.collect()} == {r.receipt_id for r in kept.collect()} == set(ids[1:])
    assert str(receipts.first().created_at) == "2024-01-01 00:00:00"


def test_newest_first(spark):
    receipts = X.receipts(spark, SF)
    user = receipts.groupBy("user_id").count().orderBy(F.desc("count")).first().user_id
    got = [(r.created_at, r.receipt_id) for r in store.user_receipts(receipts, X.items(spark, SF), user).collect()]
    assert len(got) > 2 and got == sorted(got, key=lambda x: (-x[0].timestamp(), x[1]))


def test_landing_scan_of_files(spark, tmp_path):
    (tmp_path / "u1").mkdir()
    (tmp_path / "u1" / "a.jpg").write_bytes(b"\xff\xd8\xff" + b"x" * 2000)
    (tmp_path / "b.pdf").write_bytes(b"%PDF" + b"x" * 2000)
    manifest = spark.createDataFrame([("a.jpg", "image/jpeg"), ("b.pdf", "image/png")], "file_name string, content_type string")
    got = {r.file_name: r for r in checks.screen_files(landing.landing_scan(spark, str(tmp_path), manifest)).collect()}
    assert got["a.jpg"].is_valid and got["a.jpg"].length == 2003 and not got["b.pdf"].is_valid and got["b.pdf"].error_message == checks.PDF


def test_headers_are_read_alone(spark, tmp_path):
    kinds = {"a.jpg": b"\xff\xd8\xff", "b.png": b"\x89PNG\r\n\x1a\n", "c.pdf": b"%PDF-1.7", "d.tif": b"II*\x00", "e.bin": b"none"}
    for name, head in kinds.items():
        with open(tmp_path / name, "wb") as file:
            file.write(head)
            file.truncate(10 << 20)  # a hole: there is nothing to read but the head
    (tmp_path / "small.jpg").write_bytes(b"\xff\xd8\xff")
    with open(tmp_path / "large.jpg", "wb") as file:
        file.truncate(1 << 40)
    manifest = spark.createDataFrame([(n, "image/png") for n in [*kinds, "small.jpg", "large.jpg"]], "file_name string, content_type string")
    found = landing.header_scan(spark, str(tmp_path), manifest)
    got = {r.file_name: r for r in checks.screen_files(found).collect()}
    assert {n: len(r.content or b"") for n, r in got.items()} == {**dict.fromkeys(kinds, 8), "small.jpg": 0, "large.jpg": 0}
    assert {n for n, r in got.items() if r.is_valid} == {"a.jpg", "b.png", "d.tif"} and got["c.pdf"].error_message == checks.PDF
    assert got["large.jpg"].error_message.startswith("File size (1048576MB)") and "too small" in got["small.jpg"].error_message
    whole = {r.file_name: tuple(r)[4:] for r in checks.screen_files(landing.landing_scan(spark, str(tmp_path / "[a-e]*"), manifest).drop("content").join(found.select("path", "content"), "path")).select("path", "file_name", "length", "content_type", "is_valid", "error_message", "detected_file_type").collect()}
    assert whole == {n: (got[n].is_valid, got[n].error_message, got[n].detected_file_type) for n in kinds}


def test_redelivery_in_any_order(spark, tmp_path):
    good = '{"doc_type":"receipt","confidence":0.9,"fields":{"MerchantName":{"value":"%s"}}}'
    row = lambda ts, json, i="r": (i, "u", "f.jpg", ts, json)
    frame = lambda rows: spark.createDataFrame(rows, "receipt_id string, user_id string, file_name string, ts string, json string").withColumn("ingest_ts", F.col("ts").cast("timestamp")).drop("ts")
    rows = [row("2024-03-05", "{broken"), row("2024-03-05 09:00:00", good % "Late"), row("2024-03-05 08:00:00", good % "Early"), row("2024-03-05", good % "No id", None)]
    for k in range(4):
        root = f"{tmp_path}/{k}"
        random.Random(k).shuffle(rows)
        ingest_batch(frame(rows), root, 0)
        ingest_batch(frame(rows), root, 0)  # the batch comes again
        ingest_batch(frame([row("2024-03-20", good % "Again"), row("2024-03-20", good % "New", "s")]), root, 1)
        ingest_batch(frame([row("2024-03-04", good % "Older", "s")]), root, 2)
        got = {(r.receipt_id, r.store_name) for r in versions.load(spark, root)[0].collect()}
        assert got == {("r", "Early"), ("s", "New")}
        assert sorted(r.error for r in spark.read.parquet(f"{root}/quarantine").collect()) == ["Corrupt document", "receipt_id: required"]


def test_settings_of_a_cluster():
    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://far:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        scratch(Far, "x")


def test_no_cartesian_and_pruned(spark):
    plan = Q.user_receipts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "p_retailprice" not in plan  # columns that nothing needs aren't read


def test_chain_match_against_all_pairs(spark):
    names = ["Tesco", "tescoo", "Aldi", "Adli", "Lidl Store", "Lidl Stor", "", None, "Mydin"]
    chains = ["Tesco", "Aldi", "Lidl Store", "Mydins"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    frame = spark.createDataFrame(list(enumerate(names)), "receipt_id int, store_name string")
    got = {r.receipt_id: (r.chain, r.edits) for r in analytics.chain_match(frame, spark.createDataFrame([(c,) for c in chains], "chain string")).collect()}
    for i, n in enumerate(names):
        near = sorted((edits(n.lower(), c.lower()), c) for c in chains if n and edits(n.lower(), c.lower()) <= 2)
        assert got[i] == ((near[0][1], near[0][0]) if near else (None, None)), n


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")

    def key(columns, rows):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr([round(float(r[i]), 6) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order]) for r in rows)

    got = Q.QUERIES[name](spark, SF)
    want = db.execute(Q.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert key(got.columns, [tuple(r) for r in got.collect()]) == key(columns, want.fetchall())


def test_means_are_added_in_order_of_receipts(spark):
    rng = random.Random(7)
    rows = [(i, "s", "Shop", None if i % 50 == 3 else f"{rng.randrange(10**9) / 100:.2f}") for i in range(400)]
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "receipt_id int, country string, store_name string, total string").withColumn("total_amount", F.col("total").cast("decimal(18,2)"))
    amounts = [float(r[3]) for r in rows if r[3]]
    added = 0.0
    for a in amounts:
        added += a
    for parts in (1, 7, 50):
        got = analytics.store_comparison(shuffled.repartition(parts)).first()
        assert (got.n, got["mean"], got["rank"]) == (400, added / len(amounts), 1)


def test_means_of_stores_round_like_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db, big = duckdb.connect(), "/root/testdata/sf0.1"  # 95 of its 3,001 means lie between two four-digit ones
    for name in ("orders", "lineitem", "supplier"):
        db.execute(f"create view {name} as select * from '{big}/{name}.parquet'")
    assert sorted(tuple(r) for r in Q.store_compare(spark, big).collect()) == sorted(db.execute(Q.ORACLES["store_compare"]).fetchall())
