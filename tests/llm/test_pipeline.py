import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tillroll.llm import common as C

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = C.read(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > len(ids) / 2, name
        assert name != "line_dedup" or now == ids
        ids = now
    name, stage = corpus_pipeline.STAGES[-1]
    assert {r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect()} == ids


def test_stages_with_odd_rows(spark, documents):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = C.materialize(stage(spark, docs, SF), name)
    assert docs.where("doc_id is null").count() > 0 and docs.where("doc_id = 200").count() == 1


def test_stages_without_rows(spark, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = C.materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_rows_are_decided_one_by_one(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    clean, other = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    rows = [(None, item), (None, clean), (1, item), (1, other), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(map(str, ((r.doc_id, r.text) for r in df.collect())))
    want = sorted(map(str, [rows[1], rows[3], rows[4], rows[5]]))
    assert left(corpus_pipeline.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))) == want
    scored = docs.select("doc_id", *C.row_key()[1:], (docs.text == item).cast("double").alias("score"))
    monkeypatch.setattr(corpus_pipeline, "score_documents", lambda *_: scored)
    assert left(corpus_pipeline.toxicity_stage(spark, docs, SF)) == want


def test_one_row_of_near_duplicates_stays(spark):
    text, other = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    rows = [(None, text), (None, text), (3, text), (1, f"{text} more"), (5, other), (5, other), (5, "quite another text of its own"), (6, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(str, ((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())))
    assert got == sorted(map(str, [rows[0], rows[4], rows[6], rows[7], rows[8]]))


def test_rows_whose_numbers_meet(spark, monkeypatch):
    """Of 200 rows many share a hash of 12 bits: each still has a number of its own, and what stays is the same."""
    few = lambda salt: F.pmod(F.xxhash64(F.lit(salt), *C.ROW_KEY), F.lit(1 << 12))
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    docs = spark.createDataFrame([(i, words(i % 150)) for i in range(200)], "doc_id long, text string")
    keys = docs.select(*C.row_key())
    assert keys.select(few(0)).distinct().count() < 200
    with C.workspace(spark, "test"):
        got = corpus_pipeline.numbered(keys, few).collect()
        assert len(got) == len({r._row for r in got}) == 200
    monkeypatch.setattr(corpus_pipeline, "row_number", few)
    monkeypatch.setattr(corpus_pipeline.numbered, "__defaults__", (few,))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == list(range(150))


def test_stages_against_plain_python(spark, documents, tmp_path):
    """What each stage keeps of the fixture, stage by stage."""
    from test_dedup import brute_components, brute_lines
    from test_text_operators import brute_tiles
    from tillroll.llm.op07_toxicity import score_documents

    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    first = [t for i, t in rows(docs) if i == 1][0]
    items = [(0, first), (1, "nothing of this stands anywhere in the corpus"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = docs.where("doc_id < 77").select("doc_id", F.lit(1).alias("quality"), ((F.col("doc_id") == 0) | F.col("doc_id").between(72, 76)).cast("int").alias("toxic")).distinct()
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    toxicity, lines, near, clean, pack = (f for _, f in corpus_pipeline.STAGES)

    bad = {(r.doc_id, r.h1) for r in score_documents(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.score >= 0.3}
    keyed = [(r.doc_id, r.text, r.h1) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h1")).collect()]
    kept = C.materialize(toxicity(spark, docs, str(tmp_path)), "t")
    assert Counter(rows(kept)) == Counter((i, t) for i, t, h in keyed if (i, h) not in bad) and 0 < kept.count() < docs.count()

    cut = C.materialize(lines(spark, kept, str(tmp_path)), "l")
    assert Counter((-(1 << 63) if i is None else i, t) for i, t in rows(cut)) == Counter((b[0], b[3]) for b in brute_lines(rows(kept)))
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = C.materialize(near(spark, cut, str(tmp_path)), "n")
    before, after = rows(cut), Counter(rows(single))
    kinds = list(dict.fromkeys(before))
    component = dict(zip(range(len(kinds)), (c for _, _, c in sorted(brute_components([(n, t) for n, (_, t) in enumerate(kinds)], 5, 80, 100)))))
    groups = {}
    for n, k in enumerate(kinds):
        groups.setdefault(component[n], []).append(k)
    want = 0
    for held in groups.values():
        words = any(re.search(r"[^\x20\x09-\x0D]", t or "") for _, t in held)
        times = 1 if words else sum(before.count(k) for k in held)
        want += times
        assert sum(after[k] for k in held) == times
        least = min((-1 if i is None else i) for i, _ in held)
        assert not words or any(after[k] for k in held if (-1 if k[0] is None else k[0]) == least)
    assert want == sum(after.values()) < len(before)

    rest = C.materialize(clean(spark, single, str(tmp_path)), "c")
    split = lambda t: C.spaced(t or "").split()
    leaked = lambda t: any(b and sum(n for *_, n in brute_tiles(split(t), split(b), 5)) >= 0.4 * len(split(b)) for _, b in items)
    assert Counter(rows(rest)) == Counter((i, t) for i, t in after.elements() if not (len(split(t)) < 500 and leaked(t)) and not (len(split(t)) >= 500 and first in t))

    packed = pack(spark, rest, str(tmp_path)).collect()
    pieces = Counter(r.doc_id for r in packed if r.start == 0)
    assert pieces == Counter(i for i, _ in rows(rest))
