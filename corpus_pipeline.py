"""From documents to training sequences: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. A row is told by its doc_id and text: what is decided about a text holds for that row alone, whatever
rows share its doc_id or have a null one, too. Of near duplicates one row stays, the first by doc_id (null before all
others), then by hashes of the text; of rows equal in both, any. Documents without text are kept. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm.op02_line_dedup import apply_bitmaps, written_bitmaps
from tillroll.llm.op03_packing import packed
from tillroll.llm.op04_decontamination import decontaminate
from tillroll.llm.op07_toxicity import score_documents
from tillroll.llm.op10_ngram_join import jaccard_components

TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = score_documents(docs, C.read(spark, sf_dir, "labels"))
    return C.rows_in(docs, scores.where(F.col("score") >= TOXIC).select(*C.row_key()[:1], "h1", "h2").distinct(), "left_anti")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = apply_bitmaps(docs, written_bitmaps(docs))
    new = {"text": F.col("kept_text")} | ({"n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.withColumns(new).select(*docs.columns)


def row_number(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *C.ROW_KEY)


def numbered(keys: DataFrame, number: Callable[[int], Column] = row_number) -> DataFrame:
    """keys (different ones, by C.ROW_KEY) with _row, a number of their own: number(0), and where two have the same, all but the first of them take the next that is free."""
    named, salt = C.materialize(keys.withColumn("_row", number(0)), "row-numbers"), 0
    while not (twice := named.groupBy("_row").agg(F.count("*").alias("n"), F.min(F.struct(*C.ROW_KEY)).alias("first")).where("n > 1")).isEmpty():
        salt += 1
        later = F.col("first").isNotNull() & (F.struct(*C.ROW_KEY) != F.col("first"))
        named = C.materialize(named.join(twice, "_row", "left").withColumn("_row", F.when(later, number(salt)).otherwise(F.col("_row"))).select(*keys.columns, "_row"), "row-numbers")
    return named


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the first by doc_id (null first), hashes of the text and, of equal ones, any."""
    with C.workspace(spark, "near-duplicates"):
        keys = numbered(docs.select(*C.row_key()).groupBy(*C.ROW_KEY).agg(F.count("*").alias("rows")))
        texts = docs.select(*C.row_key(), "text").withColumn("_row", row_number(0))
        moved = keys.where(F.col("_row") != row_number(0)).select(*C.ROW_KEY, F.col("_row").alias("_moved"))
        if not moved.isEmpty():
            texts = texts.join(moved, C.ROW_KEY, "left").withColumn("_row", F.coalesce("_moved", "_row"))
        found = jaccard_components(texts.select(F.col("_row").alias("doc_id"), "text"), width=5, num=80, den=100)
        named = keys.join(found.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id").distinct(), "_row")
        first = C.keep(named.groupBy("component_id").agg(F.min(F.struct(*C.ROW_KEY, "rows", "n_shingles")).alias("first")).select("first.*"), "first-rows")
    repeated = (F.col("rows") > 1) & (F.col("n_shingles") > 0)
    again = C.rows_in(docs, first.where(repeated), "left_semi").select(*C.row_key(), F.struct(*docs.columns).alias("_all"))
    again = again.groupBy(*C.ROW_KEY).agg(F.first("_all").alias("_all")).select("_all.*")
    return C.rows_in(docs, first.where(~repeated), "left_semi").union(again)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, C.read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's rows written and read again in the shared folder; a stage's table goes when the next one's is written."""
    docs, before = C.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with C.workspace(spark, name):
            docs = C.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            C.drop(before)
        before = docs
    return docs
