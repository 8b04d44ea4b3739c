"""Receipts as a stream: documents meet their OCR readings, and each micro-batch goes through the batch transforms once.

Documents and readings come from folders of files. They are joined as streams by the time they arrive, so nothing is ever
too late: a document waits for its readings for `patience`, then goes on without. A document that has been taken in is told
by the state store, in RocksDB on the executors' disks: of copies the first that arrives and can be read counts, whenever
the others come and whatever they are dated (of several that arrive in one micro-batch, one); broken copies count once each.
No stored row is read again for that. The state holds an id for every receipt and doesn't shrink.

A micro-batch is appended to the store of tillroll.operators.versions with its number, receipts and items at once; a batch
that comes again finds its number there. What is corrupt or breaks the contract goes to quarantine, whole, with the
reason, and a row of figures to metrics. Both lie in a folder for each batch, which a batch that comes again replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll import schemas as S
from tillroll.operators import versions
from tillroll.operators.candidates import best_reading
from tillroll.operators.checks import nested_violations
from tillroll.operators.structure import item_id, item_list, lay_over, parse_documents, receipts_from

RAW = "receipt_id string, user_id string, file_name string, ingest_ts timestamp, json string"
READING = "struct<strategy:string,strategy_ord:int,text_a:string,text_b:string,error:string>"
READINGS = f"receipt_id string, readings array<{READING}>"
QUARANTINE = "receipt_id string, json string, error string, day string, batch long"
METRICS = "receipts long, total double, valid long, invalid long, confidence double, items long, quarantined long, batch long"
#: The state lies in RocksDB; a batch writes what it changed, not the state's files, and rows aren't counted, which would look each up again.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
NO_ID = "receipt_id: required"


def read_key() -> F.Column:
    """What tells a copy: the receipt_id of a document that can be read, the content of one that can't."""
    fine = F.col("doc").isNotNull() & F.col("receipt_id").isNotNull()
    return F.when(fine, F.concat(F.lit("receipt "), "receipt_id")).otherwise(F.concat_ws(" ", F.lit("broken"), "receipt_id", F.sha2(F.coalesce("json", F.lit("")), 256)))


def first_copies(batch: DataFrame) -> DataFrame:
    """Parsed documents (RAW, doc, error, perhaps readings), one of each: of copies the earliest, of equal times the one with the smaller hash. _k tells them apart."""
    rows = batch.withColumn("_k", read_key())
    return rows.groupBy("_k").agg(F.min_by(F.struct(*batch.columns), F.struct("ingest_ts", F.xxhash64("json"))).alias("d")).select("_k", "d.*")


def located(docs: DataFrame) -> DataFrame:
    """docs (doc, and `readings` or the best of them as `location`) with the best reading laid over them, each where it lies: nothing is shuffled."""
    found = docs if "location" in docs.columns else docs.withColumn("location", best_reading(F.col("readings"))).drop("readings")
    return lay_over(found).drop("location")


def rows_of(docs: DataFrame) -> DataFrame:
    """docs as one frame for the store and the quarantine, in one pass: _k, the receipt's columns, items (not named yet), violations, day, and the json of what has violations."""
    fine = F.col("_k").startswith("receipt")
    day = F.coalesce(F.date_format("ingest_ts", "yyyy-MM-dd"), F.lit("1970-01-01")).alias("day")
    rows = receipts_from(docs, (F.when(fine, item_list(named=False)).alias("items"), "json", day, "_k", "error"), every=True)
    rows = rows.withColumn("violations", F.when(fine, nested_violations(rows)).otherwise(F.array(F.coalesce("error", F.lit(NO_ID))))).drop("error")
    return rows.withColumn("json", F.when(F.size("violations") > 0, F.col("json")))


def ingest_batch(batch: DataFrame, root: str, batch_id: int, known: bool = True, source: str = "ingest", copies: bool = True, **choices) -> None:
    """Appends one batch (RAW, parsed, or rows of rows_of(); with `readings` or without) to the store under root.

    known: receipts that are stored already are left out, by a join with the stored ids; a stream's state has seen to that.
    copies: False where nothing comes twice in the batch, as behind a stream's state. A batch that comes again is not added again. choices: those of a new store.
    """
    spark = batch.sparkSession
    if versions.marks(spark, root).get(source, -1) >= batch_id:
        return
    if "violations" in batch.columns:
        rows = batch
    else:
        parsed = batch if "doc" in batch.columns else parse_documents(batch)
        docs = first_copies(parsed) if copies else parsed.withColumn("_k", read_key())
        rows = rows_of(located(docs) if "readings" in docs.columns else docs)
    if known:
        stored = versions.load(spark, root)[0].select("receipt_id", F.lit(True).alias("_had")).distinct()
        rows = rows.join(stored, "receipt_id", "left").where("_had is null or size(violations) > 0").drop("_had")
    rows = versions.dealt(spark, root, rows.drop("_k"), **choices).persist()  # dealt out once, for both tables
    try:
        fine, size = F.col("violations_n") == 0, F.coalesce(F.size("items"), F.lit(0))
        when = lambda c: F.coalesce(F.count_if(c), F.lit(0))
        figures = rows.withColumn("violations_n", F.size("violations")).agg(
            when(fine).alias("receipts"), F.sum(F.when(fine, F.col("total_amount").cast("double"))).alias("total"), when(fine & (F.col("status") == 1)).alias("valid"), when(fine & (F.col("status") == 2)).alias("invalid"),
            F.avg(F.when(fine, F.col("validation_confidence"))).alias("confidence"), F.coalesce(F.sum(F.when(fine & (size > 0), size)), F.lit(0)).alias("items"), when(~fine).alias("quarantined"),
        )
        row = figures.first()
        if not row["receipts"] and not row["quarantined"]:  # nothing has come, or copies alone
            return
        _write_batch(spark.createDataFrame([row], figures.schema), f"{root}/metrics", batch_id)
        _write_batch(rows.where("size(violations) > 0").select("receipt_id", "json", F.array_join("violations", "; ").alias("error"), "day"), f"{root}/quarantine", batch_id)
        versions.append_nested(spark, root, rows.where("size(violations) = 0").drop("violations", "json", "day"), mark={source: batch_id}, item_id=item_id(F.col("receipt_id"), F.col("item_id")))
    finally:
        rows.unpersist()


def _write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """What was turned away: receipt_id, json, error, day and batch."""
    return spark.read.schema(QUARANTINE).parquet(f"{root}/quarantine")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """A row for each batch that brought something: receipts, their total, valid and invalid ones, mean confidence, items, and what went to quarantine."""
    return spark.read.schema(METRICS).parquet(f"{root}/metrics")


def arriving(spark: SparkSession, path: str, schema: str, files: int | None) -> DataFrame:
    """Rows of files as they come."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def timed(rows: DataFrame, name: str) -> DataFrame:
    """rows with the time that they came: the micro-batch's, so that it never runs back and no row is late."""
    return rows.withColumn(name, F.current_timestamp()).withWatermark(name, "0 seconds")


def ingest_stream(spark: SparkSession, source: str, root: str, readings: str | None = None, files: int | None = None, patience: str = "1 hour", **choices) -> StreamingQuery:
    """Takes in raw documents (RAW) that land as Parquet under source, with the readings (READINGS) that land under `readings`, until all that is there is done."""
    rows = arriving(spark, source, RAW, files)
    if readings:  # a reading is looked into once, behind the shuffle that the join wants, so that all cores share them however few files they come in; the join's state holds what was found, not texts
        found = timed(arriving(spark, readings, READINGS, files), "_read_at").repartition("receipt_id").select(F.col("receipt_id").alias("_read"), best_reading(F.col("readings")).alias("location"), "_read_at")
        rows = timed(rows, "_arrived")
        near = F.col("_read_at").between(F.col("_arrived") - F.expr(f"interval {patience}"), F.col("_arrived") + F.expr(f"interval {patience}"))
        rows = rows.join(found, (F.col("receipt_id") == F.col("_read")) & near, "left_outer").drop("_read", "_read_at", "_arrived")
    rows = parse_documents(rows).withColumn("_k", read_key())
    rows = rows_of(located(rows) if readings else rows).dropDuplicates(["_k"]).drop("_k")  # a document is parsed once, and what comes of it is shuffled
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():  # a query keeps the settings that it starts with
        spark.conf.set(key, value)
    try:
        return rows.writeStream.foreachBatch(lambda df, i: ingest_batch(df, root, i, known=False, copies=False, **choices)).option("checkpointLocation", f"{root}/_progress").trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
