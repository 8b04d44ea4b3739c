"""Extensions: analyses that go beyond the reference's working features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tillroll.operators.linked import link_groups
from tillroll.session import scratch, workspace


def price_comparison(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """By item and store: lowest, mean and highest price, count, and the store's rank by lowest price."""
    rows = items.select("receipt_id", "name", "price").join(receipts.select("receipt_id", "store_name"), "receipt_id")
    by = rows.groupBy("name", "store_name").agg(F.min("price").alias("min_price"), F.avg(F.col("price").cast("double")).alias("avg_price"), F.max("price").alias("max_price"), F.count("*").alias("n"))
    return by.withColumn("rank", F.rank().over(Window.partitionBy("name").orderBy("min_price")))


def spending_trend(receipts: DataFrame) -> DataFrame:
    """By user and month: the sum spent and the change from the user's month before."""
    by = receipts.where("purchase_date is not null").groupBy("user_id", F.date_trunc("month", "purchase_date").cast("date").alias("month")).agg(F.sum("total_amount").alias("spent"), F.count("*").alias("n"))
    return by.withColumn("change", F.col("spent") - F.lag("spent").over(Window.partitionBy("user_id").orderBy("month")))


def store_comparison(receipts: DataFrame, within: str = "country") -> DataFrame:
    """By store and `within`: receipts, sum, mean and median, and the store's rank by sum among those of one `within`.

    The mean's amounts are added as doubles by receipt_id, so that it is the same to the last bit however rows are dealt out. A store's receipts
    are sorted in one task for that, which spills.
    """
    key, amount = [within, "store_name"], F.col("total_amount").cast("double")
    added = F.sum(amount).over(Window.partitionBy(*key).orderBy("receipt_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by = receipts.select(*key, "receipt_id", "total_amount", added.alias("_added")).groupBy(*key).agg(
        F.count("*").alias("n"), F.sum("total_amount").alias("total"), (F.max_by("_added", F.struct("receipt_id")) / F.count("total_amount")).alias("mean"), F.percentile_approx("total_amount", 0.5, 10000).alias("median")
    )
    return by.withColumn("rank", F.rank().over(Window.partitionBy(within).orderBy(F.desc("total"))))


def duplicate_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts that agree in user, store, day and total (where both lack one of these, they agree in it): the first is the original of the rest. Counted with partial aggregates."""
    rows = receipts.withColumn("_k", F.struct("user_id", "store_name", F.to_date("purchase_date").alias("day"), "total_amount"))
    groups = rows.groupBy("_k").agg(F.min("receipt_id").alias("original_id"), F.count("*").alias("copies")).where("copies > 1").withColumnRenamed("_k", "_g")
    return rows.join(groups, F.col("_k").eqNullSafe(F.col("_g"))).select("receipt_id", "original_id", "copies")


def name_keys(name: Column, edits: int) -> Column:
    """A name with up to `edits` letters left out, in every way, as an array of hashes: names within `edits` edits of each other share one, names that share one are within twice as many."""
    less = lambda s: F.when(F.char_length(s) > 0, F.transform(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s))))).otherwise(F.array(F.lit("")))
    forms = F.array(name)
    for _ in range(edits):
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, less))))
    return F.array_distinct(F.transform(forms, lambda s: F.xxhash64(s)))


def near_duplicate_receipts(receipts: DataFrame, days: int = 1, edits: int = 2, few: int = 32) -> DataFrame:
    """Receipts of one user and one total, at most `days` apart and with store names within `edits` edits, in groups: (receipt_id, group_id), the group's smallest receipt_id; only groups of two or more.

    Every such link counts, whatever receipts stand between. Receipts that agree in all four are one row. Of one user and total, up to `few` such rows
    meet each other; more of them meet by span of days and a key of the name that both must share, so no large group's pairs are drawn. What meets is
    verified. A null in any of the four links with nothing; of repeated receipt_ids one row counts.
    """
    spark, block = receipts.sparkSession, ["user_id", "total_amount"]
    key = [*block, "day", "name"]
    with workspace(spark, "near-receipts") as written:
        rows = written(receipts.select("receipt_id", *block, F.to_date("purchase_date").alias("day"), F.lower("store_name").alias("name")).dropna(subset=["receipt_id", *key]))
        one = written(rows.groupBy(*key).agg(F.min("receipt_id").alias("id"), F.count_distinct("receipt_id").alias("n")))
        several = one.groupBy(*block).agg(F.count("*").alias("m")).where("m > 1")
        near = written(one.join(several, block).select("id", *block, F.unix_date("day").alias("d"), "name", "m"))
        side = lambda df, *more: df.select(*block, *more, F.col("id").alias("other"), F.col("d").alias("e"), F.col("name").alias("like"))
        small, large, span = near.where(F.col("m") <= few), near.where(F.col("m") > few), days + 1
        keyed = large.withColumn("key", F.explode(name_keys(F.col("name"), edits)))
        placed = keyed.withColumn("span", F.floor(F.col("d") / span))
        probes = keyed.withColumn("span", F.explode(F.sequence(F.floor((F.col("d") - days) / span), F.floor((F.col("d") + days) / span))))
        met = small.join(side(small), block).unionByName(placed.join(side(probes, "span", "key"), [*block, "span", "key"]), allowMissingColumns=True)
        met = met.where((F.col("id") < F.col("other")) & (F.abs(F.col("d") - F.col("e")) <= days))
        links = met.where(F.levenshtein("name", "like", edits) >= 0).select(F.col("id").alias("a"), F.col("other").alias("b"))
        groups = one.join(link_groups(links, written).withColumnRenamed("node", "id"), "id", "left").where("n > 1 or group_id is not null").select(*key, F.coalesce("group_id", "id").alias("group_id"))
        path = scratch(spark, "near-receipts")
        rows.join(groups, key).select("receipt_id", "group_id").distinct().write.parquet(path)
    return spark.read.parquet(path)


def observed_run(receipts: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The rows, and what a run over them counts while they pass: receipts, total, valid and invalid ones, mean confidence. No pass of its own."""
    seen = Observation(name)
    status = lambda k: F.count_if(F.col("status") == k)
    return receipts.observe(seen, F.count(F.lit(1)).alias("receipts"), F.sum("total_amount").cast("double").alias("total"), status(1).alias("valid"), status(2).alias("invalid"), F.avg("validation_confidence").alias("confidence")), seen


def review_queue(receipts: DataFrame, least: float = 0.7) -> DataFrame:
    """Receipts read with low confidence, least sure first, by amount at stake."""
    sure = F.least(F.coalesce("validation_confidence", F.lit(0.0)), F.coalesce("location_confidence", F.lit(1.0)))
    return receipts.withColumn("sureness", sure).where(F.col("sureness") < least).select("receipt_id", "sureness", "total_amount").orderBy("sureness", F.desc("total_amount"), "receipt_id")


def chain_match(receipts: DataFrame, chains: DataFrame, most: int = 2) -> DataFrame:
    """Each store name's nearest chain (chain) within `most` edits, the first by name of equally near ones.

    Names and chains meet by name_keys(), first equal ones, then those within one edit, and so on: a name goes on only while it has
    found none, and what meets is never far apart, however many names begin alike.
    """
    spark = receipts.sparkSession
    path, form = scratch(spark, "nearest-chains"), "name string, chain string, edits int"
    with workspace(spark, "chains") as written:
        rest = written(receipts.select(F.lower("store_name").alias("name")).where("name != ''").distinct())
        known = written(chains.select("chain", F.lower("chain").alias("low")).distinct())
        for edits in range(most + 1):
            keyed = lambda df, c: df.withColumn("key", F.explode(name_keys(F.col(c), edits)))  # noqa: E731, B023
            near = keyed(rest, "name").join(keyed(known, "low"), "key").select("name", "chain", F.levenshtein("name", "low", edits).alias("edits")).where("edits >= 0")
            near.groupBy("name").agg(F.min(F.struct("edits", "chain")).alias("b")).select("name", F.col("b.chain").alias("chain"), F.col("b.edits").alias("edits")).write.mode("append").parquet(path)
            rest = written(rest.join(spark.read.schema(form).parquet(path).select("name"), "name", "left_anti"))
    best = spark.read.schema(form).parquet(path)
    return receipts.withColumn("name", F.lower("store_name")).join(best, "name", "left").select("receipt_id", "store_name", "chain", "edits")


def tax_and_hours(df: DataFrame, text: str = "text") -> DataFrame:
    """Tax number and opening hours read from a text."""
    tax = r"(?i)(?:gst|vat|sst|tax)\s*(?:reg(?:istration)?)?\s*(?:no|number|id)?\s*[.:#]*\s*([A-Z]{0,3}[0-9][0-9A-Z-]{6,17})"
    hours = r"(?i)\b([0-9]{1,2}(?:[:.][0-9]{2})?\s*(?:am|pm)?\s*(?:-|to)\s*[0-9]{1,2}(?:[:.][0-9]{2})?\s*(?:am|pm))\b"
    one = lambda p: F.when(F.col(text).rlike(p), F.regexp_extract(text, p, 1))
    return df.withColumns({"tax_number": one(tax), "opening_hours": one(hours)})
