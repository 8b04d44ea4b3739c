"""Line dedup with DataFrame functions only.

Hashes of long lines are range-partitioned, sorted by document and position, and read as a stream that marks first
occurrences; the result is one run-length keep bitmap for each document that loses lines, never text.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z in lower case. A key of at least
`min_chars` code points that stands in at least `min_docs` documents keeps its lines only in the largest doc_id.
Null and empty texts are one empty line. A null doc_id counts as one document, smaller than all others. Rows that
share a doc_id count as one document, each with its own bitmap. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
NO_ID = -(1 << 63)
#: Runs that a key is split into, by document, at least, so that a very common line is spread over tasks.
RUNS = 64
#: Lines that a run of one key may hold on average, even if that key were on every line.
RUN_LINES = 1 << 20


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, text_hash, n_dropped, keep_runs) of documents that lose lines. keep_runs: lengths of kept and dropped runs of lines in turn, kept first."""
    spark = docs.sparkSession
    lines = docs.select(_document().alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = C.materialize(keys.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "line-hashes")
    runs = max(RUNS, -(-hashed.count() // RUN_LINES))  # counted from the files' footers
    hashed = hashed.withColumn("run", F.pmod(F.xxhash64("doc"), F.lit(runs)))
    order = ["h1", "h2", "run"]
    dealt = hashed.repartitionByRange(C.partitions(spark), *order)
    stream = Window.partitionBy(*order).orderBy(F.desc("doc"), "pos")
    firsts = dealt.select(*order, "doc", (~F.lag("doc").over(stream).eqNullSafe(F.col("doc"))).alias("first")).where("first")
    common = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper")).where(F.col("n_docs") >= min_docs)
    decided = firsts.select(*order).distinct().join(common, ["h1", "h2"]).select(*order, "keeper")
    dropped = hashed.join(decided, order).where(F.col("doc") < F.col("keeper"))
    found = dropped.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    # starts and stops of runs of dropped positions, then the lengths between them
    start = F.filter("drops", lambda p, i: (i == 0) | (F.get(F.col("drops"), i - 1) != p - 1))
    stop = F.transform(F.filter("drops", lambda p, i: (i == F.size("drops") - 1) | (F.get(F.col("drops"), i + 1) != p + 1)), lambda p: p + 1)
    edges = found.select("doc", "text_hash", F.size("drops").alias("n_dropped"), F.flatten(F.zip_with(start, stop, lambda a, b: F.array(a, b))).alias("edges"))
    return edges.select("doc", "text_hash", "n_dropped", F.transform("edges", lambda e, i: e - F.coalesce(F.get(F.col("edges"), i - 1), F.lit(0))).alias("keep_runs"))


def written_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """keep_bitmaps as a table; the hashes it came from are deleted."""
    with C.workspace(docs.sparkSession, "lines"):
        return C.keep(keep_bitmaps(docs, min_chars, min_docs), "keep-bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text."""
    joined = docs.withColumns({"_doc": _document(), "_hash": F.xxhash64("text")}).join(
        bitmaps.withColumnsRenamed({"doc": "_doc", "text_hash": "_hash", "n_dropped": "_n", "keep_runs": "_runs"}).hint("merge"), ["_doc", "_hash"], "left"  # they grow with the documents, so they are never broadcast
    )
    lines = joined.withColumn("_lines", lines_of(F.col("text")))
    edge = F.aggregate("_runs", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))  # where runs begin
    with_edges = lines.withColumn("_edges", F.when(F.col("_runs").isNotNull(), edge))
    kept_runs = F.transform(F.filter(F.sequence(F.lit(0), F.size("_edges") - 1), lambda i: i % 2 == 0), lambda i: F.slice("_lines", F.get("_edges", i) + 1, F.coalesce(F.get("_edges", i + 1), F.size("_lines")) - F.get("_edges", i)))
    kept = F.when(F.col("_runs").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.flatten(kept_runs), "\n"))
    return with_edges.select(*docs.columns, F.size("_lines").cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every document."""
    docs = docs.select("doc_id", "text")
    return apply_bitmaps(docs, written_bitmaps(docs, min_chars, min_docs))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(C.read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT k.doc_id, pos, line, coalesce(k.doc_id < c.keeper, false) AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
