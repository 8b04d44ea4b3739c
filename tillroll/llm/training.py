"""Bounded, reproducible samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm import common as C

UNIT = float(1 << 31)


def hash_share(column: str) -> Column:
    """A number in [0, 1) from a hash of the column, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(17), column), F.lit(1 << 31)) / F.lit(UNIT)


def even_sample(rows: DataFrame, by: str, cap: int) -> DataFrame:
    """About `cap` rows of each value of `by` (all where there are fewer), picked by a hash of doc_id: no shuffle of the rows, no hot task."""
    shares = {r[0]: min(1.0, cap / r[1]) for r in rows.groupBy(by).count().collect() if r[0] is not None}  # one row for each label value
    rule = F.lit(False)
    for value, share in shares.items():
        rule = rule | ((F.col(by) == F.lit(value)) & (hash_share("doc_id") < F.lit(share)))
    return rows.where(rule)


def labelled_ids(labels: DataFrame, column: str, cap: int, mod: int, held: int) -> DataFrame:
    """(doc_id, y) of about `cap` labelled documents outside the held-out fold (all where there are fewer), in the labels' own proportion; conflicting labels of a document count as 1."""
    rows = labels.where(f"doc_id is not null and {column} in (0, 1)").where(F.pmod(C.salted_id(), F.lit(mod)) != held)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    rows = C.materialize(rows, "labels")
    return rows.where(hash_share("doc_id") < F.lit(min(1.0, cap / max(1, rows.count()))))
