"""How much the sources of each language differ in the words they use, and by which words.

Terms are runs of letters and of characters beyond ASCII. A language keeps the terms that enough of its documents hold; a
source's count of a kept term becomes a smoothed price in billionths, and two sources differ by the sum of
floor((p - q)**2 / (p + q)) over all kept terms. A price follows from a source and a count alone, so the sum needs no
terms: it needs, for two sources and two count levels, how many terms stand at both. Those joint tables are one-hot level
products: a block of terms is a 0/1 matrix with a column for each (source, count level), and its transpose times itself
counts every pair of levels at once, exactly (fewer terms a product than a 32-bit float has integers). Blocks are tasks,
terms fall into them by hash, and a block of many sources is cut into tiles of sources; each gives one number for a pair
of sources. All arithmetic is on integers.

Null text, lang and source count as ''. A language without kept terms gives pairs of value 0. Copies of a row count as
often as they come. An empty table gives no rows; other columns are ignored. A very long text is read in pieces that end
between terms. Memory: a task of the first pass holds one document's terms and up to HELD counts, a block up to BLOCK terms
of two tiles of sources. The result itself has a row for each pair of sources of a language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import common as C

#: Prices are in billionths.
UNIT = 10**9
#: Counts that a map task holds before it hands them on; expected terms of a block; terms of one product; sources of a tile.
HELD, BLOCK, CHUNK, TILE = 1 << 18, 8192, 128, 16
#: Bytes of a text split at once.
PIECE = 1 << 20

_TERM = np.arange(256, dtype=np.uint8)
_TERM[:128] = 32
_TERM[97:123] = np.arange(97, 123)
_TERM[65:91] = np.arange(97, 123)
_TABLE = _TERM.tobytes()


def terms_of(text: bytes) -> Counter:
    """A text's terms and how often each occurs, in pieces that end between terms."""
    if len(text) <= PIECE:
        return Counter(text.translate(_TABLE).split())
    found, text, at = Counter(), text.translate(_TABLE), 0
    while at < len(text):
        to = at + PIECE
        end = len(text) if to >= len(text) else text.find(b" ", to)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) for each term of each group, summed by map task."""

    def task(batches):
        held: dict[tuple, dict] = {}
        size = 0

        def flush():
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), terms in held.items():
                for term, (n, d) in terms.items():
                    for column, v in zip(columns, (lang, source, term, n, d)):
                        column.append(v)
            held.clear()
            for k in range(0, len(columns[0]), 1 << 15):
                yield pa.record_batch([pa.array(c[k : k + (1 << 15)], t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                terms = held.setdefault((lang, source), {})
                before = len(terms) - (not terms)  # a group counts as one entry
                for term, n in terms_of(text.as_py() or b"").items():
                    if term in terms:
                        one = terms[term]
                        one[0] += n
                        one[1] += 1
                    else:
                        terms[term] = [n, 1]
                size += len(terms) - before
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(task, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.decode("term", "utf-8"))


def prices(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The price of each count, in Python's integers, which have no bound."""
    return np.array([1 + UNIT * (int(c) + 2) // (total + 2 * kept) for c in counts.tolist()], np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def levels(counts: np.ndarray, totals: list[int], kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicators of a block's terms by (source, count level), where each source's columns begin, and each column's price. counts: terms by sources."""
    columns, starts, price = [], [], []
    for s, total in enumerate(totals):
        level, at = np.unique(counts[:, s], return_inverse=True)
        hot = np.zeros((len(counts), len(level)), np.float32)
        hot[np.arange(len(counts)), at] = 1
        starts.append(sum(c.shape[1] for c in columns))
        columns.append(hot)
        price.append(prices(level, total, kept))
    return np.concatenate(columns, axis=1), np.array(starts), np.concatenate(price)


def block_sums(counts_a: np.ndarray, totals_a: list[int], counts_b: np.ndarray, totals_b: list[int], kept: int) -> np.ndarray:
    """The divergence of each source of a from each of b over a block's terms, by joint tables of their count levels."""
    out = np.zeros((len(totals_a), len(totals_b)), np.int64)
    for k in range(0, len(counts_a), CHUNK):
        xa, first_a, pa_ = levels(counts_a[k : k + CHUNK], totals_a, kept)
        xb, first_b, pb_ = levels(counts_b[k : k + CHUNK], totals_b, kept)
        joint = xa.T @ xb
        i, j = np.nonzero(joint)
        value = joint[i, j].astype(np.int64) * divergence(pa_[i], pb_[j])
        np.add.at(out, (np.searchsorted(first_a, i, "right") - 1, np.searchsorted(first_b, j, "right") - 1), value)
    return out


def block_rows(cells: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    """(lang, source, part, item, value) of one block of a language's terms and two tiles of its sources (the same twice on the diagonal).

    cells: (gid, term, n, total) of the counts that aren't 0; groups: (lang, block, ta, tb, source, gid, size, kept, whole) of both tiles.
    """
    groups = groups.sort_values("gid")
    lang, a, b = groups["lang"].iloc[0], int(groups["ta"].iloc[0]), int(groups["tb"].iloc[0])
    kept, whole = int(groups["kept"].iloc[0]), int(groups["whole"].iloc[0])
    gids, names = groups["gid"].to_numpy(), groups["source"].to_numpy(object)
    sizes = [int(v) for v in groups["size"].tolist()]
    which = np.searchsorted(gids, cells["gid"].to_numpy())
    row, terms = pd.factorize(cells["term"]) if len(cells) else (np.zeros(0, int), np.zeros(0, object))
    total = np.zeros(len(terms), np.int64)
    total[row] = cells["total"].to_numpy()
    order = np.argsort(total, kind="stable")  # terms of like frequency share levels
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    counts = np.zeros((len(terms), len(gids)), np.int64)
    counts[place[row], which] = cells["n"].to_numpy()
    left, right = np.flatnonzero(gids // TILE == a), np.flatnonzero(gids // TILE == b)
    pick = lambda at: [sizes[i] for i in at.tolist()]
    sums = block_sums(counts[:, left], pick(left), counts[:, right], pick(right), kept)
    if kept:  # terms that none of these sources has stand at level 0 of all: the first block adds them, less those that any block has seen
        none = [prices(np.zeros(1, np.int64), size, kept)[0] for size in sizes]
        nought = divergence(np.array([none[i] for i in left])[:, None], np.array([none[i] for i in right])[None, :])
        sums += nought * ((kept if int(groups["block"].iloc[0]) == 0 else 0) - len(terms))
    i, j = np.nonzero(np.ones_like(sums) if a != b else ~np.eye(len(left), dtype=bool))
    out = [(names[left[i]], "pair", names[right[j]], sums[i, j])]
    if a != b:
        out.append((names[right[j]], "pair", names[left[i]], sums[i, j]))
    elif len(terms):
        words, q = np.asarray(terms, object)[order], prices(total[order], whole, kept)
        for s in left.tolist():
            at = np.flatnonzero(counts[:, s])
            p = prices(counts[at, s], sizes[s], kept)
            f = divergence(p, q[at])
            at, f = at[p > q[at]], f[p > q[at]]
            best = sorted(zip((-f).tolist(), [w.encode() for w in words[at]]))[:top] if len(at) <= 4 * top else _best(f, words[at], top)
            if best:
                out.append((np.array([names[s]] * len(best), object), "term", np.array([w.decode() for _, w in best], object), np.array([-v for v, _ in best], np.int64)))
    return pd.concat([pd.DataFrame({"lang": lang, "source": s, "part": part, "item": item, "value": v}) for s, part, item, v in out], ignore_index=True)


def _best(f: np.ndarray, words: np.ndarray, top: int) -> list[tuple[int, bytes]]:
    """The `top` largest values, ties by bytes."""
    least = np.partition(f, len(f) - top)[len(f) - top]
    at = np.flatnonzero(f >= least)
    return sorted(zip((-f[at]).tolist(), [w.encode() for w in words[at]]))[:top]


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source): every other source of the language by divergence, and the `top` terms that a source overuses."""
    with C.workspace(docs.sparkSession, "divergence"):
        return C.keep(_divergence(docs, least_docs, top, block), "source-divergence")


def _divergence(docs: DataFrame, least_docs: int, top: int, block: int) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    held = C.materialize(counted(docs), "term-counts").groupBy("lang", "term")
    kept = held.agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells")).where(F.col("docs") >= least_docs)
    kept = C.materialize(kept.select("lang", "term", "total", "cells"), "kept-terms")  # a term's cells are its sources
    cells = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "kept", "whole")))
    own = Window.partitionBy("lang")  # rows are sources
    groups = groups.withColumns({"gid": F.row_number().over(own.orderBy("source")) - 1, "tiles": F.ceil(F.count("*").over(own) / TILE).cast("int"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / block)).cast("int")})
    groups = C.materialize(groups.withColumn("tile", F.floor(F.col("gid") / TILE).cast("int")), "groups")
    key = ["lang", "block", "ta", "tb"]
    paired = lambda df: df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"ta": F.least("tile", "o"), "tb": F.greatest("tile", "o")})
    placed = cells.join(groups.select("lang", "source", "gid", "tile", "tiles", "blocks"), ["lang", "source"])
    placed = paired(placed.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))).select(*key, "gid", "term", "n", "total")
    known = paired(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).select(*(F.col(c).alias(c) for c in (*key, "source", "gid", "size", "kept", "whole")))
    task = lambda a, b: block_rows(a, b, top)
    rows = placed.groupBy(*key).cogroup(known.groupBy(*key)).applyInPandas(task, "lang string, source string, part string, item string, value long")
    rows = rows.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(C.read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY 1, 2, 3),
k AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM t GROUP BY 1, 2 HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(t.n, 0)::HUGEINT AS n, l.v, l.n AS whole, (sum(coalesce(t.n, 0)) OVER (PARTITION BY g.lang, g.source))::HUGEINT AS size
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (n + 2)) // (size + 2 * v) AS p, 1 + (1000000000 * (total + 2)) // (whole + 2 * v) AS q FROM c),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
