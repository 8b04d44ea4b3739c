"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, their marks and digits of any script, in case-folded compatible form (NFKC); in scripts
written without blanks (Chinese, Japanese, Thai and others) each letter or mark is a word. Runs of `min_match` words,
hashed by a running (Karp-Rabin) hash, are the seeds by which documents and test items meet. Of words that are still free
the longest match is marked again and again, until none of `min_match` words is left; of equally long ones the first in
the document goes first, then the first in the item. The share of the item's words under tiles is its coverage, so
reordered passages count in full; a document is contaminated when an item's coverage reaches `threshold`.

The benchmark is taken in blocks of about BLOCK_WORDS words, each broadcast to one pass over the documents; every
document meets every block. An item of fewer than `min_match` words is sought whole, so that it counts with coverage 1
or not at all. Null items and those without words match nothing. Null and empty texts are clean. Each row is judged by its
own text, whatever rows share its doc_id or have a null one, too. Repeated items count each. An empty documents table gives no rows, an empty benchmark clean documents; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

BLOCK_WORDS = 1_000_000
NO_ID = C.NO_ID


def count_words(texts: DataFrame) -> int:
    """The number of words in the column `text`."""

    def task(batches):
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(0))
            n = [len(C.letter_words(data[int(offsets[lo]) : int(offsets[hi])], offsets[lo : hi + 1] - int(offsets[lo]))[0]) for lo, hi in C.groups(offsets)]
            yield pa.record_batch([pa.array([sum(n)], pa.int64())], names=["n"])

    return texts.select("text").mapInArrow(task, "n long").agg(F.sum("n")).first()[0] or 0


def prefix_sums(words: np.ndarray) -> np.ndarray:
    """Sums from which the running (Karp-Rabin) hash of any window follows."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * C.powers(C.BASE, len(words)), dtype=np.uint64, out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """The hash of each `width` words in a row."""
    n = len(prefix) - width
    return C.mix64((prefix[width:] - prefix[:-width]) * C.powers(C.INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)


def held(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values stand in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Items:
    """The test items of one block: their words and where each seed stands; items of fewer words than a seed are seeds of their own width."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        self.width, self.ids, self.words = width, [], []
        found: dict[int, list] = {}
        for item, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            words = C.letter_words(data, np.array([0, len(data)]))[0] if len(data) else np.zeros(0, np.uint64)
            if len(words):
                h = np.unique(window_hashes(prefix_sums(words), self.seed_width(words)))
                found.setdefault(self.seed_width(words), []).append((h, np.full(len(h), len(self.ids), np.int32)))
            self.ids.append(item)
            self.words.append(words)
        self.seeds = [(w, *self.index(f)) for w, f in found.items()]

    def seed_width(self, words: np.ndarray) -> int:
        return min(self.width, len(words))

    @staticmethod
    def index(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, item = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(h, kind="stable")
        quick = np.zeros(1 << 20, bool)
        quick[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return h[order], item[order], quick

    def shared(self, words: np.ndarray):
        """For each item that shares a seed with a document: its number, and the places and hashes of the document's seeds that it holds."""
        prefix = prefix_sums(words)
        for width, seeds, item, quick in self.seeds:
            h = window_hashes(prefix, width)
            at = np.flatnonzero(quick[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[held(h[at], seeds)]
            if not len(at):
                continue
            kinds = np.unique(h[at])
            left, right = np.searchsorted(seeds, kinds, "left"), np.searchsorted(seeds, kinds, "right")
            size = right - left
            owner = item[np.repeat(left - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            kinds = np.repeat(kinds, size)
            order = np.argsort(owner, kind="stable")  # seeds of an item stay in order
            owner, kinds = owner[order], kinds[order]
            cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = at[held(h[at], kinds[a:b])] if len(cut) > 2 else at
                yield int(owner[a]), own, h[own]


def reach(item: np.ndarray, seeds: np.ndarray, width: int) -> float:
    """The share of the item's words under any of the seeds that it shares with a document: no tiling covers more."""
    at = np.flatnonzero(held(window_hashes(prefix_sums(item), width), np.unique(seeds)))
    edge = np.zeros(len(item) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return float((np.cumsum(edge)[:-1] > 0).mean())


def tiles(doc: np.ndarray, item: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, length): the longest first, of equal ones the first in the document, then in the item. places: where the document has seeds of the item, in order.

    Only what the seeds cover is looked at. Each round finds the length of the longest match of words that are still free, by
    binary search over running hashes, and marks all matches of that length; a place is never paired with every other.
    """
    edge = np.flatnonzero(np.diff(places) > width)  # seeds of one run touch
    first, last = places[np.concatenate(([0], edge + 1))], places[np.concatenate((edge, [len(places) - 1]))] + width
    size = last - first + 1  # one more, a barrier, after each run
    origin = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    used_d, used_i = np.zeros(len(origin), bool), np.zeros(len(item), bool)
    used_d[np.cumsum(size) - 1] = True
    part = doc[np.minimum(origin, len(doc) - 1)]
    sums_d, sums_i = prefix_sums(part), prefix_sums(item)

    def free(used: np.ndarray, n: int) -> np.ndarray:
        marks = np.concatenate(([0], np.cumsum(used)))
        return np.flatnonzero(marks[n:] == marks[:-n])

    def matches(n: int):
        i, j = free(used_d, n), free(used_i, n)
        hi, hj = window_hashes(sums_d, n)[i], window_hashes(sums_i, n)[j]
        ordered = np.sort(hj)
        keep = held(hi, ordered)
        return i[keep], hi[keep], j, hj

    out, most = [], min(len(part), len(item))
    while most >= width:
        low, high = width - 1, most
        while low < high:  # the longest length with a match
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(matches(mid)[0]) else (low, mid - 1)
        if low < width:
            break
        i, hi, j, hj = matches(low)
        order = np.argsort(hj, kind="stable")  # by hash, then place
        j, hj = j[order], hj[order]
        at, stop = np.searchsorted(hj, hi, "left").tolist(), np.searchsorted(hj, hi, "right").tolist()
        now: dict[int, int] = {}  # how far the places of a hash are used up
        done, marked = 0, False
        for p, a, b in zip(i.tolist(), at, stop):
            if p < done:
                continue
            k = now.get(a, a)
            while k < b and used_i[j[k] : j[k] + low].any():
                k += 1
            now[a] = k
            if k < b and np.array_equal(part[p : p + low], item[j[k] : j[k] + low]):
                q = int(j[k])
                out.append((int(origin[p]), q, low))
                used_d[p : p + low] = True
                used_i[q : q + low] = True
                done, marked = p + low, True
        most = low if marked else low - 1
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, least: float = 0.0) -> DataFrame:
    """(doc, h1, h2, item_id, coverage, tiles) of documents, by C.ROW_KEY, and test items that share a tile. least: pairs whose shared seeds cover less of the item can't reach that coverage and are left out."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null")
    total = count_words(items)
    blocks = -(-total // BLOCK_WORDS)
    texts = docs.select(*C.row_key(), "text")
    kind = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))
    schema = "doc long, h1 long, h2 long, item_id long, coverage double, tiles array<struct<doc_word:int,item_word:int,words:int>>"

    def one(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_WORDS words
        shared = C.share(spark, sorted((r[0] if r[0] is not None else NO_ID, r[1]) for r in rows))

        def task(batches):
            found = Items(shared.value, min_match)
            for batch in batches:
                out: list[list] = [[], [], [], []]
                data, offsets = C.text_bytes(batch.column(3))
                for lo, hi in C.groups(offsets):
                    a = int(offsets[lo])
                    words, row = C.letter_words(data[a : int(offsets[hi])], offsets[lo : hi + 1] - a)
                    cut = np.searchsorted(row, np.arange(hi - lo + 1))
                    for k in range(hi - lo):
                        own = words[cut[k] : cut[k + 1]]
                        for number, places, seeds in found.shared(own):
                            item = found.words[number]
                            width = found.seed_width(item)
                            if least and reach(item, seeds, width) < least:
                                continue
                            if got := tiles(own, item, places, width):
                                for column, v in zip(out, (lo + k, found.ids[number], sum(t[2] for t in got) / len(item), [dict(zip(("doc_word", "item_word", "words"), t)) for t in got])):
                                    column.append(v)
                at = pa.array(out[0], pa.int64())
                yield pa.record_batch([*(batch.column(i).take(at) for i in range(3)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], kind)], names=[*C.ROW_KEY, "item_id", "coverage", "tiles"])

        return texts.mapInArrow(task, schema)

    if not blocks:
        return spark.createDataFrame([], schema)
    if blocks == 1:
        return one(0)
    written = []
    for b in range(blocks):  # one block in the driver and the workers at a time
        with C.workspace(spark, "benchmark-block"):
            written.append(C.keep(one(b), "overlaps"))
    return spark.read.schema(schema).parquet(*(f for df in written for f in df.inputFiles()))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, min_match: int = 5) -> DataFrame:
    """(doc, h1, h2, n_items, item_ids, coverage) of the documents in which an item's coverage reaches the threshold."""
    found = overlaps(docs, benchmark, min_match, threshold).where(F.col("coverage") >= threshold)
    return found.groupBy(*C.ROW_KEY).agg(F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))


def written(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, min_match: int = 5) -> DataFrame:
    """contaminated() as a table."""
    with C.workspace(docs.sparkSession, "decontamination"):
        return C.keep(contaminated(docs, benchmark, threshold, min_match), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, min_match: int = 5) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return C.rows_in(docs, written(docs, benchmark, threshold, min_match).select(*C.ROW_KEY), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    found = written(docs, C.read(spark, sf_dir, "benchmark"))
    joined = docs.select("doc_id", *C.row_key()).join(found, C.ROW_KEY, "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
