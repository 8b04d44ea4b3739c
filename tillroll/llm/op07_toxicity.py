"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

Terms are all words of a text (runs of letters, marks and digits, case-folded); none is left out. A term's weight is its
damped frequency, times its inverse document frequency over the whole corpus, times a relevance factor of at least 1 that
grows with how far the term leans to the toxic examples (1 + z**2, z its deviation from their share in standard errors).
Examples with equal terms are one entry of the index, with its votes; entries of like strongest terms share a block.
For a batch of documents the postings of rarer terms are added up for every entry; for frequent terms each block's largest
weights bound what its entries can still gain, and only blocks whose bound reaches the k-th neighbour found so far are
scored: the k nearest are exact, and entries as near as the k-th all count. Votes weighted by squared similarity give a
share of toxic examples, which a binned monotone table, learned by leaving each example itself out, turns into a calibrated
score; the entries that voted are the evidence.

Learned from about `cap` labelled documents. A document that shares no term with any example, as null and empty texts,
gets the share of toxic examples among those without terms, or among all examples where each has some. Without labels every
score is 0. Repeated rows score alike; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
Terms are told apart by a 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm.training import labelled_ids

BLOCK = 64
#: Documents that are compared at once.
BATCH = 64
#: Terms in more than one of so many entries are held as rows of a matrix, the rest as postings.
OFTEN = 16
LEVELS = 20
DF_BLOCK = 1 << 14


def counted(column: pa.Array):
    """For runs of rows of a text column: first row, number of rows, and (row, term, count) for each term of a row."""
    data, offsets = C.text_bytes(column)
    for lo, hi in C.groups(offsets):
        a = int(offsets[lo])
        term, row = C.letter_words(data[a : int(offsets[hi])], offsets[lo : hi + 1] - a)
        order = np.lexsort((term, row))
        term, row = term[order], row[order]
        cut = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])))) if len(term) else np.zeros(0, np.int64)
        yield lo, hi - lo, row[cut], term[cut], np.diff(np.append(cut, len(term))).astype(np.int32)


def placed(terms: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray):
    """(row, place, count) of the terms that stand in the sorted array `terms`."""
    if not len(terms):
        return row[:0], row[:0], count[:0]
    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    known = terms[at] == term
    return row[known], at[known], count[known]


def frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted terms stands."""
    shared, parts = C.share(docs.sparkSession, terms), C.partitions(docs.sparkSession)

    def task(batches):
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, _, *found in counted(batch.column(0)):
                n += np.bincount(placed(shared.value, *found)[1], minlength=len(n))
        for a in range(0, len(n), DF_BLOCK):
            if n[a : a + DF_BLOCK].any():
                yield pa.record_batch([pa.array([a // DF_BLOCK], pa.int32()), pa.array([n[a : a + DF_BLOCK].tobytes()], pa.binary())], names=["bucket", "blob"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = np.frombuffer(blob.as_py(), np.int64)
                sums[k] = sums[k] + n if k in sums else n
        for k, n in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["bucket", "blob"])

    df = np.zeros(len(terms), np.int64)
    if len(terms):
        for k, blob in docs.select("text").mapInArrow(task, C.BLOBS).repartition(parts, "bucket").mapInArrow(add, C.BLOBS).collect():  # 8 bytes a term of the examples
            df[k * DF_BLOCK : (k + 1) * DF_BLOCK] = np.frombuffer(bytes(blob), np.int64)
    return df


def monotone(shares: list, toxic: list, votes: list) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of bins of shares, and the toxic rate of each, never falling."""
    if not len(shares):
        return np.array([0.5]), np.array([0.0, 1.0])
    x, a, n = np.array(shares), np.array(toxic), np.array(votes)
    edges = np.append(np.linspace(0, 1, LEVELS + 1)[1:-1], [0.999, np.inf])  # equal shares stay together
    bins = np.searchsorted(edges, x, "left")
    groups = [[float(edges[i]), float(a[bins == i].sum()) + 0.02, float(n[bins == i].sum()) + 0.1] for i in np.unique(bins)]
    pooled: list = []
    for g in groups:
        pooled.append(g)
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            top, a, n = pooled.pop()
            pooled[-1] = [top, pooled[-1][1] + a, pooled[-1][2] + n]
    return np.array([g[0] for g in pooled[:-1]]), np.array([g[1] / g[2] for g in pooled])


def relevance(term: np.ndarray, entry: np.ndarray, rate: np.ndarray, n_terms: int) -> np.ndarray:
    """A factor for each term: 1 + z**2 for terms that lean to toxic entries, else 1; rate: each entry's toxic share."""
    n, p = len(rate), rate.mean() if len(rate) else 0.0
    held, toxic = np.bincount(term, minlength=n_terms), np.bincount(term, rate[entry], n_terms)
    z = (toxic - p * held) / np.sqrt(p * (1 - p) * held * (1 - held / max(1, n)) + 2)
    return 1 + np.maximum(z, 0) ** 2


class Examples:
    """The block-max index over entries: distinct examples with their votes."""

    def __init__(self, terms: np.ndarray, df: np.ndarray, n_docs: int, examples: list[tuple[int, int, np.ndarray, np.ndarray]], k: int = 15):
        """examples: (doc_id, y, places of terms in order, their counts)."""
        self.terms, self.k = terms, k
        alike: dict[bytes, list] = {}
        for doc, y, place, count in examples:
            key = hashlib.blake2b(place.tobytes() + count.tobytes(), digest_size=16).digest() if len(place) else b""
            alike.setdefault(key, [(), place, count])[0] += ((y, doc),)
        blank = [y for y, _ in alike.pop(b"", [()])[0]]
        y = [e[1] for e in examples]
        self.blank = (sum(blank) + 0.05) / (len(blank) + 1) if blank else (sum(y) / len(y) if y else 0.0)
        held, vectors = [e[0] for e in alike.values()], [e[1:] for e in alike.values()]
        rate = np.array([sum(v[0] for v in e) / len(e) for e in held])
        size = [len(v[0]) for v in vectors]
        entry, term = np.repeat(np.arange(len(held), dtype=np.int32), size), np.concatenate([np.zeros(0, np.int32), *(v[0] for v in vectors)])
        self.weight = (np.log((1 + n_docs) / (1 + df)) + 1) * relevance(term, entry, rate, len(terms))
        w = self.unit(entry, term, np.concatenate([np.zeros(0, np.int32), *(v[1] for v in vectors)]), len(held))
        del alike, vectors
        # entries in order of their strongest term, then the next
        strong = np.zeros((len(held), 2), np.int64)
        cut = np.concatenate(([0], np.cumsum(size))).astype(int)
        for e, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            top = term[a:b][np.argsort(-w[a:b], kind="stable")[:2]]
            strong[e] = top[0], top[-1]
        order = np.lexsort((strong[:, 1], strong[:, 0]))
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order))
        entry = back[entry]
        held = [held[i] for i in order]
        self.toxic, self.votes = np.array([float(sum(v[0] for v in e)) for e in held]), np.array([float(len(e)) for e in held])
        self.ids = np.array([min(v[1] for v in e) for e in held], np.int64)
        self.blocks = -(-len(held) // BLOCK)
        n_terms, slots = len(terms), self.blocks * BLOCK
        order = np.lexsort((entry, term))
        entry, term, w = entry[order], term[order], w[order]
        number = np.bincount(term, minlength=n_terms)
        often = np.flatnonzero(number > len(held) / OFTEN)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), slots))
        common = self.row[term] >= 0
        self.dense[self.row[term[common]], entry[common]] = w[common]
        self.top = self.dense.reshape(len(often), self.blocks, BLOCK).max(axis=2) if slots else np.zeros((len(often), 0))
        self.entry, self.w = entry[~common].astype(np.int32), w[~common]
        number[often] = 0
        self.start = np.concatenate(([0], np.cumsum(number)))
        self.levels, self.table = monotone([], [], [])
        self.calibrate()

    def unit(self, row: np.ndarray, place: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Weights of terms, scaled to length 1 within each of n rows."""
        w = (1.0 + np.log(np.maximum(count, 1))) * self.weight[place]
        return w / np.sqrt(np.bincount(row, w * w, n))[row]

    def nearest(self, row: np.ndarray, place: np.ndarray, w: np.ndarray, n: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry, cosine) of the k nearest entries of each of n vectors, and all as near as the k-th, nearest first; a cosine of 0 doesn't count. without: an entry for each vector, or -1, that is left out."""
        slots = self.blocks * BLOCK
        rare = self.row[place] < 0
        t, r = place[rare], row[rare]
        size = self.start[t + 1] - self.start[t]
        at = np.repeat(self.start[t] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        s = np.bincount(np.repeat(r, size) * slots + self.entry[at], self.w[at] * np.repeat(w[rare], size), n * slots).astype(float, copy=False).reshape(n, slots)
        q = np.zeros((n, len(self.dense)))
        q[row[~rare], self.row[place[~rare]]] = w[~rare]
        bound = s.reshape(n, self.blocks, BLOCK).max(axis=2) + q @ self.top
        done, floor = np.zeros(bound.shape, bool), np.full((n, 1), 1e-12)
        few = min(self.blocks, 2 + self.k // BLOCK)
        want = bound >= np.partition(bound, self.blocks - few, axis=1)[:, [self.blocks - few]]  # the most promising blocks first
        while (want := want & ~done & (bound >= floor - 1e-12)).any():
            for b in np.flatnonzero(want.any(axis=0)).tolist():
                own = np.flatnonzero(want[:, b])
                s[own, b * BLOCK : (b + 1) * BLOCK] += q[own] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
            done |= want
            seen = np.where(np.repeat(done, BLOCK, axis=1), s, 0.0)
            if without is not None:
                alone = np.flatnonzero(without >= 0)
                seen[alone, without[alone]] = 0.0
            if slots >= self.k:
                floor = np.maximum(np.partition(seen, slots - self.k, axis=1)[:, [slots - self.k]], 1e-12)
            want = ~done
        if not done.any():
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        r, e = np.nonzero(seen >= floor - 1e-12 * (floor > 1e-12))
        order = np.lexsort((e, -seen[r, e], r))
        r, e = r[order], e[order]
        return r, e, seen[r, e]

    def calibrate(self) -> None:
        """Pools the shares that each example gets from the others into a monotone table of toxic rates."""
        if not self.blocks:
            return
        term = np.concatenate([np.repeat(np.flatnonzero(self.row < 0), np.diff(self.start)[self.row < 0]), np.repeat(np.flatnonzero(self.row >= 0), (self.dense > 0).sum(axis=1))])
        entry = np.concatenate([self.entry, np.nonzero(self.dense)[1]])
        w = np.concatenate([self.w, self.dense[self.dense > 0]])
        order = np.argsort(entry, kind="stable")
        term, entry, w = term[order], entry[order], w[order]
        shares, toxic, votes = [], [], []
        for a in range(0, len(self.votes), BATCH):
            b = min(len(self.votes), a + BATCH)
            lo, hi = np.searchsorted(entry, [a, b])
            own = np.arange(a, b)
            alone = self.votes[own] == 1
            r, e, s = self.nearest(entry[lo:hi] - a, term[lo:hi], w[lo:hi], b - a, np.where(alone, own, -1))
            for label, n in ((1.0, self.toxic[own]), (0.0, self.votes[own] - self.toxic[own])):
                less = (e == own[r]) & ~alone[r]  # the example itself doesn't vote
                yes, all_ = np.bincount(r, s**2 * (self.toxic[e] - label * less), b - a), np.bincount(r, s**2 * (self.votes[e] - less), b - a)
                fit = (n > 0) & (all_ > 0)
                shares += (yes[fit] / all_[fit]).tolist()
                toxic += (label * n[fit]).tolist()
                votes += n[fit].tolist()
        self.levels, self.table = monotone(shares, toxic, votes)

    def judge(self, row: np.ndarray, place: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, list]:
        """Scores of n documents, and the doc_ids of the examples that voted, nearest first. Rows are in order."""
        score, evidence = np.full(n, float(self.blank)), [[]] * n
        for a in range(0, n if self.blocks else 0, BATCH):
            b = min(n, a + BATCH)
            lo, hi = np.searchsorted(row, [a, b])
            if lo == hi:
                continue
            r, e, s = self.nearest(row[lo:hi] - a, place[lo:hi], self.unit(row[lo:hi] - a, place[lo:hi], count[lo:hi], b - a), b - a)
            yes, all_ = np.bincount(r, s**2 * self.toxic[e], b - a), np.bincount(r, s**2 * self.votes[e], b - a)
            some = np.flatnonzero(all_ > 0)
            score[a + some] = self.table[np.searchsorted(self.levels, yes[some] / all_[some], "left")]
            cut = np.searchsorted(r, np.arange(b - a + 1))
            for i in some.tolist():
                evidence[a + i] = self.ids[e[cut[i] : cut[i + 1]]]
        return score, evidence


def toxicity(docs: DataFrame, examples: DataFrame, k: int = 15) -> DataFrame:
    """(doc_id, h1, h2, score, evidence) of every document, h1 and h2 as in C.ROW_KEY; examples: (doc_id, y), a bounded sample of labelled documents."""
    with C.workspace(docs.sparkSession, "toxicity"):
        return C.keep(_scored(docs, examples, k), "toxicity-scores")


def fit(docs: DataFrame, examples: DataFrame, k: int = 15) -> Examples:
    """The index over the examples' documents; document frequencies are counted over all docs."""

    def terms(batches):
        for batch in batches:
            for lo, n, row, term, count in counted(batch.column(2)):
                cut = np.searchsorted(row, np.arange(n + 1))
                parts = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
                yield pa.record_batch([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array([term[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([count[a:b].tobytes() for a, b in parts], pa.binary())], names=["doc_id", "y", "terms", "counts"])

    own = docs.select("doc_id", "text").join(F.broadcast(examples.select("doc_id", F.col("y").cast("int"))), "doc_id").select("doc_id", "y", "text")  # about cap rows
    rows = sorted((d, y, bytes(t), bytes(c)) for d, y, t, c in own.mapInArrow(terms, "doc_id long, y int, terms binary, counts binary").collect())
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[2], np.uint64) for r in rows)]))
    vectors = [(d, y, np.searchsorted(known, np.frombuffer(t, np.uint64)).astype(np.int32), np.frombuffer(c, np.int32)) for d, y, t, c in rows]
    del rows
    return Examples(known, frequencies(docs, known), docs.count(), vectors, k)


def _scored(docs: DataFrame, examples: DataFrame, k: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *C.row_key()[1:], "text")
    shared = C.share(docs.sparkSession, fit(docs, C.materialize(examples, "examples"), k))

    def task(batches):
        index = shared.value
        for batch in batches:
            for lo, n, *found in counted(batch.column(3)):
                score, evidence = index.judge(*placed(index.terms, *found), n)
                yield pa.record_batch([*(batch.column(c).slice(lo, n) for c in range(3)), pa.array(score), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "score", "evidence"])

    return docs.mapInArrow(task, "doc_id long, h1 long, h2 long, score double, evidence array<long>")


def score_documents(docs: DataFrame, labels: DataFrame, cap: int = 6000) -> DataFrame:
    with C.workspace(docs.sparkSession, "toxicity-labels"):
        return C.keep(_scored(docs, labelled_ids(labels, "toxic", cap, 4, 2), 15), "toxicity-scores")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
    return found.select("doc_id", (F.pmod(C.salted_id(), F.lit(4)) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
