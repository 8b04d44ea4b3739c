"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted one feature at a time, round after round, on the log-odds; each feature's trees add up to
one lookup table over its bins, and the strongest pairs of features get small two-way tables of what is left. A score
is a sum of table entries, taken for a whole batch at once.

Learned from about `cap` labelled documents. Null and empty texts have the features of an empty text and a
score too. Without labels (or with one class alone) every score is the share of 1 (0.5 without any). Repeated rows
score alike; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm.training import labelled_ids

NAMES = [
    "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "digits", "upper", "symbols", "marks", "stops",
    "bars", "lines", "distinct_lines", "non_ascii", "byte_entropy", "repeats", "bangs", "words_per_line", "odd_ends",
]
BINS, SIDE = 64, 8


def text_features(data: np.ndarray) -> np.ndarray:
    """NAMES of one text; vectorised over its bytes, in pieces, so that a long text takes little more memory than its words."""
    out = np.zeros(len(NAMES))
    n = len(data)
    if not n:
        return out
    count, held, chars, longs, odd = np.zeros(256), [], 0, 0, 0
    for a, b in C.pieces(data):
        part = data[a:b]
        count += np.bincount(part, minlength=256)
        start, end, _ = C.word_spans(part, np.array([0, b - a]))
        held.append(C.mix64(C.span_hashes(C.prefix_hashes(part, "folded"), start, end)))
        last = part[end - 1]
        chars, longs, odd = chars + int((end - start).sum()), longs + int((end - start > 12).sum()), odd + int(((last < 48) & (last != 44) & (last != 46)).sum())
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    marks = count[[33, 44, 46, 58, 59, 63]].sum()
    digits = count[48:58].sum()
    symbols = count[33:127].sum() - digits - count[65:91].sum() - count[97:123].sum() - marks
    p = count[count > 0] / n
    breaks = np.concatenate(([0], np.flatnonzero(data == 10) + 1, [n]))
    out[[0, 6, 7, 8, 9, 10, 11, 14, 15, 17]] = (np.log1p(n), digits / n, count[65:91].sum() / max(1, letters), symbols / n, marks / n, count[46] / n, count[124] / n, count[128:].sum() / n, -(p * np.log2(p)).sum(), count[33] / n)
    out[12] = np.log1p(len(breaks) - 1)
    if len(words := np.concatenate(held)):
        kinds, times = np.unique(words, return_counts=True)
        out[[1, 2, 3, 4, 5]] = np.log1p(len(words)), chars / len(words), longs / len(words), len(kinds) / len(words), times.max() / len(words)
        pairs = words[1:] * np.uint64(C.BASE) + words[:-1]
        out[16] = 1 - len(np.unique(pairs)) / max(1, len(pairs))
        out[18] = len(words) / (len(breaks) - 1)
        out[19] = odd / len(words)
    lines = []
    for lo, hi in C.groups(breaks):
        at = breaks[lo : hi + 1] - breaks[lo]
        lines.append(C.span_hashes(C.prefix_hashes(data[breaks[lo] : breaks[hi]]), at[:-1], at[1:]))
    out[13] = len(np.unique(np.concatenate(lines))) / (len(breaks) - 1)
    return out


def with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns and x, the features of `text`."""
    kind = pa.list_(pa.float64(), len(NAMES))

    def task(batches):
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(batch.num_columns - 1))
            x = np.concatenate([text_features(data[a:b]) for a, b in zip(offsets, offsets[1:])] or [np.zeros(0)])
            yield pa.record_batch([*batch.columns[:-1], pa.FixedSizeListArray.from_arrays(pa.array(x), len(NAMES)).cast(pa.list_(pa.float64()))], names=[*keep, "x"])

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(task, rows.select(*keep).schema.simpleString()[7:-1].replace(":", " ") + ", x array<double>")


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Leaf values by bin of a tree with few leaves over ordered bins, from each bin's summed gradient and weight."""
    out, spans = np.zeros(len(gradient)), [(0, len(gradient))]
    g, w = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(weight)))

    def gain(a, b):
        cut = np.arange(a + 1, b)
        if not len(cut):
            return 0.0, a
        left, right = (g[cut] - g[a]) ** 2 / (w[cut] - w[a] + ridge), (g[b] - g[cut]) ** 2 / (w[b] - w[cut] + ridge)
        left[(w[cut] - w[a] < 0.5) | (w[b] - w[cut] < 0.5)] = -np.inf
        total = left + right - (g[b] - g[a]) ** 2 / (w[b] - w[a] + ridge)
        return float(total.max()), int(cut[total.argmax()])

    while len(spans) < leaves:
        best = max(((*gain(a, b), a, b) for a, b in spans), default=None)
        if best is None or best[0] <= 1e-9:
            break
        _, cut, a, b = best
        spans.remove((a, b))
        spans += [(a, cut), (cut, b)]
    for a, b in spans:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + ridge)
    return out


class Additive:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, pairs: int = 6, pair_rounds: int = 40):
        self.base, self.tables, self.pair_tables = 0.0, None, {}
        if not len(y) or y.min() == y.max():
            self.base = 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, SIDE + 1)[1:-1])) for c in x.T]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        logit = np.full(len(y), self.base)
        for _ in range(rounds):
            for j, b in enumerate(bins):
                p = 1 / (1 + np.exp(-logit))
                step = rate * shallow_tree(np.bincount(b, y - p, len(self.tables[j])), np.bincount(b, p * (1 - p), len(self.tables[j])), 3)
                self.tables[j] += step
                logit += step[b]
        small = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T)]
        cells = {(i, j): small[i] * SIDE + small[j] for i, j in combinations(range(x.shape[1]), 2)}
        p = 1 / (1 + np.exp(-logit))
        power = {k: (np.bincount(c, y - p, SIDE * SIDE) ** 2 / (np.bincount(c, p * (1 - p), SIDE * SIDE) + 1)).sum() for k, c in cells.items()}
        chosen = sorted(power, key=lambda k: (-power[k], k))[:pairs]
        self.pair_tables = {k: np.zeros(SIDE * SIDE) for k in chosen}
        for _ in range(pair_rounds):
            for k in chosen:
                c = cells[k]
                p = 1 / (1 + np.exp(-logit))
                grid, weight = np.bincount(c, y - p, SIDE * SIDE).reshape(SIDE, SIDE), np.bincount(c, p * (1 - p), SIDE * SIDE).reshape(SIDE, SIDE)
                rows = shallow_tree(grid.sum(1), weight.sum(1), 2)  # a split of one feature, then of the other on each side
                step = np.zeros((SIDE, SIDE))
                for v in np.unique(rows):
                    side = rows == v
                    step[side] = shallow_tree(grid[side].sum(0), weight[side].sum(0), 2, 4.0)
                step = rate * step.ravel()
                self.pair_tables[k] += step
                logit += step[c]

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        if self.tables is not None:
            for e, t, c in zip(self.edges, self.tables, x.T):
                logit += t[np.searchsorted(e, c, "right")]
            small = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for k in self.pair_tables for j in k}
            for (i, j), t in self.pair_tables.items():
                logit += t[small[i] * SIDE + small[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(docs: DataFrame, ids: DataFrame) -> Additive:
    """Fits on the documents of ids (doc_id, y), a bounded sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # ids: about cap rows
    found = with_features(rows, ["doc_id", "y"]).toArrow()
    x, y = np.array(found["x"].combine_chunks().flatten(), float).reshape(-1, len(NAMES)), np.array(found["y"], float)
    order = np.lexsort((*x.T, y, np.array(found["doc_id"])))
    return Additive(x[order], y[order])


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of BINS entries by feature

    def task(batches):
        m = shared.value
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            x = np.array([text_features(data[a:b]) for a, b in zip(offsets, offsets[1:])]).reshape(-1, len(NAMES))
            yield pa.record_batch([batch.column(0), pa.array(m.score(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    with C.workspace(spark, "quality"):
        model = fit(docs, labelled_ids(C.read(spark, sf_dir, "labels"), "quality", 8000, 3, 1))
    return score(docs, model).select("doc_id", (F.pmod(C.salted_id(), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
