"""Hard negatives: for an anchor and one of its nearest rows of the same label, the highest rows of other labels that score nearly as high.

Components become integers, and a score is an integer inner product. To score few rows, each row keeps a one-bit code: its
vector, turned by random signs and Hadamard transforms, by signs alone, together with how well that code lies along the
vector (their cosine). An anchor, turned likewise, is cut into bit planes, whose popcounts with a code give the cosine of
anchor and code, off by no more than the cut's own length. Anchor and vector both lie at known angles from the code, so by
Cauchy and Schwarz their cosine lies in an interval that needs no chance: it is certain. Rows whose interval can't reach an
anchor's list so far, or its window of scores, are left out; all others are scored in integers. So results are exact, and
only the work depends on how the vectors lie (README says how many rows are left out where).

Anchors go in blocks of some ANCHORS, each against all rows where these lie: a block is sent to the tasks, every task
keeps its best few for each anchor, and those meet by anchor. Two passes a block: positives first, then negatives, whose
windows follow from the positives' scores. Equal anchors are searched for once, and their results repeated.

Rows with a null vec_id, label or vector, or a null or non-finite component, take no part. Zero and empty vectors score 0.
Vectors of different lengths are not compared. Rows that share a vec_id are rows of their own; an anchor isn't its own
positive, a copy of it is. Of equal scores the smaller vec_id comes first. Scores beyond a long count as its bounds. An
empty table, or one without anchors, gives no rows; other columns are ignored. Labels are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm.op08_embeddings import hadamard

#: Anchors of a block (each is sent with its vector), anchors and rows of a tile, bits of an anchor's turned components.
ANCHORS, TILE_ANCHORS, TILE_ROWS, PLANES = 8192, 256, 2048, 4
#: Inner products below it are exact in doubles; the bounds of a score; what stands for no score.
EXACT, MOST, NONE = 1 << 52, (1 << 63) - 1, -(1 << 63)
#: Share by which an interval is widened, so that rounding of doubles never leaves a row out.
SLACK = 1e-9
PREPARED = "vec_id long, label long, x binary, code binary, align double, norm double"


def turned(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """Rows as unit vectors (zero stays zero), turned at random but always alike, padded to a power of two."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length()) if x.shape[1] else 1
    most = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x / np.where(most > 0, most, 1)
    length = np.linalg.norm(y, axis=1, keepdims=True)
    y /= np.where(length > 0, length, 1)
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return y


def coded(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of turned rows, as 64-bit words, and their cosine with the rows."""
    return words(y > 0), np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


def words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


class Anchors:
    """Anchors of one vector length: integers, norms and bit planes."""

    def __init__(self, number: np.ndarray, vec_id: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.number, self.vec_id, self.label, self.x = number, vec_id, label, x
        self.norm = norms(x)
        y = turned(x)
        self.width = y.shape[1]
        self.low = y.min(axis=1, initial=0.0)
        self.step = np.maximum(y.max(axis=1, initial=0.0) - self.low, 1e-12) / ((1 << PLANES) - 1)
        cut = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = np.stack([words((cut >> k) & 1 == 1) for k in range(PLANES)])
        self.sum = cut.sum(axis=1)
        self.off = np.linalg.norm(y - (self.low[:, None] + self.step[:, None] * cut), axis=1) + SLACK

    def part(self, at: slice) -> Anchors:
        out = object.__new__(Anchors)
        out.width = self.width
        for name in ("number", "vec_id", "label", "x", "norm", "low", "step", "sum", "off"):
            setattr(out, name, getattr(self, name)[at])
        out.planes = self.planes[:, at]
        return out

    def bounds(self, code: np.ndarray, align: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score that each anchor can have with each row, from the rows' codes alone."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        both = np.zeros((len(self.x), len(code)), np.int64)
        for k in range(PLANES):
            for w in range(code.shape[1]):
                both += np.bitwise_count(self.planes[k][:, w, None] & code[None, :, w]).astype(np.int64) << k
        t = (self.low[:, None] * (2 * ones - self.width)[None, :] + self.step[:, None] * (2 * both - self.sum[:, None])) / np.sqrt(self.width)
        t_low, t_high = np.clip(t - self.off[:, None], -1, 1), np.clip(t + self.off[:, None], -1, 1)
        a, rest = align[None, :], np.sqrt(np.maximum(0, 1 - align**2))[None, :]
        t = np.clip(a, t_low, t_high)
        high = a * t + rest * np.sqrt(np.maximum(0, 1 - t**2))
        t = np.clip(-a, t_low, t_high)
        low = a * t - rest * np.sqrt(np.maximum(0, 1 - t**2))
        with np.errstate(over="ignore", invalid="ignore"):
            size = self.norm[:, None] * norm[None, :]
            low, high = (low - SLACK) * size - 1, (high + SLACK) * size + 1
        return np.clip(np.nan_to_num(low, nan=-np.inf), -MOST, MOST), np.clip(np.nan_to_num(high, nan=np.inf), -MOST, MOST)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows of finite doubles, infinite where they have no double."""
    most = np.abs(x).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))


def products(a: np.ndarray, a_norm: np.ndarray, b: np.ndarray, b_norm: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole doubles, as longs; beyond these, their bounds."""
    with np.errstate(over="ignore", invalid="ignore"):
        fits = float(a_norm.max(initial=0.0)) * float(b_norm.max(initial=0.0)) < EXACT
    if fits:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: [[int(v) for v in row] for row in x.tolist()]
    right = whole(b)
    return np.array([[max(-MOST, min(MOST, sum(map(int.__mul__, p, q)))) for q in right] for p in whole(a)], np.int64).reshape(len(a), len(b))


class Best:
    """The `k` highest scores of each anchor, ties by vec_id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id, self.own = k, np.full((n, k), NONE, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """score: for anchors `at` by rows, NONE where a row doesn't count."""
        k = min(self.k, score.shape[1])
        if not k or not len(at):
            return
        bar = np.maximum(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k], self.least()[at])
        i, j = np.nonzero((score >= bar[:, None]) & (score != NONE))
        if not len(i):
            return
        rows, held = np.unique(i), self.score.shape[1]
        old = at[rows]
        who = np.concatenate((np.repeat(rows, held), i))
        s = np.concatenate((self.score[old].ravel(), score[i, j]))
        d = np.concatenate((self.id[old].ravel(), ids[j]))
        o = np.concatenate((self.own[old].ravel(), own[i, j]))
        order = np.lexsort((d, ~s, who))  # ~s falls as s rises
        who, s, d, o = who[order], s[order], d[order], o[order]
        begin = np.searchsorted(who, rows)
        take = begin[:, None] + np.arange(held)[None, :]
        self.score[old], self.id[old], self.own[old] = s[take], d[take], o[take]


def prepared(vectors: DataFrame, scale: int) -> DataFrame:
    """PREPARED rows of vectors (vec_id, label, embedding) that take part."""

    def task(batches):
        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *batch.column(3).to_pylist()])
            with np.errstate(over="ignore"):
                flat = np.clip(np.floor(flat * float(scale)), -np.finfo(float).max, np.finfo(float).max)
            size = np.diff(ends)
            rows: list = [None] * len(size)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = flat[ends[at][:, None] + np.arange(d)[None, :]]
                code, align = coded(turned(x))
                for i, v, c, a, n in zip(at.tolist(), x, code, align.tolist(), norms(x).tolist()):
                    rows[i] = (v.astype("<f8").tobytes(), c.tobytes(), min(a, 1.0), n)
            x, code, align, norm = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.binary()), pa.array(code, pa.binary()), pa.array(align, pa.float64()), pa.array(norm, pa.float64())], names=["vec_id", "label", "x", "code", "align", "norm"])

    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return vectors.where(fine).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("x"), F.size(x).alias("d")).mapInArrow(task, PREPARED)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _tiles(batches):
    """Rows as (length, vec_id, label, x, code, align, norm), by tiles of one vector length."""
    for batch in batches:
        for k in range(0, len(batch), TILE_ROWS):
            part = batch.slice(k, TILE_ROWS)
            size = np.array([len(v) // 8 for v in part.column(2).to_pylist()], np.int64)
            for d in np.unique(size).tolist():
                rows = part.filter(pa.array(size == d))
                code = _matrix(rows.column(3), np.uint64)
                x = _matrix(rows.column(2), "<f8") if d else np.zeros((len(rows), 0))
                yield d, *(rows.column(c).to_numpy() for c in (0, 1)), x, code, *(rows.column(c).to_numpy() for c in (4, 5))


def _scored(part: Anchors, tile: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a tile that an anchor wants, and the scores with them, NONE where it doesn't."""
    rows = np.flatnonzero(wanted.any(axis=0))
    scores = np.where(wanted[:, rows], products(part.x, part.norm, tile[3][rows], tile[6][rows]), NONE)
    return rows, scores


def searched(rows: DataFrame, anchors, slots: int, keep: int) -> DataFrame:
    """(anchor, slot, score, vec_id, own): each task's best `keep` rows for each anchor of a broadcast block and each slot.

    anchors: {vector length: (Anchors, windows)}. windows is None in the search for positives: one slot, rows of the same
    label, `own` telling an anchor itself (or a copy). Else it is (low, high), each anchors by slots: rows of other labels with a score between.
    """

    def task(batches):
        blocks = anchors.value
        best = {d: [Best(len(a.number), keep) for _ in range(slots)] for d, (a, _) in blocks.items()}
        for tile in _tiles(batches):
            d, vec_id, label, x, code, align, norm = tile
            if d not in blocks:
                continue
            whole, windows = blocks[d]
            for k in range(0, len(whole.number), TILE_ANCHORS):
                at = np.arange(k, min(k + TILE_ANCHORS, len(whole.number)))
                part = whole.part(slice(k, k + TILE_ANCHORS))
                low, high = part.bounds(code, align, norm)
                same = part.label[:, None] == label[None, :]
                if windows is None:
                    held, scores = _scored(part, tile, same & (high >= best[d][0].least()[at].astype(float)[:, None]))
                    own = (part.vec_id[:, None] == vec_id[held][None, :]) & (scores != NONE)
                    for i, j in np.argwhere(own):
                        own[i, j] = np.array_equal(part.x[i], x[held[j]])
                    best[d][0].add(at, scores, vec_id[held], own)
                    continue
                least, most = windows[0][at], windows[1][at]
                bar = np.stack([np.maximum(least[:, s], b.least()[at]) for s, b in enumerate(best[d])], axis=1)
                held, scores = _scored(part, tile, ~same & (high >= bar.min(axis=1).astype(float)[:, None]) & (low <= most.max(axis=1).astype(float)[:, None]))
                none = np.zeros(scores.shape, bool)
                for s in range(slots):
                    inside = (scores >= least[:, s, None]) & (scores <= most[:, s, None]) & (least[:, s, None] <= most[:, s, None])
                    best[d][s].add(at, np.where(inside, scores, NONE), vec_id[held], none)
        for d, (whole, _) in blocks.items():
            for s, b in enumerate(best[d]):
                i, j = np.nonzero(b.score != NONE)
                for c in range(0, len(i), 1 << 15):
                    p, q = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                    yield pa.record_batch([pa.array(whole.number[p]), pa.array(np.full(len(p), s, np.int32)), pa.array(b.score[p, q]), pa.array(b.id[p, q]), pa.array(b.own[p, q])], names=["anchor", "slot", "score", "vec_id", "own"])

    return rows.mapInArrow(task, "anchor long, slot int, score long, vec_id long, own boolean")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(anchor, slot, best): the k best over all tasks, as an array."""
    entry = F.struct(F.bitwise_not("score").alias("order"), "vec_id", "score", "own")
    return found.groupBy("anchor", "slot").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("best"))  # some k for each task


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors (vec_id, label, embedding) for which `anchors`, a condition on vec_id and label, holds.

    Negatives score at least `low` and at most `high` hundredths of their positive.
    """
    with C.workspace(vectors.sparkSession, "hard-negatives"):
        return C.keep(_mined(vectors, anchors, positives, negatives, low, high, scale, block), "hard-negatives")


def _mined(vectors: DataFrame, chosen: Column, positives: int, negatives: int, low: int, high: int, scale: int, block: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = C.materialize(prepared(vectors, scale), "prepared")
    names = ["vec_id", "label", "x"]
    listed = rows.where(chosen).groupBy(*names).agg(F.count("*").alias("times"))
    blocks = -(-listed.count() // block)
    result = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not blocks:
        return result
    listed = C.materialize(listed.withColumns({"anchor": F.xxhash64(F.lit(3), *names), "block": F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")}), "anchors")
    scan = rows.coalesce(C.partitions(spark))  # each task answers for every anchor
    for b in range(blocks):
        # some `block` rows, sent to every task
        table = listed.where(F.col("block") == b).select("vec_id", "label", "x", "times").orderBy("vec_id", "label", "x").toArrow()
        if not len(table):
            continue
        number = np.arange(len(table))
        size = np.array([len(v) // 8 for v in table.column("x").to_pylist()])
        held = {}
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            part = table.take(pa.array(at)).combine_chunks()
            x = _matrix(part.column("x").combine_chunks(), "<f8") if d else np.zeros((len(part), 0))
            held[d] = Anchors(number[at], part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x)
        first = C.share(spark, {d: (a, None) for d, a in held.items()})
        near = _ranked(searched(scan, first, 1, positives + 1), positives + 1)
        own = F.array_position(F.transform("best", lambda e: e["own"]), True)  # the anchor itself, where it is among them
        near = near.select("anchor", F.slice(F.filter("best", lambda e, i: i + 1 != own), 1, positives).alias("best"))
        near = C.materialize(near.select("anchor", F.posexplode("best").alias("slot", "p")).select("anchor", "slot", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score")), "positives")
        got = near.toArrow()  # a few for each anchor of the block
        least, most = np.ones((len(table), positives), np.int64), np.zeros((len(table), positives), np.int64)
        scores = got.column("positive_score").to_pylist()
        where = (got.column("anchor").to_numpy(), got.column("slot").to_numpy())
        least[where] = [max(-MOST, min(MOST, -(-low * s // 100))) for s in scores]
        most[where] = [max(-MOST, min(MOST, high * s // 100)) for s in scores]
        second = C.share(spark, {d: (a, (least[a.number], most[a.number])) for d, a in held.items()})
        far = _ranked(searched(scan, second, positives, negatives), negatives)
        far = far.select("anchor", "slot", F.posexplode("best").alias("pos", "n")).select("anchor", "slot", (F.col("pos") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"), F.col("n.score").alias("negative_score"))
        ids = spark.createDataFrame(pa.table({"anchor": number, "anchor_id": table.column("vec_id"), "times": table.column("times")}))
        both = near.join(far, ["anchor", "slot"]).join(ids, "anchor").withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        result = result.union(C.materialize(both.select(*result.columns), "negatives"))
    return result


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(C.read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5
"""
