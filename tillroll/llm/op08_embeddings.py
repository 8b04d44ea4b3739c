"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are rotated by random signs and fast Hadamard transforms; a hash is the nearest signed axis, a bucket is a few of
them in one of several tables. How many follows from the number of vectors a label has (SETTINGS), so that a bucket's
expected size doesn't grow with the table. Each vector also looks into the buckets that it missed most narrowly
(multiprobe). Pairs of one bucket and label are verified by cosine in double precision. Equal vectors are one row with
a multiplicity. A pair that meets in several buckets counts in the smallest of them alone, so links need no
distinct; a bucket gives one row for each of its vectors that has links (their number, and its root in the bucket's
spanning forest), never its pairs. Large buckets are cut into blocks, and pairs of blocks are tasks of their own.

Over 3,000 random pairs of 64 dimensions exactly at cosine 0.98 the search missed none with any of SETTINGS; tests measure
the recall of each, and results against brute force. Vectors count as equal by two 64-bit hashes. Null labels, null or
zero vectors, and vectors with null or non-finite components link with nothing, as do vectors of different lengths and
null vec_ids. Rows that share a vec_id count as vectors of their own. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm.components import components

BLOCK = 2048
PROBES = 3
#: Expected size of a bucket, if vectors lay evenly, up to which a label takes so few hashes; tables by hashes.
FILL = 64
SETTINGS = {1: 3, 2: 4, 3: 6, 4: 10}
#: Labels whose sizes are broadcast, 12 bytes each.
MOST_LABELS = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x / np.sqrt(n)


def bucket_keys(x: np.ndarray, salt: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 5) -> np.ndarray:
    """For each row of x (unit vectors, a power of two long): by table, its own bucket's key and those of its probes."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    near = min(3, d - 1)
    out = np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        axes, gaps = [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            order = np.argsort(-size, axis=1, kind="stable")[:, : near + 1]
            rows = np.arange(n)[:, None]
            axes.append(order * 2 + (y[rows, order] > 0))
            gaps.append(size[rows, order[:, :1]] - size[rows, order[:, 1:]])
        home = np.stack([a[:, 0] for a in axes], axis=1)
        rank = np.argsort(np.concatenate(gaps, axis=1), axis=1, kind="stable")
        for p in range(probes):
            code = home.copy()
            if p and near:
                pick = rank[:, min(p - 1, rank.shape[1] - 1)]
                which, place = pick // near, pick % near + 1
                code[np.arange(n), which] = np.stack([a[np.arange(n), place] for a in axes], axis=1)[np.arange(n), which]
            key = np.full(n, t + 1, np.uint64)
            for j in range(hashes):
                key = C.mix64(key * np.uint64(C.BASE) + code[:, j].astype(np.uint64))
            out[:, t, p] = C.mix64(key ^ salt)
    return out.reshape(n, -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two of their largest component, which changes no cosine and no digit: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def hashed(classes: DataFrame, dims: int) -> DataFrame:
    """(id, times, vector, keys) of classes (id, times, label, embedding, hashes)."""
    width = 1 << max(1, (dims - 1).bit_length())

    def task(batches):
        for batch in batches:
            rows, hashes = batch.column(3), batch.column(4).to_numpy()
            size = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = rows.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            x = np.zeros((len(size), width))
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            x[row, place] = flat
            x = scaled(x)
            salt = C.mix64(batch.column(2).to_numpy().view(np.uint64) * np.uint64(C.BASE) + size.astype(np.uint64))
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            keys: list = [None] * len(size)
            for h in np.unique(hashes).tolist():
                at = np.flatnonzero(hashes == h)
                for i, k in zip(at.tolist(), bucket_keys(unit[at], salt[at], SETTINGS[h], h, PROBES).view(np.int64)):
                    keys[i] = k
            bytes_ = x[row, place].astype("<f8").tobytes()
            end = (np.cumsum(size) * 8).tolist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([bytes_[a:b] for a, b in zip([0, *end], end)], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "times", "vector", "keys"])

    return classes.select("id", "times", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>"), F.col("hashes").cast("int")).mapInArrow(task, "id long, times long, vector binary, keys array<long>")


def bucket_links(key: int, split: bool, ids, times, x, keys, home, left, right, least: float):
    """Of one bucket's vectors (or two blocks of it, left and right): which have links there, how many, and each one's root."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    own = np.arange(keys.shape[1]) % PROBES == 0
    links, parent = np.zeros(len(ids), np.int64), list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for s in range(0, len(left), 512):
        rows = left[s : s + 512]
        close = (x[rows] @ x[right].T) / (norm[rows][:, None] * norm[right][None, :]) >= least
        close &= home[rows][:, None] | home[right][None, :]
        if not split:
            close &= rows[:, None] < right[None, :]
        i, j = np.nonzero(close)
        i, j = rows[i], right[j]
        for c in range(0, len(i), 4096):
            p, q = i[c : c + 4096], j[c : c + 4096]
            same = (keys[p][:, :, None] == keys[q][:, None, :]) & (own[None, :, None] | own[None, None, :])
            first = np.where(same.any(axis=2), keys[p], np.iinfo(np.int64).max).min(axis=1) == key
            p, q = p[first], q[first]
            np.add.at(links, p, times[q])
            np.add.at(links, q, times[p])
            for u, v in zip(p.tolist(), q.tolist()):
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
    got = np.flatnonzero(links)
    return got, links[got], [root(i) for i in got.tolist()]


def linked(entries: DataFrame, least: float) -> DataFrame:
    """(id, links, root): for each bucket block, its vectors with links there."""
    names = ["key", "a", "b", "id", "times", "home", "block", "vector", "keys"]

    def task(batches):
        out: list[list] = [[], [], []]
        for run in C.runs(batches, ["key", "a", "b"]):
            column = {c: run.column(c).combine_chunks() for c in names}
            ids, times, block = (column[c].to_numpy() for c in ("id", "times", "block"))
            home = column["home"].to_numpy(zero_copy_only=False)
            key, a, b = (int(column[c][0].as_py()) for c in ("key", "a", "b"))
            x = np.frombuffer(b"".join(column["vector"].to_pylist())).reshape(len(ids), -1)
            keys = column["keys"].flatten().to_numpy().reshape(len(ids), -1)
            got, links, roots = bucket_links(key, a != b, ids, times, x, keys, home, np.flatnonzero(block == a), np.flatnonzero(block == b), least)
            for held, v in zip(out, (ids[got], links, ids[roots] if len(roots) else ids[:0])):
                held.append(v)
            if sum(map(len, out[0])) >= 1 << 14:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["id", "links", "root"])
                out = [[], [], []]
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["id", "links", "root"])

    parts = C.partitions(entries.sparkSession)
    return entries.select(names).repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b", "id").mapInArrow(task, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, fill: int = FILL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label). fill: expected size of a bucket beyond which a label takes one more hash."""
    with C.workspace(vectors.sparkSession, "embeddings"):
        return C.keep(_linked(vectors, least, fill), "embedding-links")


def _linked(vectors: DataFrame, least: float, fill: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", fine.alias("fine"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "label", "embedding").alias("h2"))
    good = rows.where("fine")
    classes = C.materialize(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "vector-classes")
    classes = _numbered(classes)
    dims = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    cells = 2.0 * (1 << max(1, (dims - 1).bit_length()))
    hashes = F.least(F.lit(max(SETTINGS)), F.greatest(F.lit(1), F.ceil(F.log(F.col("n") / F.lit(float(fill))) / F.lit(float(np.log(cells))))))
    by_label = C.materialize(classes.groupBy("label").agg(F.count("*").alias("n")).select("label", hashes.cast("int").alias("hashes")), "label-sizes")
    few = by_label.count() <= MOST_LABELS  # else a join that splits a hot label
    table = C.materialize(hashed(classes.join(F.broadcast(by_label) if few else by_label, "label"), dims), "vector-keys")
    keyed = table.select("id", F.posexplode("keys").alias("pos", "key")).select("id", "key", (F.col("pos") % PROBES == 0).alias("home")).groupBy("id", "key").agg(F.max("home").alias("home"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("h")).where("n > 1 and h").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "key", "home", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    found = C.materialize(linked(pairs.join(table, "id"), least), "vector-links")
    totals = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "id"})
    summed = C.materialize(classes.select("h1", "h2", "id", "first_id", "times").join(totals, "id", "left").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "class-links")
    named = summed.groupBy("component").agg(F.min("first_id").alias("c"))  # a component's smallest vec_id
    summed = summed.join(named, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), "c", F.lit(True).alias("fine"))
    out = rows.select("vec_id", "h1", "h2", "fine").join(summed, ["h1", "h2", "fine"], "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _numbered(classes: DataFrame) -> DataFrame:
    """classes with `id`, a number of their own: rows that share a vec_id are classes of their own. It follows from where a class stands in the written table, which is read anew without another number."""
    return C.materialize(classes.withColumn("id", F.monotonically_increasing_id()), "numbered-classes")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n WHERE r.c < l.b
), m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT e.vec_id, CAST(count(l.a) AS BIGINT) AS n_links, any_value(m.c) AS component_id, any_value(m.c) = e.vec_id AS kept
FROM embeddings e JOIN m ON m.n = e.vec_id LEFT JOIN l ON l.a = e.vec_id GROUP BY e.vec_id
"""
