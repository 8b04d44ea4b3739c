"""N-gram Jaccard join with parity sketches.

A document's set is its distinct word shingles (A-Z in lower case). Shingles are XOR-hashed into the words of a
parity sketch: two sketches differ in no more words (or bits) than the sets' symmetric difference has members, so the
Hamming distance bounds it from below. Sets are joined by size band. A band whose linked pairs differ in at most D
shingles has sketches of more than D words, so linked sets agree in several words (pigeonhole), and equal words
meet in a packed shuffle. As they agree in more than one, every set lets go of its most common words, in the same order
of words for all, so far that one that two linked sets share is left to both: words of boilerplate make no candidates.
What meets is filtered by the Hamming distance of wider bit sketches and verified on the whole sets. Equal sets are one
class throughout (by a 64-bit hash), and members of one sketch word meet through leaders first, so that large groups of near
copies never become all their pairs; what the leaders leave apart is then compared exhaustively, in blocks.

A document of fewer words than a shingle has its whole word sequence as its only member. Null, empty and blank texts
have no set and link with nothing. Null doc_ids link with nothing and get a null component. Rows that share a doc_id
are judged each by its own text. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm.components import components

SPREAD = 1.6  # largest size of a band over its smallest, in units of that of two linked sets
SKETCH_BITS = 2048  # of the bit sketch that every set has; larger sets have one of more bits, too
#: More words of a sketch than a linked set may differ in, as a share of those: by so much more two linked sets agree.
SPARE = 0.1
#: A sketch word's hash (upper half), class, size, band, and how many words the class may leave out.
ENTRY = ["<u4", "<u8", "<u4", "<u1", "<u2"]
OWNER = ["<u8", "<u8", "<u4"]
DOCS_FIRST = 1 << 24  # bucket numbers from here on hold (doc_id, class, size)
BLOCK = 1024
BLOCK_BYTES = 1 << 25
#: Classes whose sketch words a map task has sent already, as far as it remembers them.
REMEMBER = 1 << 18
#: Bits of the filter on the documents whose sets are needed: 8 MB.
FILTER_BITS = 1 << 26


class Bands:
    """Size bands [lo, hi] such that two linked sets share one; and each band's sketch words and largest difference."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bands, self.edges = num, den, [], {}
        lo = 1
        while not self.bands or self.bands[-1][1] < 1 << 40:
            hi = max(lo, int(lo * SPREAD * den / num))
            differ = 2 * hi * (den - num) // (den + num)
            words = differ + 1 + (int(SPARE * differ) + 2 if differ else 0)
            self.bands.append((lo, hi, words, differ))
            lo = max(lo + 1, -(-num * (hi + 1) // den))

    def of(self, n: int):
        return [(i, w, d) for i, (lo, hi, w, d) in enumerate(self.bands) if lo <= n <= hi]

    def borders(self, words: int) -> np.ndarray:
        if words not in self.edges:
            self.edges[words] = np.array([-(-(k << 64) // words) for k in range(1, words)], np.uint64)
            if len(self.edges) > 64:
                self.edges = {words: self.edges[words]}
        return self.edges[words]

    def most(self, total):
        """Largest symmetric difference of linked sets whose sizes sum to total."""
        return total - 2 * (-(-self.num * total // (self.num + self.den)))


def sets_of(column: pa.Array, width: int):
    """For each row of a text column: its sorted distinct shingle hashes."""
    data, offsets = C.text_bytes(column)
    for lo, hi in C.groups(offsets):
        a = int(offsets[lo])
        local = offsets[lo : hi + 1] - a
        h, row = C.shingles(*C.hashed_words(data[a : int(offsets[hi])], local), width)
        cut = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, np.unique(h[cut[i] : cut[i + 1]])


def class_of(members: np.ndarray) -> int:
    """A signature of a set; 0 for the empty set."""
    if not len(members):
        return 0
    return int(C.mix64(np.array([int(C.mix64(members ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)) ^ len(members)], np.uint64))[0]) or 1


def sketch_keys(members: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One key for each sketch word that may be shared with a linked set, its band, and how many of a band's keys may be left out.

    Linked sets of a band agree in `least` words or more. A set with fewer empty words than that agrees in a filled one,
    and in one more for each by which it has fewer; that many of its keys may go, if all sets let go of the most common first.
    """
    parity = np.zeros(len(members) + 1, np.uint64)
    np.bitwise_xor.accumulate(members, out=parity[1:])
    out = []
    for band, words, differ in bands.of(len(members)):
        cut = np.concatenate(([0], np.searchsorted(members, bands.borders(words)), [len(members)]))
        sketch = parity[cut[1:]] ^ parity[cut[:-1]]
        full = cut[1:] > cut[:-1]
        least, empty = words - differ, words - int(full.sum())
        spare = max(0, least - 1 - empty)
        if empty >= least:  # a linked set might share no word but empty ones
            full[:] = True
        at = np.flatnonzero(full)
        out.append((C.mix64(sketch[at] * np.uint64(C.BASE) + np.uint64(band << 32) + at.astype(np.uint64)), np.full(len(at), band, np.uint8), np.full(len(at), min(spare, 65535), np.uint16)))
    return tuple(np.concatenate(c) for c in zip(*out))


def runs_of(key: np.ndarray, cls: np.ndarray, size: np.ndarray, band: np.ndarray, spare: np.ndarray):
    """(run, class, size, band, spare, members, keys) of keys that two classes or more share; keys of a band with the same members are one run."""
    order = np.lexsort((cls, key))
    key, cls, size, band, spare = (c[order] for c in (key, cls, size, band, spare))
    fresh = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))))
    key, cls, size, band, spare = (c[fresh] for c in (key, cls, size, band, spare))
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(start, len(key)))
    shared = count > 1
    run = C.mix64(np.add.reduceat(C.mix64(cls.copy()), start) * np.uint64(C.BASE) + band[start])
    _, first, alike = np.unique(run[shared], return_index=True, return_counts=True)
    pick = np.flatnonzero(shared)[first]
    n = count[pick]
    keep = np.repeat(start[pick], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(run[pick], n), cls[keep], size[keep], band[keep], spare[keep], np.repeat(n, n), np.repeat(alike, n)


def scan(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One pass over the texts: rows (is_doc, x, class, n, band, spare, members, keys), x a doc_id or a run of classes that share sketch words."""
    spark = docs.sparkSession
    parts = C.partitions(spark)
    buckets = 8 * parts

    def task(batches):
        bands, keys, owners, known = Bands(num, den), C.Packer(buckets, short=True), C.Packer(parts, DOCS_FIRST), set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, members in sets_of(batch.column(1), width):
                cls, n = class_of(members), len(members)
                yield from owners.add(np.array([ids[i]], np.int64).view(np.uint64), np.array([cls], np.uint64), np.array([n], np.uint32))
                if n and cls not in known:  # of equal sets one speaks for all that a task has seen
                    if len(known) >= REMEMBER:
                        known.clear()
                    known.add(cls)
                    k, band, spare = sketch_keys(members, bands)
                    yield from keys.add(k, np.full(len(k), cls, np.uint64), np.full(len(k), n, np.uint32), band, spare)
        yield from keys.flush()
        yield from owners.flush()

    names = ["is_doc", "x", "class", "n", "band", "spare", "members", "keys"]

    def gather(bucket, x, cls, size, *more):
        band = spare = members = keys = np.zeros(len(x), np.int64)
        if bucket < DOCS_FIRST:
            x, cls, size, band, spare, members, keys = runs_of(x, cls, size, *more)
        for a in range(0, len(x), 1 << 16):
            s = slice(a, a + (1 << 16))
            yield pa.record_batch([pa.array(np.full(len(x[s]), bucket >= DOCS_FIRST)), *(pa.array(c[s].view(np.int64) if c.dtype == np.uint64 else c[s].astype(np.int64)) for c in (x, cls, size, band, spare, members, keys))], names=names)

    blobs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(task, C.BLOBS)
    return C.materialize(C.by_bucket(blobs, lambda bucket: OWNER if bucket >= DOCS_FIRST else ENTRY, gather, "is_doc boolean, x long, class long, n long, band long, spare long, members long, keys long", parts), "ngram-scan")


def rare_runs(found: DataFrame) -> DataFrame:
    """(x, class, n) without the most common runs of each class, as far as it may leave out keys, and without runs that nobody else keeps."""
    each = found.where("not is_doc").repartition(C.partitions(found.sparkSession), "class")
    each = each.groupBy("class", "band", "x").agg(F.first("n").alias("n"), F.first("spare").alias("spare"), F.first("members").alias("members"), F.sum("keys").alias("keys"))
    so_far = F.sum("keys").over(Window.partitionBy("class", "band").orderBy(F.desc("members"), "x").rowsBetween(Window.unboundedPreceding, 0))
    kept = C.materialize(each.withColumn("so_far", so_far).where("so_far > spare").select("x", "class", "n"), "ngram-kept")
    return C.materialize(kept.join(kept.groupBy("x").agg(F.count("*").alias("c")).where("c > 1").select("x"), "x", "left_semi"), "ngram-runs")


def wide_sketch(members: np.ndarray) -> bytes | None:
    """A bit sketch of at least as many bits as members, for sets that the common one is too narrow for."""
    bits = (len(members) - 1).bit_length()
    if 1 << bits <= SKETCH_BITS:
        return None
    return np.packbits((np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def distance(a: bytes | None, b: bytes | None) -> int:
    """Hamming distance of two wide sketches, the wider one folded to the narrower's width; 0 where one is missing."""
    if a is None or b is None:
        return 0
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (a, b))
    while len(x) != len(y):
        x, y = (x[::2] ^ x[1::2], y) if len(x) > len(y) else (x, y[::2] ^ y[1::2])
    return int((x ^ y).sum())


def class_sets(docs: DataFrame, owners: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, n, sketch, wide, members) of the wanted classes at least, from one document of each.

    The documents' ids set bits of a bitmap of fixed size; one pass over the texts works on documents whose bit is set, so
    that texts aren't shuffled. Documents that share a bit with one of them add classes that nothing asks for, or a
    class once more; neither changes a result.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1  # the bitmap functions number buckets of positive numbers from 1, and put 0 in a bucket of its own
    one = owners.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    parts = one.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for k, held in parts.collect():  # FILTER_BITS / 8 bytes at most
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(held), np.uint8)
    shared = C.share(docs.sparkSession, bits)
    # place of a bit in that array, by the same functions
    place = ((F.bitmap_bucket_number("b") - 1) * 32768 + F.bitmap_bit_position("b")).alias("place")

    def task(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            text = batch.column(1).filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            rows: list[list] = [[], [], [], [], []]
            for _, members in sets_of(text, width) if len(text) else ():
                parity = np.bincount((members >> np.uint64(53)).astype(np.int64), minlength=SKETCH_BITS) & 1
                for column, v in zip(rows, (np.uint64(class_of(members)).astype(np.int64), len(members), np.packbits(parity.astype(np.uint8)).view(np.int64), wide_sketch(members), members.tobytes())):
                    column.append(v)
                if len(rows[0]) >= 500:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
                    rows = [[], [], [], [], []]
            if rows[0]:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    kinds, names = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()), ["class", "n", "sketch", "wide", "members"]
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(bit.alias("b"), "text").select(place, "text")
    found = texts.mapInArrow(task, "class long, n long, sketch array<long>, wide binary, members binary")
    return C.bucketed(found, "class", "ngram_sets")


def near_sketches(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that the Hamming distance of their sketches lets pass."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("wide").alias(f"w{c}"))
    total = F.col("na") + F.col("nb")
    most = total - 2 * F.ceil(F.lit(num) * total / F.lit(num + den))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)

    def near(batches):
        for batch in batches:
            keep = [distance(x, y) <= m for x, y, m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= most).select("a", "b", "wa", "wb", most.cast("long").alias("most"))
    return C.materialize(met.mapInArrow(near, "a long, b long"), "ngram-pairs")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""

    def task(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("class").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("class").alias("b"), F.col("members").alias("mb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(task, "a long, b long")


def folded(wide: pa.Array) -> np.ndarray | None:
    """Wide sketches as rows of one width, that of the narrowest; None if one is missing."""
    if wide.null_count or not len(wide):
        return None
    raw = wide.to_pylist()
    size = [len(v) for v in raw]
    out = np.empty((len(raw), min(size)), np.uint8)
    for n in set(size):
        at = [i for i, k in enumerate(size) if k == n]
        bits = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), n)
        while bits.shape[1] > out.shape[1]:  # neighbouring bits are one bit of the narrower sketch
            both = bits ^ (bits << np.uint8(1))  # a pair's parity, at its upper bit
            half = np.zeros_like(both)
            for k in range(4):
                half |= ((both >> np.uint8(7 - 2 * k)) & np.uint8(1)) << np.uint8(3 - k)
            bits = (half[:, ::2] << np.uint8(4)) | half[:, 1::2]
        out[at] = bits
    return out.view(np.uint64)


def rest_pairs(here: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of here (x, class, n, comp), pairs of one run whose components differ, as far as sizes and the Hamming distance of sketches allow; in blocks of bounded memory."""
    bands = Bands(num, den)

    def close(n1, s1, c1, k1, w1, n2, s2, c2, k2, w2):
        total = n1[:, None] + n2[None, :]
        ok = (c1[:, None] != c2[None, :]) & (den * np.minimum(n1[:, None], n2[None, :]) >= num * np.maximum(n1[:, None], n2[None, :]))
        i, j = np.nonzero(ok)
        # parts of the sketches are enough to tell most pairs apart; sets too large for the common sketch have wider ones
        parts = [(s1, s2, lo, hi) for lo, hi in ((0, 4), (4, 12), (12, s1.shape[1]))]
        for a in range(0, len(i), 1 << 16):
            p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            most, far = bands.most(total[p, q]), np.zeros(len(p), np.int64)
            for x, y, lo, hi in parts:
                far += np.bitwise_count(x[p, lo:hi] ^ y[q, lo:hi]).sum(axis=1, dtype=np.int64)
                near = far <= most
                p, q, most, far = p[near], q[near], most[near], far[near]
            if w1 is not None and len(p):
                step = max(1, (1 << 20) // w1.shape[1])
                near = np.concatenate([np.bitwise_count(w1[p[b : b + step]] ^ w2[q[b : b + step]]).sum(axis=1, dtype=np.int64) for b in range(0, len(p), step)]) <= most
                p, q = p[near], q[near]
            if len(p):
                x, y = k1[p], k2[q]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def task(batches):
        for run in C.runs(batches, ["x", "a", "b"]):
            a, b = (run.column(c)[0].as_py() for c in ("a", "b"))
            n, c, k, block = (run.column(name).to_numpy() for name in ("n", "comp", "class", "block"))
            s = run.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(run), -1)
            w = folded(run.column("wide").combine_chunks())
            x, y = block == a, block == b
            yield from close(*(v if v is None else v[side] for side in (x, y) for v in (n, s, c, k, w)))

    # a run of more than BLOCK members, or of more bytes of sketches than a task should hold, goes in blocks, each pair of blocks a task of its own
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / (8 * BLOCK_BYTES)))
    sizes = here.groupBy("x").agg(blocks.cast("int").alias("blocks"))
    placed = here.join(sizes, "x").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.join(sets.select("class", "sketch", "wide"), "class").select("x", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "n", "sketch", "wide", "comp", "class", "block")
    parts = C.partitions(here.sparkSession)
    return pairs.repartition(parts, "x", "a", "b").sortWithinPartitions("x", "a", "b").mapInArrow(task, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; sets link where den * |A and B| >= num * |A or B|."""
    with C.workspace(docs.sparkSession, "ngram"):
        return C.keep(_joined(docs, width, num, den, rounds), "ngram-components")


def _joined(docs: DataFrame, width: int, num: int, den: int, rounds: int) -> DataFrame:
    found = scan(docs, width, num, den)
    owners = found.where("is_doc").select(F.col("x").alias("doc_id"), "class", "n")
    runs = rare_runs(found)
    wanted = runs.select("class").distinct()
    sets = class_sets(docs, owners, wanted, width)
    label = wanted.select("class", F.col("class").alias("comp"))
    links = None
    for r in range(rounds + 1):
        here = runs.join(label, "class")
        mixed = here.groupBy("x").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select("x")
        here = C.materialize(here.join(mixed, "x", "left_semi"), "ngram-mixed")
        if r < rounds:  # each member with its run's leader: first the same class in many runs, then another one in each
            lead = here.groupBy("x").agg(F.min_by(F.struct("class", "n", "comp"), F.xxhash64("class", F.lit(r), *["x"] * (r > 0))).alias("l"))
            pairs = here.join(lead, "x").where("comp != l.comp").where(F.lit(den) * F.least("n", "l.n") >= F.lit(num) * F.greatest("n", "l.n"))
            pairs = pairs.select(F.least("class", "l.class").alias("a"), F.greatest("class", "l.class").alias("b")).distinct()
        else:
            pairs = rest_pairs(here, sets, num, den)
        if r < rounds:
            pairs = near_sketches(pairs, sets, num, den)
        more = C.materialize(verified(pairs, sets, num, den), "ngram-links")
        links = more if links is None else links.union(more)
        if r < rounds:
            known = components(links)
            label = C.materialize(wanted.join(known.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("component", "class").alias("comp")), "ngram-labels")
    known = components(links)
    named = owners.join(known.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "class")).alias("comp"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("first"))
    linked = named.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))

    def count(batches):
        for batch in batches:
            n = [len(m) for _, m in sets_of(batch.column(0), width)]
            yield pa.record_batch([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return linked.union(docs.where("doc_id is null").select("text").mapInArrow(count, "doc_id long, n_shingles long, component_id long"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.read(spark, sf_dir, "documents"), width=4, num=85, den=100)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d WHERE r.c < l.b
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM documents d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
