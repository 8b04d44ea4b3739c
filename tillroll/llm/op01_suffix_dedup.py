"""Removal of long repeated byte strings by a sampled, hash-compared suffix sort.

Which suffixes are sorted. Every `least`-byte string holds an anchor, the leftmost of its smallest ANCHOR-byte hashes, so
equal strings hold equal anchors at equal places. The starts of strings that share an anchor form one context. Contexts
meet by anchor in a packed shuffle, most anchors meet no other and end there; equal contexts are repeated as a whole,
and only different contexts of one anchor are looked into.

How they are compared. Prefix polynomial hashes give the hash of any substring, so a binary search finds the common
extension of two suffixes in logarithmically many steps; a merge sort with that comparison orders the suffixes at which
runs of equal strings begin, neighbours in that order have the longest common extensions, and every extension that
removes text there is checked byte by byte (a collision falls back to bytes). That holds for contexts that differ in
part. Contexts that are equal as a whole, as in copies, are decided by 128 bits of two unlike hashes, with no byte check,
and so are the strings of anchors with more than LARGE different contexts, counted by a 128-bit hash.

No task holds an unbounded group: hot anchors (a licence line in different surroundings) are known before anything is
shuffled, from their different contexts in one row of SAMPLED, and their contexts are dealt out by context instead of by
anchor, and then counted by string. That count decides the way alone: an anchor that it doesn't find, which has some
SAMPLED times LARGE contexts at most, is compared, or counted, all the same.

Every text counts as UTF-8 bytes, null and shorter texts have nothing to remove, and strings never cross rows. Rows that
share doc_id and text are documents of their own that repeat each other. A null doc_id is kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

ANCHOR = 200
#: Anchor, context in two hashes, the two hashes that tell a row, start, number of starts, and whether the map task saw the context again.
ENTRY = ["<u8", "<u8", "<u8", "<u8", "<u8", "<u4", "<u4", "<u1"]
#: Bucket numbers from here on hold contexts of hot anchors, dealt out by context.
HOT = 1 << 23
#: Bucket numbers from here on hold contexts that a map task has seen several times, which need no meeting.
DIRECT = 1 << 24
#: Contexts of one anchor beyond which their strings are counted by hash.
LARGE = 4096
#: One row in so many is read to find the hot anchors.
SAMPLED = 16
#: Hot anchors at most, which are broadcast (8 bytes each); beyond them an anchor has less than a MOST_HOT-th of all contexts.
MOST_HOT = 1 << 20
WHOLE, SINGLE, SAMPLE = 0, 1, 2
#: Bytes of a very long text that are looked at at once.
STEP = 2 * C.GROUP_BYTES
#: Two hashes of doc_id and text, which tell a row; rows that share them are equal.
ROW, KEYS = ["r1", "r2"], "r1 long, r2 long"


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the smallest value in each window."""
    n, cur, at, span = len(h) - width + 1, h, np.arange(len(h)), 1
    while 2 * span <= width:
        later = cur[span:] < cur[:-span]
        cur, at, span = np.where(later, cur[span:], cur[:-span]), np.where(later, at[span:], at[:-span]), 2 * span
    if span < width:
        s = width - span
        at = np.where(cur[s : s + n] < cur[:n], at[s : s + n], at[:n])
    return at[:n]


def contexts(data: np.ndarray, offsets: np.ndarray, least: int, anchor: int):
    """Anchor hash, two context hashes, row, first start and number of starts, for rows that lie side by side."""
    n = len(data)
    if n < least:
        return None
    prefix = C.prefix_hashes(data)
    grams = C.mix64(C.span_hashes(prefix, np.arange(n - anchor + 1), np.arange(anchor, n + 1)))
    place = sliding_argmin(grams, least - anchor + 1)
    start = np.arange(len(place))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + least <= offsets[row + 1]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1]))))
    stop = np.append(first[1:], len(place))
    first, stop = first[inside[first]], stop[inside[first]]
    end, view = stop - 1 + least, memoryview(np.ascontiguousarray(data))
    check = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), end.tolist())), np.uint64, len(first))
    return grams[place[first]], C.mix64(C.span_hashes(prefix, first, end)), check, row[first], first - offsets[row[first]], stop - first


def met(anchor, ctx, check, doc, doc2, start, count, again, large: int = LARGE, hot: bool = False):
    """Of contexts with one bucket of anchors: (doc, doc2, start, count, kind, group) of those that are repeated or need a closer look. hot: their anchors have more contexts in other buckets, so all need it."""
    order = np.lexsort((start, doc, check, ctx, anchor))
    anchor, ctx, check, doc, doc2, start, count, again = (c[order] for c in (anchor, ctx, check, doc, doc2, start, count, again))
    new_a = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new_c = new_a | np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (check[1:] != check[:-1])))
    at_c = np.flatnonzero(new_c)
    times = np.diff(np.append(at_c, len(ctx)))
    several = (times > 1) | (np.add.reduceat(again.astype(np.int64), at_c) > 0)
    of_a = np.cumsum(new_a)[at_c] - 1
    kinds = np.bincount(of_a)[of_a]
    whole = np.repeat(several, times)
    look = (kinds > 1) | hot
    pick = at_c[look]
    group = np.where((kinds[look] > large) | hot, np.uint64(0), anchor[pick] | np.uint64(1))  # group 0: one of too many
    n = int(whole.sum())
    return [(doc[whole], doc2[whole], start[whole], count[whole], np.full(n, WHOLE), np.zeros(n, np.uint64)), (doc[pick], doc2[pick], start[pick], count[pick], np.where(several[look], SAMPLE, SINGLE), group)]


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes a and b, at most `most`, by binary search over hashes."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = C.span_hashes(prefix, a, a + mid) == C.span_hashes(prefix, b, b + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def suffix_order(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Merge sort of the suffixes data[start:stop], all merges of a level at once; equal suffixes stay in order."""

    def smaller(a, b):  # suffix a before suffix b
        most = np.minimum(stop[a] - start[a], stop[b] - start[b])
        k = extension(prefix, start[a], start[b], most)
        end = k >= most
        x, y = data[np.minimum(start[a] + k, len(data) - 1)], data[np.minimum(start[b] + k, len(data) - 1)]
        return np.where(end, stop[a] - start[a] < stop[b] - start[b], x < y)

    n, order, width = len(start), np.arange(len(start)), 1
    while width < n:
        slot = np.arange(n)
        base = slot // (2 * width) * (2 * width)
        left = slot - base < width
        other = np.where(left, base + width, base)
        size = np.where(left, np.clip(n - base - width, 0, width), width)
        low, high = np.zeros(n, np.int64), size.copy()
        while (open_ := np.flatnonzero(low < high)).size:  # how many of the other run go before
            mid = (low[open_] + high[open_]) // 2
            mine, theirs = order[open_], order[other[open_] + mid]
            before = np.where(left[open_], smaller(theirs, mine), ~smaller(mine, theirs))
            low[open_[before]], high[open_[~before]] = mid[before] + 1, mid[~before]
        merged = np.empty(n, np.int64)
        merged[base + np.where(left, slot - base, slot - base - width) + low] = order
        order, width = merged, 2 * width
    return order


def repeated(texts: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(text, first, last): starts of `least`-byte strings of texts that also stand in another of them, or elsewhere in the same."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    prefix = C.prefix_hashes(data)
    number = np.diff(offsets) - least + 1
    owner = np.repeat(np.arange(len(texts)), number)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + offsets[owner]
    h = C.span_hashes(prefix, start, start + least)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    run = np.cumsum(new) - 1
    partner = np.empty(len(h), np.int64)  # the first with this hash; for that one, the second
    partner[order] = order[first[run]]
    several = first[times > 1]
    partner[order[several]] = order[several + 1]
    twin = np.zeros(len(h), bool)
    twin[order] = times[run] > 1
    at = np.flatnonzero(twin)
    if not len(at):
        return []
    # runs of starts whose partners run along with them
    begin = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (partner[at[1:]] != partner[at[:-1]] + 1) | (owner[partner[at[1:]]] != owner[partner[at[:-1]]])))
    lead = at[begin]
    length = np.diff(np.append(np.flatnonzero(begin), len(at)))
    subject = np.unique(np.concatenate((lead, partner[lead])))
    s, e = start[subject], offsets[owner[subject] + 1]
    ranked = suffix_order(data, prefix, s, e)
    near = extension(prefix, s[ranked[:-1]], s[ranked[1:]], np.minimum(e[ranked[:-1]] - s[ranked[:-1]], e[ranked[1:]] - s[ranked[1:]]))
    reach, mate = np.zeros(len(subject), np.int64), np.zeros(len(subject), np.int64)
    for one, two in ((ranked[:-1], ranked[1:]), (ranked[1:], ranked[:-1])):
        better = near > reach[one]
        reach[one[better]], mate[one[better]] = near[better], two[better]
    out, raw = [], data.tobytes()
    for i, n in zip(np.searchsorted(subject, lead).tolist(), length.tolist()):
        a, b, want = int(s[i]), int(s[mate[i]]), n - 1 + least
        t = int(owner[subject[i]])
        if reach[i] >= want and raw[a : a + want] == raw[b : b + want]:
            out.append((t, a - int(offsets[t]), a - int(offsets[t]) + n - 1))
        else:  # a collision: bytes decide
            out += [(t, p - int(offsets[t]), p - int(offsets[t])) for p in range(a, a + n) if elsewhere(raw, offsets, p, least)]
    return out


def elsewhere(raw: bytes, offsets: np.ndarray, p: int, least: int) -> bool:
    """Whether the string at p also starts at another place of the texts that lie side by side in raw, within one of them."""
    want, q = raw[p : p + least], raw.find(raw[p : p + least])
    while q >= 0:
        if q != p and q + least <= offsets[np.searchsorted(offsets, q, "right")]:
            return True
        q = raw.find(want, q + 1)
    return False


def once(columns: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a map task's contexts (anchor, context, its other hash, ...): which stand for their like, whether there are more of their like, and the rest."""
    keys = columns[:3]
    order = np.lexsort(keys[::-1])
    new = np.concatenate(([True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)))
    return order[new], np.diff(np.append(np.flatnonzero(new), len(order))) > 1, order[~new]


def read_contexts(batches, least: int, anchor: int, step: int):
    """Contexts of rows (r1, r2, text): anchor, two context hashes, r1, r2, first start, number of starts."""
    for batch in batches:
        keys = [batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)]
        data, offsets = C.text_bytes(batch.column(2))
        for lo, hi in C.groups(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            if hi - lo > 1 or b - a <= 2 * step:
                pieces = [(a, b, offsets[lo : hi + 1] - a, 0)]
            else:  # one very long text, in pieces that share least-1 bytes
                pieces = [(p, min(b, p + step + least - 1), np.array([0, min(b, p + step + least - 1) - p]), p - a) for p in range(a, b, step)]
            for p, q, inner, shift in pieces:
                found = contexts(data[p:q], inner, least, anchor)
                if found is not None:
                    h, ctx, check, row, start, count = found
                    yield h, ctx, check, keys[0][lo:hi][row], keys[1][lo:hi][row], (start + shift).astype(np.uint32), count.astype(np.uint32)


def hot_anchors(rows: DataFrame, least: int, anchor: int) -> np.ndarray:
    """The anchors that have more than LARGE different contexts in one row of SAMPLED, in order; the MOST_HOT largest of them."""
    step = STEP

    def task(batches):
        held: list = []

        def pairs():
            if held:
                pair = np.unique(np.stack([np.concatenate(c) for c in zip(*held)], axis=1).view("u8,u8"))
                held.clear()
                yield pa.record_batch([pa.array(np.ascontiguousarray(pair[c]).view(np.int64)) for c in pair.dtype.names], names=["anchor", "ctx"])

        for found in read_contexts(batches, least, anchor, step):
            held.append(found[:2])
            if sum(len(c[0]) for c in held) >= C.FLUSH:
                yield from pairs()
        yield from pairs()

    some = rows.where(F.pmod("r1", F.lit(SAMPLED)) == 0).where(F.octet_length("text") >= least).select(*ROW, "text")
    often = some.mapInArrow(task, "anchor long, ctx long").distinct().groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > LARGE)
    return np.sort(often.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor").toArrow().column(0).to_numpy().view(np.uint64))


def scan(rows: DataFrame, least: int, anchor: int) -> DataFrame:
    """(r1, r2, start, count, kind, group): contexts that are repeated as a whole, and those to look into. Of equal contexts in a map task one goes to the anchor's bucket, so that a text with very many copies is spread."""
    parts, step = C.partitions(rows.sparkSession), STEP
    hot = C.share(rows.sparkSession, hot_anchors(rows, least, anchor))

    def task(batches):
        packer, spread, direct = C.Packer(8 * parts), C.Packer(8 * parts, HOT), C.Packer(parts, DIRECT)
        held: list = []

        def deal():
            if not held:
                return
            columns = tuple(np.concatenate(c) for c in zip(*held))
            held.clear()
            first, again, rest = once(columns)
            is_hot = np.isin(columns[0][first], hot.value)
            cool, again = first[~is_hot], again.astype(np.uint8)
            yield from packer.add(*(c[cool] for c in columns), again[~is_hot])
            h, ctx, *others = (c[first[is_hot]] for c in columns)
            yield from spread.add(ctx, h, *others, again[is_hot])
            h, ctx, check, k1, k2, start, count = (c[rest] for c in columns)
            yield from direct.add(k1, ctx, check, k1, k2, start, count, np.ones(len(k1), np.uint8))

        for found in read_contexts(batches, least, anchor, step):
            held.append(found)
            if sum(len(c[0]) for c in held) >= C.FLUSH:
                yield from deal()
        yield from deal()
        yield from packer.flush()
        yield from spread.flush()
        yield from direct.flush()

    def gather(bucket, *columns):
        if bucket >= DIRECT:
            _, _, _, doc, doc2, start, count, _ = columns
            found = [(doc, doc2, start, count, np.full(len(doc), WHOLE), np.zeros(len(doc), np.uint64))]
        elif bucket >= HOT:
            ctx, h, *others = columns
            found = met(h, ctx, *others, hot=True)
        else:
            found = met(*columns, large=LARGE)
        for doc, doc2, start, count, kind, group in found:
            for a in range(0, len(doc), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.record_batch([pa.array(doc[s].view(np.int64)), pa.array(doc2[s].view(np.int64)), pa.array(start[s].astype(np.int64)), pa.array(count[s].astype(np.int64)), pa.array(kind[s].astype(np.int32)), pa.array(group[s].view(np.int64))], names=[*ROW, "start", "count", "kind", "group"])

    blobs = rows.where(F.octet_length("text") >= least).select(*ROW, "text").mapInArrow(task, C.BLOBS)
    return C.materialize(C.by_bucket(blobs, ENTRY, gather, f"{KEYS}, start long, count long, kind int, `group` long", parts), "contexts")


def look_into(rows: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(r1, r2, start, stop) of what single contexts repeat from others of their anchor."""
    spans = found.where((F.col("kind") != WHOLE) & (F.col("group") != 0)).select(*ROW, "start", "count", "kind", "group").distinct()
    wanted = spans.groupBy(*ROW).agg(F.collect_list(F.struct("start", "count", "kind", "group")).alias("spans"))

    def cut(batches):
        names, kinds = ["group", *ROW, "start", "single", "piece"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r1, r2, text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                raw = text.as_py().encode()
                for sp in held:
                    p = sp["start"]
                    for column, v in zip(out, (sp["group"], r1, r2, p, sp["kind"] == SINGLE, raw[p : p + sp["count"] - 1 + least])):
                        column.append(v)
                if len(out[0]) >= 4096:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                    out = [[] for _ in names]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def compare(batches):
        held: list = []

        def done():
            spans = [(held[t][0], held[t][1], held[t][2] + first, held[t][2] + last + least) for t, first, last in repeated([h[4] for h in held], least) if held[t][3]]
            return pa.record_batch([pa.array([s[i] for s in spans], pa.int64()) for i in range(4)], names=[*ROW, "start", "stop"])

        now, size = None, 0
        for batch in batches:
            for group, r1, r2, start, single, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if group != now and size > C.GROUP_BYTES:
                    yield done()
                    held, size = [], 0
                now = group
                held.append((r1, r2, start, single, piece))
                size += len(piece)
        if held:
            yield done()

    parts = C.partitions(rows.sparkSession)
    pieces = rows.select(*ROW, "text").join(wanted, ROW).mapInArrow(cut, f"`group` long, {KEYS}, start long, single boolean, piece binary")
    return pieces.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(compare, f"{KEYS}, start long, stop long")


def look_into_large(rows: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """The same for anchors of very many contexts: a 128-bit hash of each string, counted with partial aggregates instead of gathered."""
    spans = found.where((F.col("kind") != WHOLE) & (F.col("group") == 0)).select(*ROW, "start", "count", "kind").distinct()
    wanted = spans.groupBy(*ROW).agg(F.collect_list(F.struct("start", "count", "kind")).alias("spans"))

    def strings(batches):
        for batch in batches:
            for r1, r2, text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                raw = text.as_py().encode()
                for sp in held:
                    at = range(sp["start"], sp["start"] + sp["count"])
                    digests = pa.array([hashlib.blake2b(raw[p : p + least], digest_size=16).digest() for p in at], pa.binary())
                    yield pa.record_batch([digests, *(pa.array([r] * len(at), pa.int64()) for r in (r1, r2)), pa.array(at, pa.int64()), pa.array([sp["kind"] == SINGLE] * len(at))], names=["h", *ROW, "start", "single"])

    each = C.materialize(rows.select(*ROW, "text").join(wanted, ROW).mapInArrow(strings, f"h binary, {KEYS}, start long, single boolean"), "strings")
    twice = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return each.where("single").join(twice, "h").select(*ROW, "start", (F.col("start") + least).alias("stop"))


def covered(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as maximal runs in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    return list(zip(start[new].tolist(), reach[last].tolist()))


def remove_repeats(docs: DataFrame, least: int = 400, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept) of every document: removed spans (start, stop) in bytes, and the bytes that stay. Its working tables go with the workspace that it is called in."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2"))
    found = scan(rows, least, anchor)
    spans = found.where(F.col("kind") == WHOLE).select(*ROW, "start", (F.col("start") + F.col("count") - 1 + least).alias("stop")).union(look_into(rows, found, least))
    if not found.where((F.col("kind") != WHOLE) & (F.col("group") == 0)).isEmpty():
        spans = spans.union(look_into_large(rows, found, least))
    by_row = spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def task(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            spans, size, gone, runs, kept = batch.column(2), [], [], [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                body, held = data[a:b], spans[i]
                out = covered(*(held.values.field(c).to_numpy() for c in ("start", "stop"))) if held.is_valid else []
                size.append(b - a)
                gone.append(sum(e - s for s, e in out))
                runs.append([{"start": s, "stop": e} for s, e in out])
                edge = [0, *(x for r in out for x in r), b - a]
                kept.append(b"".join(body[s:e].tobytes() for s, e in zip(edge[::2], edge[1::2])))
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    joined = rows.join(by_row, ROW, "left").select(F.col("doc_id").cast("long"), "text", "spans")
    return joined.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,stop:long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with C.workspace(spark, "suffixes"):
        found = remove_repeats(C.read(spark, sf_dir, "documents"))
        return C.keep(found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "suffix-digests")
