"""Packing of documents into training sequences: shortest pack first over the histogram of lengths.

Documents are cut into pieces of at most `seq_len` ids, the pieces' lengths are counted (a histogram of at most
`seq_len` rows), lengths are placed longest first into the emptiest open packing pattern, and patterns are joined
back to pieces by their rank among the pieces of their length.

Null and empty texts hold the end id alone. A null doc_id is kept. Repeated rows are packed each for itself. An
empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words that a task remembers, some 30 bytes each; beyond it begins anew. Bounds memory, not the result.
MEMO_WORDS = 1_200_000
#: Bytes of a text that are turned into ids at once; cuts lie at white space.
TEXT_BYTES = 2 << 20
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


class WordIds:
    """Ids of white-space delimited words, each looked up once. For tokenizers that drop white space between words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        self.shown = str.maketrans({b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)})
        self.clear()

    def clear(self) -> None:
        """known: sorted hashes of words, and at `at` where each one's ids begin in `flat` (see start)."""
        self.known, self.at, self.flat, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int32), array("I"), array("q", [0])

    def encode(self, word: str) -> list[int]:
        low = word.lower()
        if low.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word):  # one word for the tokenizer's own splitter
            return [t.id for t in self.tok.model.tokenize(low.encode().decode("latin-1").translate(self.shown))]
        return self.tok.encode(word, add_special_tokens=False).ids

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows that lie side by side, and how many each row has."""
        start, end, row = C.word_spans(data, offsets)
        rows = len(offsets) - 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        last = data[end - 1]
        split = ((last == 46) | (last == 44)) & (end - start > 1)
        split &= ALNUM[data[np.maximum(end - 2, 0)]]  # a full stop or comma after a letter stands alone
        times = 1 + split
        first, close, row = np.repeat(start, times), np.repeat(end - split, times), np.repeat(row, times)
        marks = (np.cumsum(times) - 1)[split]
        first[marks], close[marks] = end[split] - 1, end[split]
        hashes = C.mix64(C.span_hashes(C.prefix_hashes(data, "raw"), first, close))
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > MEMO_WORDS:
            self.clear()
        place, new = self.find(unique)
        if len(new):
            raw, first_new = data.tobytes(), len(self.start) - 1
            for w in where[new].tolist():
                self.flat.extend(self.encode(raw[first[w] : close[w]].decode("utf-8", "replace")))
                self.start.append(len(self.flat))
            known = np.concatenate((self.known, unique[new]))
            order = np.argsort(known, kind="stable")
            self.known, self.at = known[order], np.concatenate((self.at, np.arange(first_new, first_new + len(new), dtype=np.int32)))[order]
            place, _ = self.find(unique)
        place = place[back]
        begin, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.uint32)
        size = begin[place + 1] - begin[place]
        before = np.cumsum(size) - size
        out = flat[np.repeat(begin[place] - before, size) + np.arange(int(size.sum()))]
        return out, np.bincount(row, weights=size, minlength=rows).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of known words by their hashes, and which of the hashes are new."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int32), np.arange(len(hashes))
        i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return self.at[i], np.flatnonzero(self.known[i] != hashes)


def pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: its ids and the end id, cut every `seq_len`; with_ids adds them as `ids`."""

    def task(batches):
        words = WordIds(tokenizer_path)
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            ids_of = batch.column(0).to_pylist()
            for lo, hi in C.groups(offsets, TEXT_BYTES):
                a, b = int(offsets[lo]), int(offsets[hi])
                if hi - lo == 1 and b - a > 2 * TEXT_BYTES:  # one very long text, its ids gathered piece by piece
                    held = [words.ids(data[a + p : a + q], np.array([0, q - p]))[0] for p, q in C.pieces(data[a:b])]
                    ids = np.concatenate(held)
                    count = np.array([len(ids)])
                else:
                    ids, count = words.ids(data[a:b], offsets[lo : hi + 1] - a)
                out = np.empty(len(ids) + len(count), "<u4")
                owner = np.repeat(np.arange(len(count)), count)
                out[np.arange(len(ids)) + owner] = ids
                stop = np.cumsum(count + 1)
                out[stop - 1] = end_id
                spans = [(d, s, b0, n) for d, b0, n in zip(ids_of[lo:hi], (stop - count - 1).tolist(), (count + 1).tolist()) for s in range(0, n, seq_len)]
                for k in range(0, len(spans), 4096):
                    rows: list[list] = [[], [], [], [], [], []]
                    for d, s, b0, n in spans[k : k + 4096]:
                        piece = out[b0 + s : b0 + min(n, s + seq_len)]
                        for column, v in zip(rows, (d, s, len(piece), zlib.crc32(piece.tobytes()), n, piece.astype(np.int32) if with_ids else None)):
                            column.append(v)
                    arrays = [pa.array(c, pa.int64()) for c in rows[:5]] + [pa.array(rows[5], pa.list_(pa.int32()))] * with_ids
                    yield pa.record_batch(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, PIECES + ", ids array<int>" * with_ids)


def shortest_pack_first(counts: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used: lengths longest first, each into the open pattern with the most room."""
    open_: dict[int, list] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, held in open_.items() if held and r >= length), default=0)
            if not room:  # new packs, each with as many of this length as fit
                fit = seq_len // length
                whole, rest = divmod(left, fit)
                for n, times in ((fit, whole), (rest, 1)):
                    if n and times:
                        open_[seq_len - n * length].append(((length,) * n, times))
                break
            pattern, times = open_[room].pop()
            if times > left:
                open_[room].append((pattern, times - left))
                times = left
            open_[room - length].append(((*pattern, length), times))
            left -= times
    return [x for r in sorted(open_) for x in open_[r]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the ranks at which a slot begins, that slot's first sequence and its offset there."""
    out: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            out[length].append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


def ranked(found: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Ranks pieces of one length without gathering a length in one task: range partitions give ranks within, counts by partition give the rest."""

    def task(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            length = batch.column("length").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1], [True]))) if len(length) else np.zeros(1, int)
            rank = np.zeros(len(length), np.int64)
            for a, b in zip(cut[:-1], cut[1:]):
                k = int(length[a])
                rank[a:b] = seen[k] + np.arange(b - a)
                seen[k] += int(b - a)
            yield pa.record_batch([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], names=[*batch.schema.names, "part", "rank"])

    spark = found.sparkSession
    dealt = found.repartitionByRange(C.partitions(spark), "length", "doc_id", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "start", "ids_crc32")
    out = C.materialize(dealt.mapInArrow(task, found.schema.simpleString()[7:-1].replace(":", " ") + ", part int, rank long"), "ranked")
    base, sums = {}, defaultdict(int)
    # one row for each partition and each change of length: at most partitions + seq_len rows
    for part, length, n in sorted(tuple(r) for r in out.groupBy("part", "length").count().collect()):
        base[part, length] = sums[length]
        sums[length] += n
    return out, base


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    found = C.materialize(pieces(docs, tokenizer_path, seq_len, end_id, with_ids), "pieces")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # at most seq_len rows
    rows, base = ranked(found)
    shared = C.share(docs.sparkSession, (slots(shortest_pack_first(counts, seq_len)), base))

    def task(batches):
        table, first = shared.value
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy() for c in ("length", "part", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k, p in set(zip(length.tolist(), part.tolist())):
                at = np.flatnonzero((length == k) & (part == p))
                r = rank[at] + first[p, k]
                begins, seqs, offs = table[k]
                i = np.searchsorted(begins, r, "right") - 1
                sequence[at], offset[at] = seqs[i] + r - begins[i], offs[i]
            keep = [n for n in batch.schema.names if n not in ("part", "rank")]
            yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return rows.mapInArrow(task, PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, **settings) -> DataFrame:
    """pack() with its rows written; what it needed meanwhile is deleted."""
    with C.workspace(docs.sparkSession, "packing"):
        return C.keep(pack(docs, tokenizer_path, **settings), "packed")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(C.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
