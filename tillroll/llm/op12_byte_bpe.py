"""Byte-level BPE: texts to token ids and back, by a rank file.

The tiktoken library does the merges, with a local rank file and the vocabulary's own pattern; a text's matches are encoded
one by one, without special tokens, as the library does. Long texts go in pieces: no match of the pattern goes on from a
character that is no white space to one that is, and nothing in it looks back, so a text may be cut before white space that
follows something else without changing a match. Of a very long run of white space, on which the pattern's look-ahead runs
out of stack, all but the last character are one match by themselves (all of it, at a text's end). Decoding joins the
tokens' raw bytes, so that bytes that are no whole characters survive.

Null text counts as empty and has no ids. A row whose ids are null, or hold a null or an id that the rank file lacks, decodes to
null. Rows, repeated ones too, stand for themselves; an empty table gives no rows; columns not asked for are ignored. A
task holds about CHUNK characters of texts and their ids, or one row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

#: Characters encoded at once; white space from which a run is a piece of its own; characters (or ids) of an output batch; the largest rank file.
PIECE, RUN, CHUNK, MOST_BYTES = 1 << 16, 1 << 12, 1 << 20, 1 << 26
# Unicode white space, as the pattern's \s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_LONG = re.compile(f"[{WHITE}]{{{RUN},}}")


def read_ranks(path: str) -> bytes:
    """A rank file's bytes; they are broadcast, so their size is bounded."""
    with open(path, "rb") as file:
        raw = file.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return raw


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, raw.splitlines()))}


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """A text's pieces in order, cut between matches, and whether a piece is one match (of white space alone)."""
    if len(text) < RUN:
        yield text, False
        return
    at = 0
    for run in _LONG.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from _cut(text, at, run.start())
        yield text[run.start() : end], True
        at = end
    yield from _cut(text, at, len(text))


def _cut(text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
    while at < end:
        edge = _EDGE.search(text, at + PIECE, end) if end - at > PIECE else None
        to = edge.start() if edge else end
        yield text[at:to], False
        at = to


class Codec:
    """Encodes texts and decodes ids by a rank file's bytes and a pattern."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = ranks_of(raw)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        found = [np.array(self.encoding._encode_single_piece(part), np.int32) if whole else self.encoding.encode_to_numpy(part).astype(np.int32) for part, whole in parts(text)]
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The tokens' bytes; null where an id is unknown."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            return None
        out = []
        for k in range(0, len(ids), CHUNK):
            part = ids[k : k + CHUNK]
            size = self.length[part]
            before = np.cumsum(size) - size
            out.append(self.flat[np.repeat(self.start[part] - before, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)


def _codec(shared, pattern: str, held: dict) -> Codec:
    if "codec" not in held:
        held["codec"] = Codec(shared.value, pattern)
    return held["codec"]


def encode(docs: DataFrame, ranks, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and ids: their texts' token ids. ranks: the broadcast bytes of a rank file (C.share(spark, read_ranks(path)))."""

    def task(batches):
        held: dict = {}
        for batch in batches:
            codec, rows, size, first = _codec(ranks, pattern, held), [], 0, 0
            for k, one in enumerate(batch.column(len(keep))):
                value = one.as_py() or ""
                rows.append(codec.encode(value))
                size += len(value)
                if size >= CHUNK or k == len(batch) - 1:
                    ends = np.cumsum([0, *map(len, rows)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows), pa.int32()))
                    yield pa.record_batch([*(batch.column(c).slice(first, len(rows)) for c in range(len(keep))), ids], names=[*keep, "ids"])
                    rows, size, first = [], 0, k + 1

    own = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    return own.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[: len(keep)]) + ", ids array<int>")


def decode(encoded: DataFrame, ranks, pattern: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded: the bytes that its ids stand for."""
    out = encoded.drop("decoded")
    place = out.columns.index(ids)

    def task(batches):
        held: dict = {}
        for batch in batches:
            codec, column, rows, size, first = _codec(ranks, pattern, held), batch.column(place), [], 0, 0
            for k, one in enumerate(column):
                values = one.values if one.is_valid else None
                rows.append(None if values is None or values.null_count else codec.decode(values.to_numpy()))
                size += len(rows[-1] or b"")
                if size >= CHUNK or k == len(batch) - 1:
                    yield pa.record_batch([*batch.slice(first, len(rows)).columns, pa.array(rows, pa.binary())], names=[*batch.schema.names, "decoded"])
                    rows, size, first = [], 0, k + 1

    return out.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded again."""
    spark = docs.sparkSession
    with C.workspace(spark, "byte-bpe"):
        ranks = C.share(spark, read_ranks(path))
        both = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ranks, pattern), ranks, pattern)
        listed = F.array_join(F.col("ids").cast("array<string>"), ",")
        return C.keep(both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "digests")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
