import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm import op11_divergence as D
from tillroll.llm import op12_byte_bpe as B
from tillroll.llm import op13_hard_negatives as H

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int"


# ---------------------------------------------------------------- divergence


def plain_divergence(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {i: i + 32 for i in range(65, 91)}
    counts, docs, groups = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups.setdefault(lang, set()).add(source)
        found = term.findall(text.translate(lower))
        for w in found:
            counts.setdefault((lang, source), {}).setdefault(w, 0)
            counts[lang, source][w] += 1
        for w in set(found):
            docs.setdefault(lang, {}).setdefault(w, 0)
            docs[lang][w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in docs.get(lang, {}).items() if n >= least]
        count = {s: {w: counts.get((lang, s), {}).get(w, 0) for w in kept} for s in sources}
        whole = {w: sum(count[s][w] for s in sources) for w in kept}
        price = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: price(count[s]) for s in sources}, price(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            words = [(f(p[s][w], q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, rows_, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(rows_, key=lambda r: (-r[0], r[1].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


def group_rows(seed, sources):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "été", "中文", "x", "\x80y", "don't", "z9z"] + [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = []
    for i in range(260):
        text = r.choice([" ", "\n", ", "]).join(r.choices(words, weights=[1 / (1 + k) for k in range(len(words))], k=r.choice([0, 1, 5, 40])))
        rows.append((i, text, r.choice(["en", "en", "fr", "", None]), r.choice([*(f"s{k}" for k in range(sources)), "", None]), "t", 1))
    rows += [(900, None, "de", "s1", None, None), (901, "", "de", None, None, None), (902, "rare words", "it", "only", "t", 1), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("sources", [3, 40])
def test_divergence_equals_brute_force(spark, monkeypatch, sources):
    monkeypatch.setattr(D, "PIECE", 64)
    rows = group_rows(sources, sources)
    got = D.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), least_docs=10, top=4, block=8)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_divergence(rows, 10, 4)


def test_divergence_of_nothing_and_of_long_texts(spark):
    assert D.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    text = (b"aB \xc3\xa9," * 400_000)[:-1]
    assert D.terms_of(text) == {b"ab": 400_000, b"\xc3\xa9": 400_000}
    assert D.terms_of(b"Q" * (3 << 20)) == {b"q" * (3 << 20): 1}


def test_joint_tables_are_exact_at_any_count():
    counts = np.array([[10**13, 0], [3, 3], [0, 10**13 + 1]])
    got = D.block_sums(counts, [10**13 + 3, 10**13 + 4], counts, [10**13 + 3, 10**13 + 4], 3)
    p = [[1 + 10**9 * (int(c) + 2) // (n + 6) for c in counts[:, s]] for s, n in enumerate((10**13 + 3, 10**13 + 4))]
    assert got[0, 1] == got[1, 0] == sum((a - b) ** 2 // (a + b) for a, b in zip(*p)) and got[0, 0] == 0


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def merged(ranks, piece):
    """Merges the leftmost pair of the lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


TEXTS = ["", " ", "  a", "a  ", "Hello, world's  end\n\n\n x", "don't DON'T 12345 ½ ²", "\t\t tab\x85nel\xa0nbsp　wide", "émigré ÀÉ 中文字 日本語テキスト", "🙂🙂 👩‍👩‍👧", "\x1c\x1d a\x1fb", "a" * 300, "<|endoftext|> x", "\x00\x01", "é ​ x"]


def test_encoding_equals_plain_merges(tokenizer):
    regex = pytest.importorskip("regex")
    raw = B.read_ranks(tokenizer[0])
    codec, ranks, pattern = B.Codec(raw, tokenizer[1]), B.ranks_of(raw), regex.compile(tokenizer[1])
    for text in TEXTS:
        want = [i for m in pattern.findall(text) for i in merged(ranks, m.encode())]
        assert codec.encode(text).tolist() == want, text
        assert codec.decode(codec.encode(text)) == text.encode()


def test_pieces_of_long_texts_change_nothing(tokenizer, monkeypatch):
    codec, r = B.Codec(B.read_ranks(tokenizer[0]), tokenizer[1]), random.Random(3)
    texts = ["".join(r.choice([*TEXTS, " " * r.randint(1, 90), "\n" * r.randint(1, 70), "x " * 9]) for _ in range(60)) for _ in range(40)]
    texts += [" " * 500, "a" + " \n" * 200, " " * 300 + "b", "\n" * 300 + "b", "\n" * 300 + " b"]
    whole = [codec.encoding.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(B, "PIECE", 40)
    monkeypatch.setattr(B, "RUN", 20)
    monkeypatch.setattr(B, "_LONG", re.compile(f"[{B.WHITE}]{{20,}}"))
    for text, want in zip(texts, whole):
        assert (len(list(B.parts(text))) > 1 or not text.strip()) and "".join(p for p, _ in B.parts(text)) == text
        assert codec.encode(text).tolist() == want


def test_runs_that_the_pattern_cannot_match(tokenizer):
    codec = B.Codec(B.read_ranks(tokenizer[0]), tokenizer[1])
    for text in (" " * 2_000_000 + "end", "\n" * 1_500_000, "z" * 1_000_000):
        assert codec.decode(codec.encode(text)) == text.encode()


def test_codec_rows(spark, tokenizer, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(B, "CHUNK", 50)
    rows = [(i, t, "en", "s", "x", 1) for i, t in enumerate([*TEXTS, None])] + [(None, "twice", "", "", "", 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash")).repartition(2)
    got = sorted(map(tuple, B.digests(docs, *tokenizer).collect()), key=repr)
    ids = lambda t: B.Codec(B.read_ranks(tokenizer[0]), P.PATTERN).encode(t or "").tolist()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(((i, len(ids(t)), sha(",".join(map(str, ids(t))).encode()), sha((t or "").encode())) for i, t, *_ in rows), key=repr)
    assert B.digests(docs.limit(0), *tokenizer).count() == 0
    with C.workspace(spark, "bpe"):
        ranks = C.share(spark, B.read_ranks(tokenizer[0]))
        odd = spark.createDataFrame([(1, [65, 66]), (2, None), (3, [None]), (4, [10**6]), (5, []), (6, [-1])], "k int, ids array<int>")
        back = {r.k: r.decoded for r in B.decode(odd, ranks, P.PATTERN).collect()}
    assert back[2] is back[3] is back[4] is back[6] is None and back[5] == b"" and len(back[1]) == 2


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, code string, anchor int"


def plain_negatives(rows, anchor, positives=5, negatives=5):
    fine = [(i, l, [math.floor(256 * v) for v in x]) for i, x, l, *_ in rows if i is not None and l is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, (i, l, x) in enumerate(fine):
        if not anchor(i):
            continue
        others = sorted((-max(-H.MOST, min(H.MOST, sum(p * q for p, q in zip(x, y)))), j, m) for b, (j, m, y) in enumerate(fine) if b != a and len(y) == len(x))
        near, far = [(-s, j) for s, j, m in others if m == l][:positives], [(-s, j) for s, j, m in others if m != l]
        for p, j in near:
            out += [(i, j, k + 1, n, p, s) for k, (s, n) in enumerate([(s, n) for s, n in far if 80 * p <= 100 * s <= 100 * p][:negatives])]
    return sorted(out)


def vector_rows(seed, n=400, d=24):
    r = np.random.default_rng(seed)
    base = r.normal(size=(8, d))
    x = base[r.integers(0, 8, n)] * r.choice([1.0, 0.3], (n, 1)) + r.normal(size=(n, d)) * r.choice([0.05, 0.6], (n, 1))
    rows = [(int(i), v.tolist(), int(r.integers(0, 4)), "c", 1) for i, v in enumerate(x)]
    rows += [(i, rows[0][1], i % 3, "c", 1) for i in range(1000, 1060)]  # one vector many times
    rows += [rows[10], rows[10], rows[20], (10, rows[11][1], 2, "c", 1), (20, rows[20][1], 3, "c", 1)]  # repeated rows and shared ids
    rows += [(2000, None, 1, "c", 1), (2010, [None] * d, 1, "c", 1), (2020, [float("nan")] * d, 1, "c", 1), (2030, [float("inf")] * d, 1, "c", 1), (2040, rows[0][1], None, "c", 1), (None, rows[0][1], 1, "c", 1)]
    rows += [(2050, [0.0] * d, 1, "c", 1), (2060, [], 1, "c", 1), (2061, [], 2, "c", 1), (2062, [], 1, "c", 1), (2070, [1.0, 2.0], 1, "c", 1), (2071, [1.0, 1.5], 1, "c", 1), (2072, [1.0, 1.4], 2, "c", 1)]
    return rows


@pytest.mark.parametrize("block", [8192, 7])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(H, "TILE_ROWS", 64)
    monkeypatch.setattr(H, "TILE_ANCHORS", 8)
    rows = vector_rows(block)
    got = H.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 10 == 0, block=block)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_negatives_of_large_components_and_of_nothing(spark):
    r = np.random.default_rng(4)
    rows = [(i, (v * s).tolist(), int(i % 2), "c", 1) for i, (v, s) in enumerate(zip(r.normal(size=(40, 3)) + 2, [1e3, 1e9, 1e16, 1e300] * 10))]
    got = H.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 5 == 0)
    empty = spark.createDataFrame([], VECTORS)
    assert H.hard_negatives(empty, F.col("vec_id") == 0).count() == 0
    assert H.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("d", [1, 5, 64, 100])
def test_intervals_hold_every_score(d):
    r = np.random.default_rng(d)
    x = np.floor(256 * (r.normal(size=(300, d)) + r.normal(size=(1, d)) * r.choice([0, 3.0], (300, 1))))
    x[0] = 0
    anchors = H.Anchors(np.arange(40), np.arange(40), np.zeros(40, int), x[:40])
    code, align = H.coded(H.turned(x))
    low, high = anchors.bounds(code, np.minimum(align, 1), H.norms(x))
    score = x[:40] @ x.T
    assert (low <= score).all() and (score <= high).all()


def test_intervals_leave_rows_out():
    r = np.random.default_rng(8)
    centre = np.repeat(r.normal(size=(40, 64)), 25, axis=0)
    x = np.floor(256 * (centre + 0.15 * r.normal(size=centre.shape)))
    anchors = H.Anchors(np.arange(40), np.arange(40), np.zeros(40, int), x[::25])
    code, align = H.coded(H.turned(x))
    _, high = anchors.bounds(code, np.minimum(align, 1), H.norms(x))
    fifth = np.sort(x[::25] @ x.T, axis=1)[:, -6]
    assert (high >= fifth[:, None]).mean() < 0.4
