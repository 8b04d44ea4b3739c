import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import op01_suffix_dedup as op1
from tillroll.llm import op02_line_dedup as op2
from tillroll.llm import op10_ngram_join as op10
from tillroll.llm.components import components


def brute_repeats(rows, least):
    texts = [(t or "").encode() for t in rows]
    seen = Counter(b[s : s + least] for b in texts for s in range(len(b) - least + 1))
    out = []
    for b in texts:
        mark = np.zeros(len(b) + 1, int)
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                mark[s] += 1
                mark[s + least] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        out.append((len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize(("large", "step"), [(4096, 1 << 21), (1, 700)])
def test_repeats_against_brute_force(documents, corpus, monkeypatch, large, step):
    """Also with every anchor of two contexts counted by hash, and with texts read in pieces of 700 bytes."""
    monkeypatch.setattr(op1, "LARGE", large)
    monkeypatch.setattr(op1, "STEP", step)
    monkeypatch.setattr(op1, "SAMPLED", min(op1.SAMPLED, large))  # each row counts for the hot anchors then
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, bytes(r.kept)) for r in op1.remove_repeats(documents, 400).collect())
    want = sorted((c[0] if c[0] is not None else -1, *w) for c, w in zip(corpus, brute_repeats([c[1] for c in corpus], 400)))
    assert got == want


def test_repeats_small_lengths(spark):
    rows = [(1, "abcdefgh" * 3), (2, "xxabcdefghyy"), (3, "short"), (4, None)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in op1.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8, 4).collect())
    assert got == [(i, *w) for (i, _), w in zip(rows, brute_repeats([t for _, t in rows], 8))]


def test_a_hot_text_and_a_very_long_one(spark):
    """A third of all rows are one text; a text of 9 MB repeats two passages of another."""
    r = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    hot, own = word(900), [word(700) for _ in range(40)]
    long = " ".join(word(6) for _ in range(100)) * 2 + "".join(map(chr, r.integers(97, 123, 9_000_000))) + own[0][100:650] + " end"
    rows = [(i, t) for i, t in enumerate([*own, *[hot] * 20, long])]
    got = {q.doc_id: (q.n_bytes, q.n_removed, [tuple(x) for x in q.removed]) for q in op1.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_bytes", "n_removed", "removed").collect()}
    assert all(got[i] == (900, 900, [(0, 900)]) for i in range(40, 60))
    assert got[0] == (700, 550, [(100, 650)]) and all(got[i] == (700, 0, []) for i in range(1, 40))
    n = len(long)
    assert got[60][2][0][0] == 0 and got[60][2][-1] == (n - 554, n - 4) and len(got[60][2]) == 2 and 1390 <= got[60][2][0][1] <= 1402


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_hot_anchors_in_different_surroundings(spark, monkeypatch, most):
    """Two lines of 250 bytes in a third of all rows each, among other text or with as much of a neighbour that some rows share; whether the hot anchors are known or not."""
    monkeypatch.setattr(op1, "LARGE", 8)
    monkeypatch.setattr(op1, "SAMPLED", 1)
    monkeypatch.setattr(op1, "MOST_HOT", most)
    r = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    first, second, beside = word(250), word(250), [word(300) for _ in range(4)]
    rows = [word(400) + first + word(400) for _ in range(30)] + [word(120) + second + beside[i % 4] for i in range(30)] + [word(700) for _ in range(28)]
    rows += [rows[0]] * 3 + [rows[31] + "é"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2"))
    hot = op1.hot_anchors(keyed, 400, op1.ANCHOR)
    assert len(hot) == min(most, len(hot)) and len(hot) >= min(most, 2) and (np.sort(hot) == hot).all()
    got = sorted((q.doc_id, q.n_bytes, q.n_removed, bytes(q.kept)) for q in op1.remove_repeats(docs, 400).collect())
    want = [(i, *w) for i, w in enumerate(brute_repeats(rows, 400))]
    assert got == want and want[0][2] == len(rows[0]) and want[1][2] == 0 and want[31][2] >= 550


def test_bytes_decide_within_one_text():
    raw, offsets = b"abcabcabxabc", np.array([0, 3, 6, 12])
    assert op1.elsewhere(raw, offsets, 0, 3) and not op1.elsewhere(raw, offsets, 2, 3) and not op1.elsewhere(b"abcdabcd", np.array([0, 3, 8]), 4, 4)


def test_words_of_long_texts_in_pieces():
    from tillroll.llm import common as C

    r = np.random.default_rng(4)
    data = np.frombuffer((" ".join("".join(chr(97 + c) for c in r.integers(0, 26, 7)) for _ in range(700_000)) + " Élan").encode(), np.uint8)
    assert len(data) > 5 * C.GROUP_BYTES
    for f in (C.hashed_words, C.letter_words):
        whole, row = f(data, np.array([0, len(data)]))
        start, end, _ = C.word_spans(data, np.array([0, len(data)]))
        plain = C.mix64(C.span_hashes(C.prefix_hashes(data, "folded"), start, end))
        assert len(whole) == len(row) == 700_001 and (whole[:-1] == plain[:-1]).all()
    assert f(data[-5:], np.array([0, 5]))[0][0] == whole[-1] == f(np.frombuffer("éLAN".encode(), np.uint8), np.array([0, 5]))[0][0]
    assert len(C.letter_words(np.full(3 * C.GROUP_BYTES, 97, np.uint8), np.array([0, 3 * C.GROUP_BYTES]))[0]) == 1


def test_suffix_order_is_lexicographic():
    from tillroll.llm import common as C

    for seed in range(3):
        data = np.random.default_rng(seed).integers(97, 99, 300).astype(np.uint8)
        start = np.arange(299)
        stop = np.full(299, 300)
        order = op1.suffix_order(data, C.prefix_hashes(data), start, stop)
        raw = data.tobytes()
        assert [raw[s:] for s in order] == sorted(raw[s:] for s in start)


def test_repeats_without_rows(nothing):
    assert op1.remove_repeats(nothing).count() == 0


def brute_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    doc = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or doc(i) == max(holders[key(x)])]
        out.append((doc(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 20, 2])
def test_lines_against_brute_force(documents, corpus, monkeypatch, most):
    """Also with many more runs of a key than by default."""
    monkeypatch.setattr(op2, "RUN_LINES", most)
    monkeypatch.setattr(op2, "RUNS", min(64, most))
    got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in op2.line_dedup(documents).collect())
    assert got == brute_lines([c[:2] for c in corpus])


def test_keep_bitmaps_are_run_lengths(spark):
    line = "a line of more than twenty characters"
    rows = [(i, f"{line}\nown {i}\n{line}\n{line}\nend") for i in range(3)]
    got = {r.doc: r.keep_runs for r in op2.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [0, 1, 1, 2], 1: [0, 1, 1, 2]}


def test_lines_stay_native(documents):
    plan = op2.line_dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_without_rows(nothing):
    assert op2.line_dedup(nothing).count() == 0


def brute_components(rows, width, num, den):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[n] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {n: n for n in sets}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    least = defaultdict(lambda: 1 << 62)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(least[root(n)], i)
    return sorted((-1 if i is None else i, len(sets[n]), -1 if i is None else least[root(n)]) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80), (1, 50)])
def test_join_against_brute_force(documents, corpus, width, num):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in op10.jaccard_components(documents, width, num, 100).collect())
    assert got == brute_components([c[:2] for c in corpus], width, num, 100)


def test_bands_let_every_linked_pair_meet():
    bands = op10.Bands(85, 100)
    for small in range(1, 900):
        large = small * 100 // 85
        shared = {b for b, _, _ in bands.of(small)} & {b for b, _, _ in bands.of(large)}
        assert shared, (small, large)
        for b, words, differ in bands.of(small):
            if b in shared:
                assert bands.most(small + large) <= differ < words


def test_folded_sketches_are_those_of_fewer_bits():
    import pyarrow as pa

    r = np.random.default_rng(1)
    members = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (5000, 9000, 33000)]
    wide = [op10.wide_sketch(m) for m in members]
    got = op10.folded(pa.array(wide))
    bits = len(wide[0]) * 8
    for m, row in zip(members, got):
        want = np.packbits((np.bincount((m >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))
        assert row.view(np.uint8).tobytes() == want.tobytes()
    for i in range(3):
        for j in range(i):
            assert int(np.bitwise_count(got[i] ^ got[j]).sum()) <= op10.distance(wide[i], wide[j])
    assert op10.folded(pa.array([wide[0], None])) is None


def test_large_sets_against_brute_force(spark):
    """Sets too large for the common sketch, in groups on either side of the threshold, with a passage that all share."""
    r = np.random.default_rng(9)
    word = lambda: f"w{r.integers(0, 10**9)}"
    shared, rows = [word() for _ in range(400)], []
    for g in range(4):
        base = [word() for _ in range(2600)]
        for k in range(6):
            own = list(base)
            for at in r.choice(len(own), [2, 20, 60, 62, 120, 300][k], replace=False):
                own[at] = word()
            rows.append((len(rows), " ".join(shared + own)))
    got = sorted((q.doc_id, q.n_shingles, q.component_id) for q in op10.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect())
    assert got == brute_components(rows, 5, 80, 100)


def test_join_without_rows(nothing):
    assert op10.jaccard_components(nothing).count() == 0


def test_join_with_an_id_whose_filter_bit_is_0(spark):
    assert spark.range(194350146, 194350147).select(F.pmod(F.xxhash64("id"), F.lit(op10.FILTER_BITS)).alias("b")).first().b == 0
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(194350146, text), (194350147, text + " more"), (194350148, "nothing that is shared by the others")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op10.jaccard_components(docs).collect()} == {194350146: 194350146, 194350147: 194350146, 194350148: 194350148}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).select("node", "component").collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
