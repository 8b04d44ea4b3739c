from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm import op06_quality as op6
from tillroll.llm import op07_toxicity as op7
from tillroll.llm import op08_embeddings as op8
from tillroll.llm import op09_language as op9

SF = "/root/testdata/sf0.01"


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 32))
    x = np.concatenate([base, base[:20] + r.normal(size=(20, 32)) * 0.1, base[:5], base[:5] * 3, base[7] + r.normal(size=(120, 32)) * 0.09]).astype(np.float32)
    rows = [(i, [float(v) for v in e], int(i % 3 == 2) if i < 60 else 0) for i, e in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None, 1.0], 0), (904, rows[0][1], None), (905, [1.0], 0), (906, [2.0], 0), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    for block, fill in ((2048, 64), (16, 64), (16, 1)):
        op8.BLOCK = block
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op8.near_duplicates(frame, fill=fill).collect()}
        y = x.astype(float)
        cos = y @ y.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
        label = np.array([q[2] for q in rows])
        link = (cos >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
        comp = np.arange(len(x))
        for _ in range(len(x)):
            comp = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(axis=1))
        for i in range(len(x)):
            assert got[i] == (link[i].sum(), comp[i], comp[i] == i), i
        assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904)) and got[905] == (1, 905, True) and got[906] == (1, 905, False)
        assert got[None][0] == 0
    op8.BLOCK = 2048
    assert op8.near_duplicates(frame.limit(0)).count() == 0

def test_embeddings_that_share_ids_or_are_of_extreme_size(spark):
    r = np.random.default_rng(12)
    a, b = r.normal(size=8), r.normal(size=8)
    near = lambda v: (v + 0.01 * r.normal(size=8)).tolist()
    rows = [(5, a.tolist(), 1), (5, b.tolist(), 2), (7, near(a), 1), (9, near(b), 2), (5, near(a), 1), (7, b.tolist(), 1), (11, b.tolist(), 1)]
    rows += [(20, [1e200] * 8, 3), (21, [1e200] * 7 + [1.0001e200], 3), (22, [1e-200] * 8, 3), (23, [1e-310] * 8, 3), (24, [1e200] * 4 + [-1e200] * 4, 3), (25, [1.7e308] * 8, 3)]

    def linked(p, q):
        x, y = (np.array([float(v) for v in np.ldexp(z, -np.frexp(np.abs(z).max())[1])]) for z in (np.array(p[1]), np.array(q[1])))
        return p[2] == q[2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    n = len(rows)
    links = [[j for j in range(n) if j != i and linked(rows[i], rows[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    least = [min(rows[j][0] for j in range(n) if root[j] == root[i]) for i in range(n)]
    got = op8.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == sorted((rows[i][0], len(links[i]), least[i], rows[i][0] == least[i]) for i in range(n))


@pytest.mark.parametrize("hashes", sorted(op8.SETTINGS))
def test_recall_at_the_threshold(hashes):
    r = np.random.default_rng(2)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    t = r.normal(size=a.shape)
    t -= (t * a).sum(1)[:, None] * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * t / np.linalg.norm(t, axis=1)[:, None]
    salt = np.zeros(len(a), np.uint64)
    x, y = (op8.bucket_keys(v, salt, op8.SETTINGS[hashes], hashes, op8.PROBES) for v in (a, b))
    own = np.arange(x.shape[1]) % op8.PROBES == 0
    met = np.zeros(len(a), bool)
    for i in range(len(own)):
        met |= ((x[:, [i]] == y) & (own[i] | own[None, :])).any(axis=1)
    assert met.mean() > 0.998


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    for v in np.unique(s):
        at = s[order] == v
        rank[order[at]] = np.flatnonzero(at).mean() + 1
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("query", "column", "least", "sf", "n"), [(op6.op6_quality, "quality", 0.97, SF, 1000), (op7.op7_toxicity, "toxic", 0.93, "/root/testdata/sf0.1", 10000)])
def test_held_out_scores(spark, query, column, least, sf, n):
    rows = query(spark, sf)
    assert rows.count() == n
    held = rows.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert auc(held[column].to_numpy(), held.score.to_numpy()) > least
    assert rows.where("score < 0 or score > 1 or score is null").count() == 0


def test_models_with_odd_rows(spark, documents, nothing):
    labels = documents.where("doc_id is not null").select(F.col("doc_id"), (F.col("doc_id") % 2).cast("int").alias("y")).distinct()
    assert op6.score(documents, op6.fit(documents, labels)).count() == documents.count()
    assert op7.toxicity(documents, labels).count() == documents.count()
    none = labels.limit(0)
    assert {r.score for r in op6.score(documents, op6.fit(documents, none)).collect()} == {0.5}
    assert {r.score for r in op7.toxicity(documents, none).collect()} == {0.0}
    assert op6.score(nothing, op6.fit(nothing, none)).count() == 0
    assert op7.toxicity(nothing, none).count() == 0


def test_toxic_texts_of_rare_terms_are_found(spark):
    r = np.random.default_rng(5)
    text = lambda p: " ".join(f"{p}{''.join(r.choice(list('abcdefghij'), 6))}" for _ in range(40))
    toxic, clean = [text("x") for _ in range(20)], [text("y") for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(toxic + toxic + clean)]
    docs = spark.createDataFrame([*rows, (500, toxic[3]), (501, clean[3]), (None, toxic[5]), (502, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i, _ in rows], "doc_id long, y int")
    got = {q.doc_id: (q.score, q.evidence) for q in op7.toxicity(docs, labels).collect()}
    assert got[500][0] > 0.8 and got[None][0] > 0.8 and got[500][1][0] == 3 and got[501][0] < 0.3 and got[501][1][0] == 43


def plain_neighbours(index, vectors, k):
    """Cosines by plain dictionaries: for each vector, entries by falling cosine down to the k-th and its equals."""
    unit = lambda v: {t: (1 + np.log(c)) * index.weight[t] for t, c in v.items()}
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    units = [unit(v) for v in vectors]
    out = []
    for u in units:
        s = np.array([sum(x * v.get(t, 0.0) for t, x in u.items()) / (size(u) * size(v)) for v in units])
        kth = np.sort(s)[-k] if len(s) >= k else 0
        out.append({e: s[e] for e in np.flatnonzero((s > 1e-12) & (s >= kth - 1e-12))})
    return out


@pytest.mark.parametrize(("n", "k", "often"), [(300, 7, 16), (40, 15, 2), (500, 80, 1000), (5, 15, 16)])
def test_block_max_finds_the_nearest(monkeypatch, n, k, often):
    monkeypatch.setattr(op7, "OFTEN", often)
    r = np.random.default_rng(4)
    share = 1 / np.arange(1, 121)
    raw = [np.sort(r.choice(120, r.integers(1, 30), replace=False, p=share / share.sum())) for _ in range(n)]
    raw = list({v.tobytes(): v for v in raw}.values())
    held = [(i, int(r.random() < 0.3 or 90 in v), v, np.ones(len(v), np.int64) * (1 + i % 3)) for i, v in enumerate(raw)]
    index = op7.Examples(np.arange(120).astype(np.uint64), r.integers(1, 900, 120), 1000, held, k)
    row = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
    place, count = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
    rows, entry, s = index.nearest(row, place, index.unit(row, place, count, len(held)), len(held))
    want = plain_neighbours(index, [dict(zip(h[2].tolist(), h[3].tolist())) for h in held], k)
    for i in range(len(held)):
        got = {int(index.ids[e]): x for e, x in zip(entry[rows == i], s[rows == i])}
        assert set(got) == set(want[i]) and all(abs(got[e] - want[i][e]) < 1e-9 for e in got)


def test_toxicity_query_against_brute_force(spark, documents):
    rows = [r for r in documents.collect() if r.doc_id is not None]
    labels = {r.doc_id: int(r.doc_id % 3 == 0) for r in rows if r.doc_id % 2 == 0}
    frame = spark.createDataFrame(list(labels.items()), "doc_id long, y int")
    index = op7.fit(documents.select("doc_id", "text"), frame, 5)
    words = lambda t: C.spaced(t or "").split()
    place = {}  # term by word
    for r in documents.collect():
        for w in words(r.text):
            h = C.letter_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]
            at = np.searchsorted(index.terms, h)
            if at < len(index.terms) and index.terms[at] == h:
                place[w] = int(at)
    df = Counter(t for r in documents.collect() for t in {place[w] for w in words(r.text) if w in place})
    idf = {t: np.log((1 + documents.count()) / (1 + n)) + 1 for t, n in df.items()}
    held: dict = {}
    for r in rows:
        if r.doc_id in labels:
            held.setdefault(tuple(sorted(Counter(place[w] for w in words(r.text)).items())), []).append(labels[r.doc_id])
    blank = held.pop((), [])
    rate = np.array([np.mean(v) for v in held.values()])
    p = rate.mean()
    weight = {}
    for t in idf:
        has = np.array([t in dict(v) for v in held])
        z = (rate[has].sum() - p * has.sum()) / np.sqrt(p * (1 - p) * has.sum() * (1 - has.sum() / len(held)) + 2)
        weight[t] = idf[t] * (1 + max(0, z) ** 2)
    unit = lambda v: {t: (1 + np.log(c)) * weight[t] for t, c in v}
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    got = {r.doc_id: r.score for r in op7.toxicity(documents, frame, 5).collect() if r.doc_id is not None}
    for r in rows:
        u = unit(Counter(place[w] for w in words(r.text) if w in place).items())
        s = np.array([sum(x * v.get(t, 0.0) for t, x in u.items()) / (size(u) * size(v)) for v in map(unit, held)]) if u else np.zeros(len(held))
        near = np.flatnonzero((s > 1e-12) & (s >= np.sort(s)[-5] - 1e-12))
        if not len(near):
            assert got[r.doc_id] == pytest.approx((sum(blank) + 0.05) / (len(blank) + 1)), r.doc_id
            continue
        votes = np.array([len(v) for v in held.values()])
        share = (s[near] ** 2 * (rate * votes)[near]).sum() / (s[near] ** 2 * votes[near]).sum()
        edges = np.append(index.levels, np.inf)
        fits = {float(index.table[np.searchsorted(index.levels, share + d, "left")]) for d in (-1e-9, 1e-9)}
        assert any(got[r.doc_id] == pytest.approx(f) for f in fits) and len(edges) == len(index.table), r.doc_id


def test_languages(spark):
    rows = op9.op9_language(spark, SF)
    held = rows.where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (held["lang"] == held.lang_pred).mean() > 0.97
    assert rows.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_of_odd_rows(spark, documents, nothing):
    model = op9.fit(spark.read.parquet(f"{SF}/documents.parquet"), cap=60)
    got = {r.doc_id: r.lang_pred for r in op9.identify(documents, model).collect()}
    blank = [r.doc_id for r in documents.where("text is null or trim(text) = ''").collect()]
    assert all(got[i] == "und" for i in blank) and len(got) == documents.select("doc_id").distinct().count()
    assert {r.lang_pred for r in op9.identify(documents, None).collect()} == {"und"}
    assert op9.fit(nothing) is None and op9.identify(nothing, model).count() == 0


def test_language_features_do_not_depend_on_blocks(monkeypatch):
    r = np.random.default_rng(6)
    texts = ["", "a", "  ab  c ", "été ça và\n1 2", "".join(r.choice(list("ab é.\n "), 400))]
    whole = [op9.features(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(C, "GROUP_BYTES", size)
        assert all(np.array_equal(op9.features(np.frombuffer(t.encode(), np.uint8)), w) for t, w in zip(texts, whole)), size
