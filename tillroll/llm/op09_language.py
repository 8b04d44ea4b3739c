"""Language identification by hierarchical discrimination.

A linear model over hashed letter n-grams (2 to 4 bytes, ASCII letters in lower case, words padded by spaces) first tells
the family, then one-versus-one linear support vector machines tell the languages of that family apart by votes, margins
breaking ties. Families come from FAMILIES; languages not named there form one family of their own.

Learned from the whole texts of at most about `cap` documents of each language, whose vectors (16 KB each) the driver holds
while it fits: 10 MB a language at the default. `und` with score 0 where the text is
null or has no letter. Repeated rows are judged alike; a null doc_id is kept; without any labelled document every text
is `und`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm.training import even_sample

#: Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "finno-ugric": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur pa mr gu ne",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
FEATURES = 1 << 12
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER[~_LETTER] = 32


def features(data: np.ndarray) -> np.ndarray:
    """Counts of hashed letter n-grams of one text, to the power of a half, scaled to length 1; all bytes are read, in blocks that change nothing: n-grams go on over their edges."""
    out, held = np.zeros(FEATURES), np.array([32], np.uint64)  # what an n-gram of the next block may begin with
    for a in range(0, len(data), C.GROUP_BYTES):
        b = np.concatenate((held, _LOWER[data[a : a + C.GROUP_BYTES]], np.full(int(a + C.GROUP_BYTES >= len(data)), 32, np.uint64)))
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
        for n in range(2, 5):
            part = b[max(0, len(held) - n + 1) :]
            code = part.copy()
            for k in range(1, n):
                code = code[:-1] * np.uint64(257) + part[k:]
            out += np.bincount(((code * np.uint64(C.BASE)) >> np.uint64(52)).astype(np.int64), minlength=FEATURES)
        held = b[-3:]
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1.0)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 80) -> np.ndarray:
    """Weights, intercept last, of a linear support vector machine (squared hinge), by accelerated gradient descent. y: -1 or 1, classes weighted evenly."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    x = x.astype(np.float32, copy=False)
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    w = before = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 + 4.0 * c)
    for k in range(steps):
        v = w + np.float32(k / (k + 3)) * (w - before)
        slack = np.maximum(0.0, 1.0 - y * (x @ v))
        before, w = w, v - np.float32(rate) * (v - 2 * ((side * y * slack).astype(np.float32) @ x))
    return w.astype(float)


class Hierarchy:
    """The fitted models: family first, then pairs of languages."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        family_of = {code: f for f, codes in FAMILIES.items() for code in codes.split()}
        self.langs = sorted(set(lang))
        self.family = {code: family_of.get(code.lower().split("-")[0], "other") for code in self.langs}
        self.families = sorted(set(self.family.values()))
        of = np.array([self.family[v] for v in lang])
        self.top = np.array([fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in combinations([v for v in self.langs if self.family[v] == f], 2):
                at = (lang == a) | (lang == b)
                self.pairs[a, b] = fit_svm(x[at], np.where(lang[at] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, 1.0)
        f, sure = self.families[0], 1.0
        if self.top is not None:
            margin = 3 * (self.top @ x)
            p = np.exp(margin - margin.max())
            f, sure = self.families[int(p.argmax())], float(p.max() / p.sum())
        votes = {v: [0, 0.0] for v in self.langs if self.family[v] == f}
        for (a, b), w in self.pairs.items():
            if a in votes:
                m = float(w @ x)
                votes[a if m > 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(votes, key=lambda v: (*votes[v], v))
        if len(votes) > 1:
            sure *= 1 / (1 + np.exp(-3 * votes[best][1] / (len(votes) - 1)))
        return best, float(min(1.0, max(0.0, sure)))


def fit(docs: DataFrame, cap: int = 600) -> Hierarchy | None:
    """Fits on about `cap` documents (doc_id, text, lang) of each language; null lang is left out."""
    kind = pa.list_(pa.float32())

    def task(batches):
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(0))
            for k in range(0, len(offsets) - 1, 100):
                rows = [features(data[a:b]).astype(np.float32) for a, b in zip(offsets[k : k + 100], offsets[k + 1 : k + 101])]
                yield pa.record_batch([pa.array(rows, kind), batch.column(1).slice(k, len(rows))], names=["x", "lang"])

    picked = even_sample(docs.where("lang is not null and doc_id is not null"), "lang", cap)
    rows = picked.select("text", "lang").mapInArrow(task, "x array<float>, lang string").toArrow()  # about cap rows of each language
    if not len(rows):
        return None
    x = np.array(rows["x"].combine_chunks().values, np.float32).reshape(len(rows), FEATURES)
    order = np.lexsort((x[:, 1], x[:, 0], x.sum(axis=1)))  # the fit doesn't depend on the rows' order
    return Hierarchy(x[order], np.array(rows["lang"].to_pylist())[order])


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weights for each pair of languages

    def task(batches):
        m = shared.value
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(1))
            lang, score = [], []
            for text, a, b in zip(batch.column(1), offsets, offsets[1:]):
                if m is None or not any(map(str.isalpha, text.as_py() or "")):
                    lang.append("und")
                    score.append(0.0)
                else:
                    v, s = m.predict(features(data[a:b]))
                    lang.append(v)
                    score.append(s)
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    fold = F.pmod(C.salted_id(), F.lit(4))
    model = fit(docs.where(fold != 2))
    return identify(docs, model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
