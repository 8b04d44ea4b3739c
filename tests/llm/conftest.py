import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, class string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with copies, near copies, reordered and shared passages, common lines, nulls, empties, odd white space and one very long text; clashing extra columns."""
    r = random.Random(7)
    vowels, stops = "aeiou", "bdfgklmnprst"
    word = lambda: "".join(r.choice(stops) + r.choice(vowels) for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(120)]
    line = "This Line stands in many documents"
    texts = []
    for i in range(60):
        words = [word() for _ in range(r.choice([3, 30, 150, 400]))]
        if i % 6 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        texts.append(" ".join(words) + ("\n" + line.upper() + "  \n" + line if i % 3 == 0 else ""))
    base = texts[2] + " " + " ".join(passage) + " " + texts[3]
    for i in range(12):  # near copies
        words = base.split(" ")
        for _ in range(i % 4 + 1):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + [texts[1], "", " \n\t ", "one", "One", "one two", "é ü ÉÜ ñ", "aaaa" * 300, "ab " * 400, "x\r\ny\x0bz"]
    texts.append(" ".join(r.choice(texts[:40]) for _ in range(60)))  # very long
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t), "k", "c") for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "s", 1, "k", "c"), (200, None, None, None, None, None, None), rows[4], rows[4]]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
