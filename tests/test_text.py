import re
import time

import pytest
from pyspark.sql import functions as F

from tillroll.functions import text as T
from tillroll.operators.extract import extract_locations, text_totals
from tillroll.plans.fixtures import CASES


def located(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.asDict() for r in extract_locations(rows).orderBy("i").collect()]


def test_all_cases(spark):
    for case, got in zip(CASES, located(spark, [c[0] for c in CASES])):
        assert (got["store_name"], got["address"], got["phone"], got["postal_code"], got["country"], got["confidence"]) == case[1:], case[0]


@pytest.mark.parametrize(
    ("text", "field", "want"),
    [
        ("$9200 KUALA LUMPUR", "postal_code", "59200"),
        ("$9200 KUALA LUMPUR", "country", "Malaysia"),
        ("C1TY MART", "store_name", "CITY MART"),
        ("O3-228311O", "phone", "032283110"),
        ("03-2283111?", "phone", "0322831117"),
        ("Contact 12345", "phone", None),
        ("Zip: 12345", "postal_code", "12345"),
        ("Zip: 12345\nTel: 1", "postal_code", "12345\nTel"),
        ("Postal Code: 12345", "postal_code", "C0de"),
        ("Hamburger House\nCorner Shop", "store_name", "Corner Shop"),
        ("GR|OCER\nNext Shop", "store_name", "Next Shop"),
        ("Canada Mall", "country", "Canada"),
        ("call +1 234", "country", "Usa"),
        ("Invoice 56789 then far away from it all is the code 77777", "postal_code", "77777"),
        ("a\n\nb\nDATE 1\nc", "full_location_text", "a\nb\nDATE 1"),
        ("", "full_location_text", ""),
    ],
)
def test_quirks(spark, text, field, want):
    assert located(spark, [text])[0][field] == want


def test_null_text(spark):
    got = located(spark, [None])[0]
    assert got["store_name"] is None and got["confidence"] == 0.0


def test_totals(spark):
    rows = spark.createDataFrame([("Shop\nTotal $1.50\nTOTAL $2.25\nTOTAL $.\nTax $x", ), (None,)], "text string")
    got = [(r.store, r.total_amount, r.tax_amount) for r in text_totals(rows).collect()]
    assert got[0] == ("Shop", 2.25, None) and got[1][1] is None


def test_order_of_rows_does_not_matter(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    a = extract_locations(rows).collect()
    b = extract_locations(rows.orderBy(F.desc("i")).repartition(3)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def plain_name(lines):
    for line in (x.strip() for x in lines[:10]):
        clean = re.sub(r"\s+", " ", line).strip()
        for mark, letter in (("\\|", "I"), ("0", "O"), ("1", "I")):
            clean = re.sub(f"(?<=[A-Z]){mark}(?=[A-Z])", letter, clean)
        bare = re.sub(r"[ .-]", "", line)
        if len(line) < 3 or bare and bare.isdecimal() or any(m in line for m in T.NOISE_MARKS) or any(w in line.lower() for w in T.NOISE_WORDS):
            continue
        if sum(c.isalpha() for c in clean) >= 3:
            return clean
    return None


def plain_address(lines):
    kept = []
    for line in (x.strip() for x in lines[:15]):
        line = re.sub(r"(?<=\d)[Oo](?=\s|$)", "0", re.sub(r"(?<=\d)[Oo](?=\d)", "0", line.replace("$", "5")))
        if line and (any(w in line.lower() for w in T.ADDRESS_WORDS) or re.search(r"\b\d+[-\s]+[A-Za-z]", line)):
            kept.append(line)
    return " ".join(kept) or None


def plain_phone(lines):
    for line in lines[:20]:
        line = line.replace("O", "0").replace("o", "0").replace("?", "7")
        for p in T.PHONE_PATTERNS:
            m = re.search(p, line, re.I)
            if m:
                digits = re.sub(r"[^\d+]", "", re.sub(r"(?:Tel|Phone|Ph|Contact)[:\s]*", "", m[0], flags=re.I))
                if len(digits.replace("+", "")) >= 7:
                    return digits
    return None


def plain_postal(text):
    clean = lambda v: v.strip().replace("$", "5").replace("O", "0").replace("o", "0")
    for p in T.LABELLED_POSTAL:
        if m := re.search(p, text, re.I):
            return clean(m[1])
    if m := re.search(T.CITY_POSTAL, text, re.I):
        first = clean(m[0].split()[0])
        if first.isdigit() and 50000 <= int(first) <= 99999:
            return first
    for p in T.COUNTRY_POSTAL:
        for m in re.finditer(p, text, re.I):
            around = text[max(0, m.start() - 30) : m.end() + 30].lower()
            if not any(re.search(e, around) for e in T.POSTAL_EXCLUSIONS):
                return clean(m[0])
    return None


def plain_country(text):
    low = text.lower()
    for name, words in T.COUNTRY_WORDS:
        if any(w in low for w in words):
            return name
    for name, p in T.COUNTRY_PHONES:
        if re.search(p, text):
            return name
    if re.search(r"\b[5-9]\d{4}\b.*(?:kuala|lumpur|malaysia)", low):
        return "Malaysia"
    if re.search(T.COUNTRY_POSTAL[3], text):
        return "Uk"
    if re.search(T.COUNTRY_POSTAL[4], text):
        return "Canada"
    return "Usa" if re.search(T.COUNTRY_POSTAL[2], text) and any(w in low for w in T.USA_CONTEXT) else None


def test_against_plain_python(spark):
    """Whole documents, beside receipt texts put into them and random mixtures of what the patterns look for."""
    import random

    r = random.Random(2)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    bits = ["Invoice", "no: 12", "56789", "S 123456", "M1 1AE", "K1A 0B1", "90210-1234", "12/03/24", "$9200 KL", "Zip: 1O345", "Tel: O3-2283 1117", "+65 6123 4567", "kuala", "texas", "12 Jalan", "(77777)", "sdn bhd", "x" * 31, "\n", " ", "88888", "usa"]
    texts += ["".join(r.choice(bits) + r.choice([" ", "\n", ""]) for _ in range(r.randint(1, 14))) for _ in range(600)]
    texts += [f"{c[0]}\n{t}" for c, t in zip(CASES * 3, texts)]
    for t, got in zip(texts, located(spark, texts)):
        lines = t.split("\n")
        want = (plain_name(lines), plain_address(lines), plain_phone(lines), plain_postal(t), plain_country(t))
        assert (got["store_name"], got["address"], got["phone"], got["postal_code"], got["country"]) == want, t[:300]


@pytest.mark.parametrize("piece", ["Invoice 56789 is here", "12345 ", "bill S 123456 M1 1AE\n", "kuala 12345 "])
def test_time_is_linear_in_the_text(spark, piece):
    """Places that look like codes and aren't, by the thousand."""

    def seconds(n):
        rows = spark.createDataFrame([(i, piece * n) for i in range(2)], "i int, text string").repartition(1)
        began = time.time()
        extract_locations(rows).select("postal_code", "country").collect()
        return time.time() - began

    seconds(100)
    few, many = min(seconds(5_000) for _ in range(2)), seconds(40_000)
    assert many < 5 + 16 * few


def test_own_lists(spark):
    rows = spark.createDataFrame([("ACME SHOP\nBetter Name\nCallme 5551234\nOslo",)], "text string")
    own = T.Lists(noise_words=["acme"], phone_patterns=[r"Callme\s\d{7}"], country_words=[("Norway", ["oslo"])], section_stops=["callme"])
    got = extract_locations(rows, lists=own).first()
    assert (got.store_name, got.phone, got.country, got.full_location_text) == ("Better Name", "5551234", "Norway", "ACME SHOP\nBetter Name\nCallme 5551234")
