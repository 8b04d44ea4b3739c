"""Column expressions that read location details from OCR text.

Strings are read as Unicode where the reading calls for it ((?U) in patterns). Every builder takes a text or an array
of lines and gives a column; word lists and patterns are parameters with the usual ones as defaults.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns that decide what is found.
NOISE_MARKS = ["|", "===", "---", "___", "***"]
NOISE_WORDS = ["date", "time", "am", "pm"]
ADDRESS_WORDS = ["street", "road", "avenue", "blvd", "drive", "lane", "level", "floor", "unit", "#", "bldg", "building", "mall", "plaza", "center", "centre", "jalan", "jln"]
PHONE_PATTERNS = [
    r"(?:Tel|Phone|Ph|Contact)[:\s]*\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
    r"0[1-9][-.\s]?\d{3,4}[-.\s]?\d{4}",
    r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\d{4}[-.\s]?\d{4}",
    r"\d{8,}",
]
LABELLED_POSTAL = [r"(?:postal|post\s*code|zip)[:\s]+([A-Z0-9\s-]{4,10})", r"\b([5-9]\d{4})\s*(?:kuala|lumpur|kl|malaysia)"]
CITY_POSTAL = r"[$5-9]?\d{4,5}\s+(?:kuala\s+lumpur|kl|selangor|penang|johor|ipoh|melaka)"
COUNTRY_POSTAL = [r"\bS\s*\d{6}\b", r"\b[5-9]\d{4}\b", r"\b\d{5}(?:-\d{4})?\b", r"\b[A-Z]{1,2}\d{1,2}\s*\d[A-Z]{2}\b", r"\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b"]
POSTAL_EXCLUSIONS = [r"invoice|receipt|trans|bill|no[:\s.]*\d", r"vat\d+", r"\d{2}[/-]\d{2}[/-]\d{2}", r"[\($]\d+[-)]", r"sdn\s+bhd"]
COUNTRY_WORDS = [
    ("Singapore", ["singapore"]),
    ("Malaysia", ["malaysia", "kuala lumpur", "selangor", "penang", "johor"]),
    ("Thailand", ["thailand", "bangkok"]),
    ("Indonesia", ["indonesia", "jakarta"]),
    ("Philippines", ["philippines", "manila"]),
    ("Australia", ["australia", "sydney", "melbourne"]),
    ("Canada", ["canada", "toronto", "vancouver"]),
    ("Uk", ["united kingdom", "england", "scotland", "wales", "london"]),
    ("Usa", ["united states", "america"]),
]
COUNTRY_PHONES = [
    ("Singapore", r"\+65|^65[-\s]"),
    ("Malaysia", r"\+60|^60[-\s]|03[-\s]\d{4}"),
    ("Thailand", r"\+66|^66[-\s]"),
    ("Indonesia", r"\+62|^62[-\s]"),
    ("Philippines", r"\+63|^63[-\s]"),
    ("Usa", r"\+1[-\s]\d{3}"),
    ("Uk", r"\+44"),
    ("Australia", r"\+61"),
]
USA_CONTEXT = ["usa", "united states", "ca", "ny", "tx", "fl"]
CODED_CITIES = ["kuala", "lumpur", "malaysia"]
SECTION_STOPS = ["date", "time", "cashier", "terminal"]
WEIGHTS = {"store_name": 25, "address": 30, "phone": 20, "postal_code": 15, "country": 10}

U, UI = "(?U)", "(?iuU)"
#: What (?U)[\s\x1C-\x1F] matches.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@dataclass(frozen=True)
class Lists:
    """The word lists and patterns of one reading; a job may put its own in place of any."""

    noise_marks: list[str] = field(default_factory=lambda: NOISE_MARKS)
    noise_words: list[str] = field(default_factory=lambda: NOISE_WORDS)
    address_words: list[str] = field(default_factory=lambda: ADDRESS_WORDS)
    phone_patterns: list[str] = field(default_factory=lambda: PHONE_PATTERNS)
    labelled_postal: list[str] = field(default_factory=lambda: LABELLED_POSTAL)
    city_postal: str = CITY_POSTAL
    country_postal: list[str] = field(default_factory=lambda: COUNTRY_POSTAL)
    postal_exclusions: list[str] = field(default_factory=lambda: POSTAL_EXCLUSIONS)
    country_words: list[tuple[str, list[str]]] = field(default_factory=lambda: COUNTRY_WORDS)
    country_phones: list[tuple[str, str]] = field(default_factory=lambda: COUNTRY_PHONES)
    usa_context: list[str] = field(default_factory=lambda: USA_CONTEXT)
    section_stops: list[str] = field(default_factory=lambda: SECTION_STOPS)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """The string then(value), with the value worked out once however often `then` names it; within lambdas Spark shares no common part. (get() of a transform() would look through the types of all that is nested in it for each row.)"""
    return F.aggregate(F.array(value), F.lit(None).cast("string"), lambda _, v: then(v))


def holds_any(c: Column, words: list[str]) -> Column:
    """Whether a text, lower-cased once, holds one of the words."""
    return F.exists(F.array(F.lower(c)), lambda low: any_of([low.contains(w) for w in words]))


def swapped(c: Column, pairs: list[str]) -> Column:
    """Each pair's first character as its second, as translate() does it, which costs more; no pair makes what a later one takes."""
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, c)


def first_of(lines: Column, read: Callable[[Column], Column]) -> Column:
    """The first of the lines' readings that isn't null; lines after it are not read."""
    return F.aggregate(lines, F.lit(None).cast("string"), lambda found, line: F.coalesce(found, read(line)))


def led(pattern: str) -> str:
    """A pattern all of whose alternatives begin with a plain character or class looks at that first, before word boundaries and the rest, which cost far more; any other as it is."""
    tops, depth = [""], 0
    for token in re.findall(r"\\.|\[[^\]]*\]|.", pattern, re.S):
        depth += (token == "(") - (token == ")")
        tops = [*tops, ""] if token == "|" and not depth else [*tops[:-1], tops[-1] + token]
    leads = [re.match(r"(?:\^|\\b)?(?:(\\d|\\\+|[A-Za-z0-9])|\[((?:[A-Za-z0-9$](?:-[A-Za-z0-9])?)+)\])(?![?*]|\{0)", t) for t in tops]
    return f"(?=[{''.join(m[1] or m[2] for m in leads)}])(?:{pattern})" if all(leads) else pattern


def _free(pattern: str) -> bool:
    """Whether a pattern found in a part of a text is found in the whole: it doesn't look around, nor at boundaries, nor at letters whose case hangs on their neighbours."""
    return pattern.isascii() and not re.search(r"[\^$]|\\[^dsw.($)\[\]-]|\(\?(?!:)|[*+?}]\+", re.sub(r"\[[^\[\]^&]*\]", "", pattern))


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, null where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def clean_name(c: Column) -> Column:
    """White space collapsed; a bar or digit between two capitals becomes the letter it was misread from."""
    out = stripped(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))
    for mark, letter in ((r"\|", "I"), ("0", "O"), ("1", "I")):
        out = F.regexp_replace(out, f"(?<=[A-Z]){mark}(?=[A-Z])", letter)
    return F.when(c.rlike(r"(?U)[\s\x1C-\x1F&&[^ ]]|^ | (?: |\z)|[|01](?<=[A-Z].)(?=[A-Z])"), out).otherwise(c)  # most have nothing to clean


def store_name(lines: Column, marks: list[str] = NOISE_MARKS, words: list[str] = NOISE_WORDS) -> Column:
    """The first of ten lines that reads like a name."""

    def named(line: Column) -> Column:
        return F.when(~any_of([line.contains(m) for m in marks]) & ~holds_any(line, words), once(clean_name(line), lambda name: F.when(name.rlike(r"(?:\p{L}\P{L}*+){3}"), name)))  # three letters: neither shorter nor a number

    return first_of(F.slice(lines, 1, 10), lambda line: once(stripped(line), named))


def clean_address(c: Column) -> Column:
    """Every dollar sign was a 5; an O after a digit and before a digit, white space or the end was a 0."""
    plain = swapped(c, ["$5"])
    out = F.regexp_replace(F.regexp_replace(plain, r"(?U)(?<=\d)[Oo](?=\d)", "0"), r"(?U)(?<=\d)[Oo](?=\s|$)", "0")
    return F.when(plain.rlike(r"(?U)[Oo](?<=\d.)(?=\d|\s|$)"), out).otherwise(plain)


def address(lines: Column, words: list[str] = ADDRESS_WORDS) -> Column:
    """Of fifteen lines, those with an address word or a number before a word, joined by blanks."""
    cleaned = F.transform(F.filter(F.transform(F.slice(lines, 1, 15), stripped), lambda x: x != ""), clean_address)
    kept = F.filter(cleaned, lambda x: holds_any(x, words) | x.rlike(U + led(r"\b\d+[-\s]+[A-Za-z]")))
    return once(kept, lambda held: F.when(F.size(held) > 0, F.array_join(held, " ")))


def phone(lines: Column, patterns: list[str] = PHONE_PATTERNS) -> Column:
    """The first number of at least 7 digits in twenty lines; patterns are tried in order on each line."""

    def number(line: Column, pattern: str) -> Column:
        hit = F.when(line.rlike(UI + pattern), F.regexp_extract(line, UI + pattern, 0))
        digits = F.regexp_replace(F.regexp_replace(hit, UI + r"(?:Tel|Phone|Ph|Contact)[:\s]*", ""), r"(?U)[^\d+]", "")
        return once(digits, lambda v: F.when(F.char_length(F.replace(v, F.lit("+"), F.lit(""))) >= 7, v))

    def read(line: Column) -> Column:
        return F.when(line.rlike(r"(?U)\d(?:\D*+\d){6}") & line.rlike(r"(?U)\d(?:\D{0,3}\d){3}"), F.coalesce(*(number(line, p) for p in patterns)))  # every pattern needs four digits close together

    return first_of(F.slice(lines, 1, 20), lambda x: once(swapped(x, ["O0", "o0", "?7"]), read))


def clean_postal(c: Column) -> Column:
    return swapped(c, ["$5", "O0", "o0"])


def _pattern_postal(text: Column, pattern: str, exclusions: list[str]) -> Column:
    """The first match that nothing within 30 characters excludes. What stands before a match comes from the end of the pieces so far, what follows from a look-ahead, so the whole is linear in the text."""
    pattern = UI + led(pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    after = F.regexp_extract_all(text, F.lit(f"{pattern}(?=([\\s\\S]{{0,30}}))"), F.lit(1))
    between = F.split(text, pattern, -1)  # one more than there are matches
    pieces = F.filter(F.arrays_zip(found.alias("hit"), after.alias("after"), between.alias("gap")), lambda m: m["hit"].isNotNull())
    start = F.struct(F.lit("").alias("tail"), F.lit(None).cast("string").alias("hit"))
    excluded = U + "|".join(f"(?:{e})" for e in exclusions)

    def step(acc: Column, piece: Column) -> Column:
        before = F.right(F.concat(acc.tail, F.right(piece.gap, F.lit(30))), F.lit(30))
        fits = acc.hit.isNull() & ~F.lower(F.concat(before, piece.hit, piece.after)).rlike(excluded) if exclusions else acc.hit.isNull()
        return F.struct(F.right(F.concat(before, piece.hit), F.lit(30)).alias("tail"), F.when(fits, clean_postal(stripped(piece.hit))).otherwise(acc.hit).alias("hit"))

    allowed = F.aggregate(pieces, start, step, lambda acc: acc.hit)
    if exclusions and all(map(_free, exclusions)):  # where nothing in the whole text excludes, its first match counts
        allowed = F.when(F.lower(text).rlike(excluded), allowed).otherwise(clean_postal(stripped(F.regexp_extract(text, pattern, 0))))
    return F.when(text.rlike(pattern), allowed)


def postal_code(text: Column, exclusions: list[str] = POSTAL_EXCLUSIONS, labels: list[str] = LABELLED_POSTAL, city_pattern: str = CITY_POSTAL, patterns: list[str] = COUNTRY_POSTAL) -> Column:
    """A labelled code, else one before a city, else the first country's pattern whose surroundings don't exclude it."""
    labelled = [clean_postal(stripped(first_match(text, UI + led(p), 1))) for p in labels]
    city = clean_postal(F.get(F.split(F.regexp_extract(text, UI + city_pattern, 0), r"(?U)\s+"), 0))
    valid = F.when(text.rlike(UI + city_pattern), once(city, lambda v: F.when(v.rlike(r"^\d+$"), F.when(v.cast("int").between(50000, 99999), v))))
    return F.coalesce(*labelled, valid, *(_pattern_postal(text, p, exclusions) for p in patterns))


def country(text: Column, words: list[tuple[str, list[str]]] = COUNTRY_WORDS, phones: list[tuple[str, str]] = COUNTRY_PHONES, context: list[str] = USA_CONTEXT, postal: list[str] = COUNTRY_POSTAL) -> Column:
    """A country named in the text, else one by phone prefix, else by the look of a postal code."""
    dialled = F.when(text.rlike(U + led("|".join(p for _, p in phones))), F.coalesce(*(F.when(text.rlike(U + p), name) for name, p in phones))) if phones else F.lit(None).cast("string")

    def coded_city(low: Column) -> Column:
        # a code before a city in one line: each line is read up to its last city, so a line is searched once whatever its codes
        city_lines = F.filter(lines_of(low), lambda x: any_of([x.contains(w) for w in CODED_CITIES]))
        return F.exists(city_lines, lambda x: F.regexp_extract(x, f"(?s)^(.*(?:{'|'.join(CODED_CITIES)}))", 1).rlike(U + led(r"\b[5-9]\d{4}\b")))

    def read(low: Column) -> Column:
        named = [F.when(any_of([low.contains(w) for w in held]), name) for name, held in words]
        coded = [
            F.when(any_of([low.contains(w) for w in CODED_CITIES]) & coded_city(low), "Malaysia"),
            F.when(text.rlike(U + led(postal[3])), "Uk"),
            F.when(text.rlike(U + led(postal[4])), "Canada"),
            F.when(any_of([low.contains(w) for w in context]) & text.rlike(U + led(postal[2])), "Usa"),
        ]
        return F.coalesce(*named, dialled, *coded)

    return once(F.lower(text), read)


def location_section(lines: Column, stops: list[str] = SECTION_STOPS) -> Column:
    """The filled lines among the first fifteen, up to and with the first that holds a stop word."""
    def cut(top: Column) -> Column:
        stop = F.array_position(F.transform(top, lambda x: holds_any(x, stops)), True)
        return F.array_join(F.filter(F.slice(top, 1, F.coalesce(F.nullif(stop.cast("int"), F.lit(0)), F.lit(15))), lambda x: x != ""), "\n")

    return once(F.transform(F.slice(lines, 1, 15), stripped), cut)


def confidence(found: dict[str, Column]) -> Column:
    """The summed weights of the details that were found."""
    points = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit("")) != "", w).otherwise(0) for c, w in ((found[k], w) for k, w in WEIGHTS.items())])
    return (points.cast("decimal(5,2)") / 100).cast("double")


def plain_amount(lines: Column, word: str) -> Column:
    """The number on the last line with the word and a dollar sign whose digits and dots read as one."""
    hits = F.filter(lines, lambda x: F.lower(x).contains(word) & x.contains("$"))
    numbers = F.filter(F.transform(hits, lambda x: F.regexp_replace(x, r"[^0-9.]", "").try_cast("double")), lambda v: v.isNotNull())
    return F.try_element_at(numbers, F.lit(-1))
