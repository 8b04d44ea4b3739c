"""Secret scan with assignment-aware lexing.

Three base patterns run over each whole text. Beside them a lexer reads source and configuration syntax into
name-literal pairs: `name = literal`, `name: literal`, `"name": literal`, `name := a + b`, `name => literal`, `export`
and dotenv lines with bare values, YAML blocks (`name: |`), triple-quoted strings, `#define NAME literal`, calls like
`setName("literal")` and `put("name", "literal")`, XML elements and `key="name" value="literal"` attributes, typed names
(`name: &str = "literal"`), lists, what stands after `or`, `else`, `??` and the like, flags (`--name=value`), `ENV name value`
lines, `name:` and `value:` on two lines, and the password of a URL. A bare word is a literal if it looks random, or if it
is all of a line's value under a telling name, unless the text assigns to that word, when it is a constant: literals of constants are carried over to the names assigned from them, over
any number of steps. A literal is scored by how sensitive the names are that it reaches, and by its look; literals at or
above `threshold` become spans of kind `literal` unless a base span holds them already.

A bare value of more than LONG characters is taken whole and not searched for further names; base patterns read it all the same.
Literals of fewer than LEAST characters, placeholders, prose and bare words that look like identifiers score 0. Names may
have any length. Null and empty texts have no spans. Each row is scanned for itself, so repeated rows give equal rows; a
null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Sensitive parts of names and their weights.
NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.8, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "cred": 0.8, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.3, "privatekey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "signing": 0.6, "encryption": 0.6, "key": 0.4, "pin": 0.4, "salt": 0.4, "api": 0.4, "access": 0.3,
}
#: Last parts of names that are about a secret and don't hold it.
ABOUT = {
    "label", "hint", "type", "name", "url", "uri", "path", "file", "field", "count", "length", "size", "policy", "ttl", "timeout", "expiry", "expires", "format", "prompt",
    "message", "error", "header", "endpoint", "title", "text", "column", "index", "regex", "pattern", "test", "class", "icon",
    "rate", "provider", "module", "mode", "method", "status", "state", "level", "version", "id", "kind", "scheme", "service", "strategy", "manager", "handler", "required", "enabled",
}
#: Literals that stand for a value and aren't one.
PLACEHOLDERS = re.compile(r"(?i)^(?:change_?me.*|example.*|placeholder|none|null|nil|true|false|undefined|redacted|your[_-].*|x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\$\(.*\)|\{\{.*\}\}|%.*%)$", re.S)
LEAST = 6
_NAME = r"[A-Za-z_$][\w$.-]*+"
PAIR = re.compile(rf"""(?P<q>["']?)(?<![\w$.-])(?P<name>{_NAME}(?:\[["'][\w.-]+["']\])?)(?P=q)[ \t]*+(?::=|=>|=(?![=~])|:(?![:/]))[ \t]*+(?=\S)""", re.A)
PART = re.compile(
    r"""\s*(?:[fFbBrRuU]{1,2}(?=["']))?(?:\"{3}((?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`"""
    r"""|([A-Za-z_$][\w$.]*+)(?![(+/=@!#%^&*:-]\S)|([\w+/.=~!@#$%^&*:?|\\-]++)(?!\())(?:[ \t]*(\+)(?=\s*["'`\w$]))?""",
    re.A | re.S,
)
WORD = 6  # the group of PART that is a bare word; the next one takes what else stands there bare
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*", re.A)
BEARER = re.compile(r"(?i)(?:bearer|basic|token)[ \t]+(?=\S)")
BLOCK = re.compile(r"""^([ \t]*)(?:-[ \t]+)?(["']?)([A-Za-z_$][\w$.-]*)\2[ \t]*:[ \t]*[|>][+-]?\d*[ \t]*\n((?:\1[ \t]+[^\n]*(?:\n|\Z))+)""", re.A | re.M)
DEFINE = re.compile(r"""^[ \t]*#[ \t]*define[ \t]+(\w+)[ \t]+(?:"((?:[^"\\\n]|\\.)*+)"|(\S+))""", re.A | re.M)
CALL = re.compile(r"""(?<![\w$])([A-Za-z_$][\w$]*+)\([ \t]*(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')[ \t]*\)""", re.A)
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*)?>([^<>]+)</\1\s*>", re.A)
ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*=\s*(["'])([\w.:-]+)\1\s+value\s*=\s*(["'])([^"'<>]*)\3""", re.A | re.I)
_QUOTED = r"""(?:[fFbBrRuU]{1,2})?(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)"""
TYPED = re.compile(rf"""(?<![\w$.-])({_NAME})[ \t]*:[ \t]*[&\w][\w<>\[\],&' .?]{{0,60}}?[ \t]*=[ \t]*{_QUOTED}""", re.A)
LIST = re.compile(rf"""[\[({{][ \t]*(?=["'`])""", re.A)
ELEMENTS = re.compile(rf"""\s*{_QUOTED}[ \t]*(?:,|(?=[\s\])}}]))""", re.A)
FALLBACK = re.compile(rf"""(?:\bor\b|\belse\b|\|\||\?\?|\?:?|:)[ \t]*{_QUOTED}""", re.A)
NAMED_CALL = re.compile(rf"""(?<=\()[ \t]*(["'])([A-Za-z_][\w.-]*+)\1[ \t]*,[ \t]*{_QUOTED}""", re.A)
FLAG = re.compile(r"""(?<![\w-])--?([A-Za-z][\w-]*+)[= ][ \t]*(?:"([^"\n]*+)"|'([^'\n]*+)'|([^\s"'-]\S*+))""", re.A)
ENVIRONMENT = re.compile(r"""^[ \t]*(?:ENV|ARG|SET|set|setx|setenv)[ \t]+([A-Za-z_]\w*)[ \t]+(?:"([^"\n]*+)"|'([^'\n]*+)'|([^\s"'=]\S*+))""", re.A | re.M)
TWO_LINES = re.compile(r"""\b(?:name|key)[ \t]*:[ \t]*(["']?)([A-Za-z_][\w.-]*+)\1[ \t]*,?\s*\n[ \t]*(["']?)value\3[ \t]*:[ \t]*(?:"([^"\n]*+)"|'([^'\n]*+)'|([^\s"'#][^\n#]*+))""", re.A | re.I)
URL = re.compile(r"""\b[A-Za-z][\w+.-]*+://([^\s:/@"'<>]*+):([^\s/@"'<>{}$]++)@""", re.A)
BEFORE = re.compile(r"\n[ \t]*(?:export[ \t]+|-[ \t]+)?\Z")
AFTER = re.compile(r"[ \t\r]*+(?:\n|\Z)")
#: Characters before a name that may be its line's indent, and after a value in which it may fall back to another.
INDENT, REST = 80, 200
#: Bare values longer than this are not searched for names within, which keeps the lexing linear.
LONG = 1 << 14
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
KINDS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")


def sensitivity(name: str) -> float:
    """How much a name promises a secret: its parts, and pairs of parts, by NAMES; little if it is about one, by ABOUT."""
    parts = [w.lower() for w in WORDS.findall(name.rsplit(".", 1)[-1])]
    parts = [p[:-1] if p not in NAMES and p[-1:] == "s" and p[:-1] in NAMES else p for p in parts]
    single = [NAMES.get(p, 0.0) for p in parts]
    pairs = [max(NAMES.get(a + b, 0.0), min(1.0, NAMES.get(a, 0) + NAMES.get(b, 0)) if b in NAMES and a in NAMES else 0) for a, b in zip(parts, parts[1:])]
    return max([0.0, *single, *pairs]) * (0.3 if parts and (parts[-1] in ABOUT or "public" in parts) else 1.0)


def weight(literal: str) -> float:
    """How much a literal looks like a secret: kinds of characters and entropy; 0 for short ones, placeholders and prose."""
    literal = literal.strip()
    n, tokens = len(literal), literal.split()
    if n < LEAST or PLACEHOLDERS.match(literal) or len(tokens) > 1 and not any(len(t) >= 12 and re.search("[0-9]", t) for t in tokens):
        return 0.0
    counts = [literal.count(c) for c in set(literal)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 + 0.12 * entropy + 0.1 * kinds)


def random_word(value: str) -> bool:
    """A bare word that no one would choose as an identifier: digits between letters, or several changes of case."""
    runs = KINDS.findall(value)
    return bool(re.search("[0-9]", value)) and (len(runs) >= 5 or len(runs) >= 4 and len(value) >= 10 and "_" not in value and "." not in value)


def telling(name: str, value: str) -> bool:
    """A bare word that is all of a line's value counts under a name that promises a secret, if it is long or holds digits."""
    return sensitivity(name) >= 0.7 and "." not in value and (len(value) >= 12 or len(value) >= 8 and bool(re.search("[0-9]", value)))


#: A bare word that is all of a line's value.
WHOLE = 2


def _alone(text: str, start: int, end: int) -> bool:
    """Whether an assignment from start to end is all that its line holds."""
    return BEFORE.search(("\n" if start <= INDENT else "") + text[max(0, start - INDENT) : start]) is not None and AFTER.match(text, end) is not None


def _further(text: str, name: str, at: int):
    """Literals of a list that stands at a place, and those that the rest of the line falls back to, as pairs_of() gives them."""
    if m := LIST.match(text, at):
        p = m.end()
        while q := ELEMENTS.match(text, p):
            k = q.lastindex
            yield name, [(False, q.group(k), q.start(k), q.end(k))]
            p = q.end()
        return
    rest = text[at : at + REST].partition("\n")[0]
    if '"' in rest or "'" in rest or "`" in rest:
        for m in FALLBACK.finditer(rest):
            k = m.lastindex
            yield name, [(False, m.group(k), at + m.start(k), at + m.end(k))]


def pairs_of(text: str):
    """(name, parts) of each assignment; parts are (is a bare word, or WHOLE, value, start, end)."""
    at = 0
    while m := PAIR.search(text, at):
        parts, p = [], m.end()
        if b := BEARER.match(text, p):
            p = b.end()
        while q := PART.match(text, p):
            kind = next(i for i in range(7, 0, -1) if q.group(i) is not None)
            parts.append((kind == WORD or kind > WORD and IDENTIFIER.fullmatch(q.group(kind)) is not None, q.group(kind), q.start(kind), q.end(kind)))
            p = q.end()
            if not q.group(8):
                break
        if len(parts) == 1 and parts[0][0] and _alone(text, m.start(), parts[0][3]):
            parts = [(WHOLE, *parts[0][1:])]
        yield m["name"], parts
        if sensitivity(m["name"]):
            yield from _further(text, m["name"], p)
        nested = bool(parts) and text[parts[-1][3] : parts[-1][3] + 1] not in ('"', "'", "`")  # what follows a bare value may itself be a name
        at = m.end() if nested and parts[-1][3] - parts[-1][2] <= LONG or not parts else p
    for pattern, mark in ((TYPED, "="), (NAMED_CALL, "("), (FLAG, "-"), (ENVIRONMENT, " "), (TWO_LINES, "alue")):
        if mark in text:
            for m in pattern.finditer(text):
                k = m.lastindex
                yield m.group(2 if pattern in (NAMED_CALL, TWO_LINES) else 1), [(False, m.group(k).rstrip(), m.start(k), m.start(k) + len(m.group(k).rstrip()))]
    if "://" in text:
        for m in URL.finditer(text):
            yield "password", [(False, m.group(2), m.start(2), m.end(2))]
    if "|" in text or ">" in text:
        for m in BLOCK.finditer(text):
            body = m.group(4)
            yield m.group(3), [(False, body.strip(), m.start(4) + len(body) - len(body.lstrip()), m.start(4) + len(body.rstrip()))]
    if "define" in text:
        for m in DEFINE.finditer(text):
            k = 2 if m.group(2) is not None else 3
            yield m.group(1), [(k == 3, m.group(k), m.start(k), m.end(k))]
    if "(" in text:
        for m in CALL.finditer(text):
            k = 2 if m.group(2) is not None else 3
            yield m.group(1), [(False, m.group(k), m.start(k), m.end(k))]
    if "</" in text:
        for m in ELEMENT.finditer(text):
            yield m.group(1), [(False, m.group(2), m.start(2), m.end(2))]
    if "value" in text:
        for m in ATTRIBUTES.finditer(text):
            yield m.group(2), [(False, m.group(4), m.start(4), m.end(4))]


def literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals by the names they reach."""
    pairs = list(pairs_of(text))
    if not pairs:
        return []
    sources: dict[str, set[str]] = {name: set() for name, _ in pairs}
    for name, parts in pairs:
        sources[name].update(value for word, value, _, _ in parts if word and value in sources)
    reach: dict[str, float] = {}
    todo = [(sensitivity(name), name) for name in sources]
    while todo:  # a name that is used in a sensitive assignment is sensitive itself, over any number of steps in any order
        score, name = todo.pop()
        for value in sources.get(name, ()):
            if score > reach.get(value, 0.0):
                reach[value] = score
                todo.append((score, value))
    out = []
    for name, parts in pairs:
        score = max(sensitivity(name), reach.get(name, 0.0))
        if score:
            own = [(v, s, e) for word, v, s, e in parts if v and not (word and (v in sources or not (random_word(v) or word == WHOLE and telling(name, v))))]
            whole = "".join(v for v, _, _ in own)
            out += [(s, e, score * w) for v, s, e in own if (w := weight(whole if len(v) < LEAST else v))]
    return out


def scan_text(text: str, threshold: float = 0.45) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans of one text: (start, end, kind)."""
    base = []
    if "=" in text or ":" in text:
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    kinds = ("assign", "access", "hex")
    base.sort(key=lambda x: (x[0], kinds.index(x[2])))
    more = []
    if any(c in text for c in "=:<(#") or "--" in text or ENVIRONMENT.search(text):
        more = sorted({(s, e, "literal") for s, e, score in literals(text) if score >= threshold and not any(a <= s and e <= b for a, b, _ in base)})
    return base, more


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def scan(docs: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(doc_id, spans) of every document; spans are in code points, end exclusive, by start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def task(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, more = scan_text(text.as_py() or "", threshold)
                rows.append([{"kind": k, "start": s, "end": e, "base": b} for b, found in ((True, base), (False, more)) for s, e, k in found])
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, f"doc_id long, spans {SPANS}")


def _joined(spans):
    order = lambda x: F.when(x.kind == "assign", 0).when(x.kind == "access", 1).when(x.kind == "hex", 2).otherwise(3)
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), order(x).alias("o"), x.end.alias("end"), x.kind.alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x.base & (x.kind == k))).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(F.filter("spans", lambda x: x.base)).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )
