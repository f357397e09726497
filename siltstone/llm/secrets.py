"""Secret scans by assignment-aware lexing.

Source and configuration syntax is read as name-literal pairs: ``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``name => 'literal'``, ``--name=literal``, ``<name>literal</name>``, ``#define NAME literal``,
``define('NAME', 'literal')``, ``key="name" value="literal"``, ``name ?= literal`` and ``name += literal``,
declarations with a type (``var name string =``, ``name: &str =``, ``Dim name As String =``; a type is never a name), literals in
three quotes, in backticks or with a prefix, indented blocks (``name: |``), and literals joined by ``+`` or in parentheses,
over lines too, behind a call or a name. A pair whose right side is another name takes that name's literal
(constants are propagated through chains of names, from the nearest binding before; cycles end them). Each literal
is scored by how sensitive the names are that it reaches and by how much it looks like a credential; the ones
above a threshold are reported where the literal itself stands.

Three plain kinds are always reported beside that (``assign``, ``access``, ``hex``); their rules are
fixed below. Every text is read whole, one at a time, so memory is bounded by the longest text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The plain kinds, in their order. ASCII letters only are taken in either case.
KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: A run of capitals and digits is taken whole, so the least length can be part of the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)

#: How sensitive a part of a name is; two neighbouring parts count as one where listed.
NAME_PARTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0,
    "clientsecret": 1.0, "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "connectionstring": 0.8, "dsn": 0.6, "pin": 0.5, "salt": 0.5, "key": 0.4,
}
#: Literals that stand in for a value.
PLACEHOLDERS = re.compile(r"(?:x+|\*+|\.+|changeme|example|placeholder|dummy|test|none|null|true|false|your[_-].*|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})$", re.I | re.A)
THRESHOLD = 0.6

_OPERATOR = re.compile(r"""=>|:=|[=:]|</|\#[ \t]*+define[ \t]++|\bdefine\([ \t]*+["']""", re.A)
_NAME_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-"
_TAG = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:\s[^<>]*)?\Z", re.A)
#: A literal may follow a prefix of letters (raw, bytes, formatted); others join it behind a plus, or in parentheses.
_LEAD = r"""[ \t]*+(?:[rRbBuUfF]{1,2}(?=["']))?"""
_LITERAL = r"""(?:[rRbBuUfF]{1,2}(?=["']))?(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`]*+)`)"""
_QUOTED = re.compile(r"[ \t]*+" + _LITERAL, re.A)
_JOINED = re.compile(r"\s*+\+\s*+" + _LITERAL, re.A)
_WITHIN = re.compile(r"\s*+(?:\+\s*+)?" + _LITERAL, re.A)
_PARENTHESIS = re.compile(r"[ \t]*+\(\s*+(?=[rRbBuUfF]{0,2}[\"'`])", re.A)
#: What may stand before a plus and a literal: a call, or a name.
_OPERAND = re.compile(r"""[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+(?:\([^()\n]{0,200}\))?+[ \t]*+\+[ \t]*+(?=[rRbBuUfF]{0,2}["'`])""", re.A)
#: A type behind a colon, with an assignment behind it. Types of more than 200 characters aren't taken for such.
_TYPE = re.compile(r"""[ \t]*+[&*]*+(?:'[a-z_]++[ \t]++)?(?:mut[ \t]++)?[A-Za-z_][A-Za-z0-9_.:<>\[\]|&?*,' \t]{0,200}?(?:[ \t](=)[ \t]++(?=\S)|(=)[ \t]*+(?=[rRbBuUfF]{0,2}["'`]))""", re.A)
#: A declaration whose type follows its name, as it ends before an assignment.
_DECLARED = re.compile(r"\b(var|const|let|val|[Dd]im)[ \t]++([A-Za-z_][A-Za-z0-9_]*+)[ \t]++(As[ \t]++)?([*&]*+[A-Za-z_\[][A-Za-z0-9_.\[\]<>*]*+)[ \t]*+\Z", re.A)
#: Names of types, which stand for no literal.
TYPES = frozenset("str string String &str char byte bytes bool int long float double object any Any error rune None Optional Final Text AnyStr StringBuilder wstring".split())
#: Names that hold a name, and those that hold its value beside them.
KEY_NAMES, VALUE_NAMES = frozenset("key name id property field setting variable".split()), frozenset("value content val default".split())
_GAP = re.compile(r"""["'`,;\s-]{0,200}\Z""", re.A)
_DEFINED = re.compile(r"""([A-Za-z_][A-Za-z0-9_]*+)(?:[ \t]++|["'][ \t]*+,)""", re.A)
_TRIPLE = re.compile(_LEAD + r"""("{3}|'{3})""", re.A)
#: A block of YAML: its lines follow, further in than the line of the name.
_BLOCK_MARK = re.compile(r"[ \t]++[|>][+-]?[0-9]?[+-]?[ \t]*+\r?\n", re.A)
_BLOCK_LINE = re.compile(r"([ \t]*+)([^\n]*+)(?:\n|\Z)", re.A)
_BARE_START = re.compile(r"""[ \t]*+(?:(?:Bearer|Basic|Token)[ \t]++)?+(?=[^\s"'`;,(){}\[\]])""", re.A | re.I)
_BARE_END = re.compile(r"""[\s"'`;,(){}\[\]]|\Z""", re.A)
#: A PEM block may follow an opening quote (or three), a block mark of YAML and line ends.
_PEM_START = re.compile(r"""[ \t]*+(?:[|>][+-]?[ \t]*+)?+(?:\r?\n[ \t]*+)?+["']{0,3}(?:\\n|\s)*+(?=-----BEGIN )""", re.A)
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(.*)-----END ", re.A | re.S)
#: Longer bare literals are scored by running counts, so that many in one another take linear time.
_LONG = 4096
_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+\Z", re.A)
_PEM_LABEL = re.compile(r"[A-Z0-9 ]*+-----", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three plain kinds, in code points, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower() if text.isascii() else text
    if not text.isascii() or any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    """0 to 1: the most sensitive part, or pair of neighbouring parts, of a name in any case style."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((NAME_PARTS.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)


def counted_score(counts: Mapping[str, int], size: int) -> float:
    """0 to 1: entropy and character classes of characters that occur ``counts`` times."""
    shares = [n / size for n in counts.values() if n]
    bits = -sum(p * log2(p) for p in shares)
    classes = sum(any(n and f(c) for c, n in counts.items()) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / 3.0) * (0.6 + 0.2 * min(classes - 1, 2))


def literal_score(value: str) -> float:
    """0 to 1: length, character classes and entropy of a literal; 0 for stand-ins and prose.

    A PEM block has the score of its body; of several words, those with letters and digits count.
    """
    if pem := _PEM.search(value):
        return literal_score("".join(pem[2].replace("\\r", "").replace("\\n", "").split()))
    if len(value) < ASSIGN_LEAST or PLACEHOLDERS.match(value):
        return 0.0
    parts = value.split()
    if parts != [value]:
        return max((literal_score(x) for x in parts if any(map(str.isdigit, x)) and any(map(str.isalpha, x))), default=0.0)
    return counted_score(Counter(value), len(value))


def name_before(text: str, at: int) -> str:
    """The name that ends before ``at``, behind blanks and two closing marks at most; empty if there is none."""
    while at and text[at - 1] in " \t":
        at -= 1
    for _ in range(2):
        at -= at > 0 and text[at - 1] in "\"']"
    size = 64
    while True:
        part = text[max(0, at - size) : at]
        rest = part.rstrip(_NAME_CHARS)
        if rest or size >= at:
            return part[len(rest) :].lstrip("0123456789.-")
        size *= 2


def block_of_lines(text: str, at: int, begin: int) -> tuple[int, int] | None:
    """(start, end) of the lines from ``begin`` that stand further in than the line of ``at``; None if there is none."""
    line = text.rfind("\n", 0, at) + 1
    own = _BLOCK_LINE.match(text, line)
    depth, start, end = len(own[1]), -1, -1
    while begin < len(text):
        m = _BLOCK_LINE.match(text, begin)
        content = m[2].rstrip()
        if content and len(m[1]) <= depth:
            break
        if content:
            start = m.start(2) if start < 0 else start
            end = m.start(2) + len(content)
        begin = m.end()
    return (start, end) if start >= 0 else None


def lex(text: str) -> list[tuple[str, str | None, str | None, int, int]]:
    """(name, literal, reference, start, end) of each pair; joined literals are one value, spanning all.

    The literal is None where it is text[start:end]. Names and literals may be of any length, and every
    stretch is scanned once.
    """
    pairs: list[tuple[str, str | None, str | None, int, int]] = []
    closed = word_end = word_strip = pem_end = -1
    unclosed: set[str] = set()
    typed, behind_type = "", -1  # the name whose type ends in an assignment there
    for op in _OPERATOR.finditer(text):
        at, begin = op.start(), op.end()
        if at < behind_type:
            continue
        if op.group() == "</":
            floor, closed = max(closed, 0), at
            begin = text.rfind(">", floor, at)
            if begin < 0 or text.find("<", begin, at) >= 0:
                continue
            opened = text.rfind("<", floor, begin)
            tag = _TAG.match(text, opened, begin) if opened >= 0 else None
            value = text[begin + 1 : at].strip() if tag else ""
            if len(value) >= ASSIGN_LEAST and ("\n" not in value or _PEM.match(value)):
                start = text.index(value, begin + 1)
                pairs.append((tag[1], None, None, start, start + len(value)))
            continue
        if "define" in op.group():
            if not (defined := _DEFINED.match(text, begin)):
                continue
            name, begin = defined[1], defined.end()
        elif at == behind_type:
            name = typed
        else:
            name = assigned_name(text, at)
        if not name:
            continue
        if op.group() == ":" and (kind := _TYPE.match(text, begin)):
            typed, behind_type = name, kind.start(kind.lastindex)
            continue
        if pem := _PEM_START.match(text, begin):
            if pem_end < pem.end():
                pem_end = text.find("-----END ", pem.end())
                pem_end = len(text) + 1 if pem_end < 0 else pem_end
            if pem_end < len(text):
                label = _PEM_LABEL.match(text, pem_end + 9)
                pairs.append((name, None, None, pem.end(), label.end() if label else pem_end + 9))
                continue
        if op.group() == ":" and (mark := _BLOCK_MARK.match(text, begin)) and (lines := block_of_lines(text, at, mark.end())):
            pairs.append((name, None, None, *lines))
            continue
        if (triple := _TRIPLE.match(text, begin)) and triple[1] not in unclosed:
            stop = text.find(triple[1], triple.end())
            if stop >= 0:
                pairs.append((name, None, None, triple.end(), stop))
                continue
            unclosed.add(triple[1])  # nor is any later one
        open_ = _PARENTHESIS.match(text, begin)
        before = open_ or _OPERAND.match(text, begin)
        if part := _QUOTED.match(text, before.end() if before else begin):
            values, start, end = [part[part.lastindex]], part.start(part.lastindex), part.end(part.lastindex)
            while more := (_WITHIN if open_ else _JOINED).match(text, part.end()):
                values.append(more[more.lastindex])
                end, part = more.end(more.lastindex), more
            found = (name, "".join(values) if len(values) > 1 else None, None, start, end)
        elif bare := _BARE_START.match(text, begin):
            start = bare.end()
            if start >= word_end:
                word_end = word_strip = _BARE_END.search(text, start).start()
                while word_strip > start and text[word_strip - 1] in ".,:":
                    word_strip -= 1
            end = max(start, word_strip)
            refers = text[start:end] if _PLAIN_NAME.match(text, start, end) else None
            found = (name, None, refers if refers not in TYPES else None, start, end)
        else:
            continue
        pairs.append(found)
        named = paired(text, pairs, at)
        if named:
            pairs.append(named)
    return pairs


def assigned_name(text: str, at: int) -> str:
    """The name that an operator at ``at`` gives a value to: behind ``?``, ``+`` and the like, before a type that follows it."""
    back = at
    while back and at - back < 2 and text[back - 1] in "?+|&":
        back -= 1
    name = name_before(text, back)
    line = text[max(0, back - 240) : back]
    declared = _DECLARED.search(line[line.rfind("\n") + 1 :]) if "a" in line or "e" in line or "im" in line else None
    if declared and (declared[1] == "var" or declared[3] or declared[4].lstrip("*&[]") in TYPES):
        return declared[2]
    return name


def paired(text: str, pairs: list[tuple[str, str | None, str | None, int, int]], at: int) -> tuple[str, str | None, str | None, int, int] | None:
    """The pair of name and value that the last two pairs make: one holds the name, the other beside it the value."""
    if len(pairs) < 2:
        return None
    one, two = pairs[-2], pairs[-1]
    kinds = one[0].lower(), two[0].lower()
    if one[1] is not None or not ((kinds[0] in KEY_NAMES and kinds[1] in VALUE_NAMES) or (kinds[1] in KEY_NAMES and kinds[0] in VALUE_NAMES)):
        return None
    gap = text[one[4] : at].rstrip("\"' \t")
    if len(gap) > 300 or not gap.endswith(two[0]) or not _GAP.match(gap[: len(gap) - len(two[0])]):
        return None
    holder, value = (one, two) if kinds[0] in KEY_NAMES else (two, one)
    return (text[holder[3] : holder[4]], value[1], value[2], value[3], value[4])


def resolved(pairs: list[tuple[str, str | None, str | None, int, int]]) -> list[int]:
    """For each pair the one whose literal it holds: names stand for their nearest binding before, else the next after."""
    places: dict[str, list[int]] = {}
    for k, pair in enumerate(pairs):
        places.setdefault(pair[0], []).append(k)
    out = [-1] * len(pairs)
    for k in range(len(pairs)):
        path, on, at = [], set(), k
        while out[at] < 0 and at not in on:
            path.append(at)
            on.add(at)
            bindings = places.get(pairs[at][2], [])
            n = bisect_left(bindings, at)
            after = n + (n < len(bindings) and bindings[n] == at)
            if n:
                at = bindings[n - 1]
            elif after < len(bindings):
                at = bindings[after]
        for x in path:
            out[x] = at if out[at] < 0 else out[at]
    return out


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the literals that reach a sensitive name with a score of THRESHOLD or more."""
    if not any(c in text for c in "=:") and "</" not in text and "define" not in text:
        return []
    pairs = lex(text)
    if not any(name_score(x[0]) >= THRESHOLD or text.startswith("-----BEGIN ", x[3]) for x in pairs):
        return []
    found, scores = set(), {}
    run_end, run_start, counts = -1, 0, Counter()
    for k, of in enumerate(resolved(pairs)):
        name, (_, value, refers, start, end) = name_score(pairs[k][0]), pairs[of]
        if text.startswith("-----BEGIN ", start) and "PRIVATE KEY-----" in text[start : start + 60]:
            name = 1.0
        if name < THRESHOLD or (refers and refers.isalpha()):
            continue
        if of not in scores and value is None and end - start > _LONG and end == run_end and run_start <= start:
            counts.subtract(text[run_start:start])
            run_start = start
            scores[of] = counted_score(counts, end - start)
        elif of not in scores:
            value = text[start:end] if value is None else value
            scores[of] = literal_score(value)
            if end - start > _LONG and not any(map(str.isspace, value)):
                run_end, run_start, counts = end, start, Counter(value)
        if name * scores[of] >= THRESHOLD:
            found.add((start, 3, end))
    return sorted(found)


def spans(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text; a lexed literal that a plain span covers isn't repeated."""
    base = plain_spans(text)
    return sorted(base + [x for x in lexed_spans(text) if not any(a <= x[0] and x[2] <= b for a, _, b in base)])


def written(found: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span (overlaps merged) replaced by a mark."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row, from the whole text.

    Null texts count as empty; ids may repeat or be null, and every row gives one row.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = spans(text or "")
                base = [x for x in found if x[1] < 3]
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)), sha256(written(base).encode()).hexdigest(), written(found)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns with every secret in the text replaced; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [x and redacted(x, spans(x)) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def found_in(docs: DataFrame, **names: str) -> DataFrame:
    """Only rows with at least one span."""
    return scan(docs, **names).where(F.col("spans") != "")
