"""Chat formatting by schema fingerprints; DataFrame functions only.

A record's fingerprint is the hash of the nested field paths that it fills (``messages[].role``,
``instruction``, ...), in order. Each declarative mapping states the paths that it needs and those that
it may use, so the fingerprints that it accepts are known beforehand; a record's fingerprint selects
the mapping that turns it into canonical turns, an array of (role, text). Fields that no mapping knows
don't enter the fingerprint, so extra columns never hide a layout.

The template writes a turn as ``### role: text</turn>`` and a line end. Inside texts and roles the
characters that could start a control string, and the escape character, are replaced:
``\\`` by ``\\b``, ``<`` by ``\\l``, ``#`` by ``\\h`` (in roles also ``:`` by ``\\c`` and a line end by ``\\n``). No
control string can then occur in a text, and every escape is reversed by plain replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"
#: Replaced in this order, and back in the reverse order.
TEXT_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"), ("\n", "\\n"))
LEARNED_ROLE = "assistant"

# Names that ``from`` fields use for the three roles. A ``role`` field is canonical as it stands.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Each:
    """One turn for each element of an array of structs. named: roles are put into the canonical names; else they stay."""

    items: str
    role: str
    text: str
    named: bool = False


@dataclass(frozen=True)
class One:
    """One turn of a fixed role; its texts (those not empty) are joined by a blank line. No text: no turn."""

    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Mapping:
    name: str
    turns: tuple[Each | One, ...]
    optional: frozenset[str] = field(default_factory=frozenset)

    def paths(self) -> set[str]:
        found = set()
        for t in self.turns:
            found |= {f"{t.items}[].{t.role}", f"{t.items}[].{t.text}"} if isinstance(t, Each) else set(t.texts)
        return found

    def fingerprints(self) -> set[int]:
        """Of the needed paths with every choice of the optional ones."""
        free = sorted(self.paths() & self.optional)
        need = self.paths() - self.optional
        return {fingerprint_of(need | set(c)) for n in range(len(free) + 1) for c in combinations(free, n)} - {fingerprint_of(set())}


MAPPINGS = (
    Mapping("messages", (Each("messages", "role", "content"),), frozenset({"messages[].content"})),
    Mapping("conversations", (Each("conversations", "from", "value", named=True),), frozenset({"conversations[].value"})),
    Mapping(
        "instruction",
        (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",))),
        frozenset({"system", "input", "output"}),
    ),
    Mapping("prompt_completion", (One("user", ("prompt",)), One("assistant", ("completion",))), frozenset({"completion"})),
    Mapping("prompt_response", (One("user", ("prompt",)), One("assistant", ("response",)))),
    Mapping("question_answer", (One("user", ("context", "question")), One("assistant", ("answer",))), frozenset({"context", "answer"})),
)


def fingerprint_of(paths: set[str]) -> int:
    """The signed 64-bit hash of sorted, comma-joined paths; the same as the column's."""
    value = xxh64_intdigest(",".join(sorted(paths)).encode(), 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def _leaves(kind: T.DataType, path: str, filled) -> Iterator[tuple[str, object]]:
    """(path, condition) of each leaf; filled(f) is the condition that f holds for some value at this level."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(f.dataType, f"{path}.{f.name}" if path else f.name, lambda test, n=f.name, up=filled: up(lambda c: test(c[n])))
    elif isinstance(kind, T.ArrayType):
        yield from _leaves(kind.elementType, f"{path}[]", lambda test, up=filled: up(lambda c: F.exists(c, lambda x: test(x))))
    else:
        yield path, filled(lambda c: c.isNotNull())


def fingerprint(df: DataFrame, known: set[str]) -> Column:
    """The hash of the known paths that a row fills; a path through arrays is filled if any element fills it."""
    found = {}
    for f in df.schema.fields:
        if not any(p == f.name or p.startswith((f"{f.name}.", f"{f.name}[]")) for p in known):
            continue
        for path, test in _leaves(f.dataType, f.name, lambda t, c=df[f"`{f.name}`"]: t(c)):
            if path in known:
                found[path] = F.coalesce(test, F.lit(False))
    parts = [F.when(found[p], F.lit(p)) for p in sorted(found)]
    return F.xxhash64(F.concat_ws(",", *parts) if parts else F.lit(""))


def _has(df: DataFrame, path: str) -> bool:
    kind: T.DataType = df.schema
    for name in path.replace("[]", "").split("."):
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def _turn(role: Column, text: Column, named: bool = False) -> Column:
    name = F.coalesce(role.cast("string"), F.lit(""))
    if named:
        name = F.coalesce(F.create_map(*(F.lit(x) for kv in ROLE_NAMES.items() for x in kv))[name], name)
    return F.struct(name.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _each(items: Column, t: Each, has_text: bool) -> Column:
    return F.transform(items, lambda m: _turn(m[t.role], m[t.text] if has_text else F.lit(None), t.named))


def _turns(df: DataFrame, mapping: Mapping) -> Column:
    empty = F.array().cast("array<struct<role:string,text:string>>")
    parts = []
    for t in mapping.turns:
        if isinstance(t, Each):
            parts.append(_each(df[t.items], t, _has(df, f"{t.items}[].{t.text}")))
        else:
            texts = [F.when(df[p] != "", df[p]) for p in t.texts if _has(df, p)]
            if texts:
                one = F.array(_turn(F.lit(t.role), F.concat_ws("\n\n", *texts)))
                parts.append(F.when(F.coalesce(*texts).isNotNull(), one).otherwise(empty))
    return F.concat(*parts) if parts else empty


def canonical(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All columns with fingerprint, layout (a mapping's name) and turns.

    A record whose fingerprint no mapping accepts (an empty one too) keeps its row with null layout
    and null turns. Null roles and texts become empty. New columns replace old ones of these names.
    """
    known = set().union(*(m.paths() for m in mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    mark = F.col("fingerprint")
    for m in reversed(mappings):
        if any(_has(records, p) for p in m.paths()):
            layout = F.when(mark.isin(*m.fingerprints()), F.lit(m.name)).otherwise(layout)
            turns = F.when(mark.isin(*m.fingerprints()), _turns(records, m)).otherwise(turns)
    marked = records.withColumn("fingerprint", fingerprint(records, known))
    return marked.withColumns({"layout": layout, "turns": turns})


def escaped(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turned: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """All columns with formatted (the text) and loss, the spans (start, end) of the learned role's texts.

    Spans are code points of the formatted text, end exclusive. Null turns give null for both.
    """
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit(ROLE_END)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learned).alias("learned")))
    size_of = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)
    sized = turned.withColumn("__pieces", pieces).withColumn("__begins", _sums_before(F.transform("__pieces", size_of)))
    begin = lambda p, k: F.get("__begins", k) + F.length(p["head"])
    placed = F.transform("__pieces", lambda p, k: F.struct(p["learned"].alias("learned"), begin(p, k).alias("start"), (begin(p, k) + F.length(p["body"])).alias("end")))
    spans = F.transform(F.filter(placed, lambda s: s["learned"]), lambda s: F.struct(s["start"], s["end"]))
    text = F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return sized.withColumns({"formatted": text, "loss": spans}).drop("__pieces", "__begins")


def _sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it. Sums of blocks of about the square root of their count keep long arrays cheap."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    n = F.size(numbers)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    every = F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))
    blocks = F.transform(every, lambda b: total(F.slice(numbers, b * width + 1, width)))
    state = F.struct(numbers.alias("numbers"), width.alias("width"), blocks.alias("blocks"))
    held = F.transform(F.array(state), lambda s: F.struct(s["numbers"].alias("numbers"), s["width"].alias("width"), F.transform(s["blocks"], lambda x, b: total(F.slice(s["blocks"], F.lit(1), b))).alias("before")))
    block = lambda s, k: F.floor(k / s["width"]).cast("int")
    begins = F.transform(held, lambda s: F.transform(s["numbers"], lambda x, k: F.get(s["before"], block(s, k)) + total(F.slice(s["numbers"], block(s, k) * s["width"] + 1, k % s["width"]))))
    return F.when(n > 0, F.get(begins, F.lit(0))).when(n == 0, F.array().cast("array<int>"))


def parsed(text: Column) -> Column:
    """The turns, read back from a formatted text."""
    parts = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        colon = F.instr(p, ROLE_END)
        role = F.substring(p, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(F.substring(p, colon + len(ROLE_END), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def learned_texts(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss spans, read back from a formatted text."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def grouped(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, messages): rows of one turn each become records; order by turn, then role and text, nulls first.

    One row of the result holds a whole conversation, as its formatted text does.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content"))
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("messages"))
