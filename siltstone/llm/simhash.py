"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints that differ in few bits must agree
nearly in some segment, so each looks up, in the table of every segment, all values within a small
Hamming ball around its own; what the tables hold there is compared in full.

For a distance r and m segments let r = m*q + a: either one of the first a + 1 segments differs in
q bits at most, or one of the others in q - 1. Segments may also be joined: of all choices of t segments out
of m, some one differs in r*t // m bits at most. The longer such a key, the fewer fingerprints share a value,
and the more probes there are; ``keys`` takes the choice with the least expected work for the number of
fingerprints (three segments of 21 or 22 bits with balls of 23, 22 and 1 values up to millions, joined ones
beyond).

Equal fingerprints are one entry of the tables, however many documents share one, and links join
fingerprints, not documents. Skewed segments are split by adaptive execution, as the lookup is a
plain equality join. What shares a value with many others is first compared with the least of them;
only fingerprints that are still in different components then meet each other, so that a cluster of near copies
is not listed pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, small, stored, utf8_rows
from siltstone.llm.components import connected_components
from siltstone.llm.simhash_core import BITS, fingerprint

DISTANCE = 4
#: In values of more fingerprints than this, fingerprints meet the least one first.
MANY = 8
#: Lists of such values are broadcast up to this many, else shuffled.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Key:
    """parts: the segments (shift, mask) that are joined; flips: the values to flip, as masks of the whole fingerprint."""

    parts: tuple[tuple[int, int], ...]
    flips: tuple[int, ...]

    @property
    def mask(self) -> int:
        return sum(m << s for s, m in self.parts)


def segments_of(n: int) -> list[tuple[int, int]]:
    """(shift, mask) of n segments of nearly equal length."""
    base, rest = divmod(BITS, n)
    widths = [base + (k < rest) for k in range(n)]
    return [(sum(widths[:k]), (1 << w) - 1) for k, w in enumerate(widths)]


def key_set(distance: int, segments: int, joined: int = 1) -> list[Key]:
    """The keys of one choice, by the pigeonhole rules above."""
    parts = segments_of(segments)
    q, a = divmod(distance, segments)
    found = []
    for chosen in combinations(range(segments), joined):
        radius = (q if chosen[0] <= a else q - 1) if joined == 1 else distance * joined // segments
        places = [s + i for k in chosen for s, m in [parts[k]] for i in range(m.bit_length())]
        flips = tuple(sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(places, n))
        if flips:
            found.append(Key(tuple(parts[k] for k in chosen), flips))
    return found


def work(keys: list[Key], n: int) -> float:
    """Expected entries, probes and matches of a fingerprint among n that are spread evenly."""
    return sum(1 + len(k.flips) * (1 + n / 2 ** k.mask.bit_count()) for k in keys)


def keys(distance: int, n: int) -> list[Key]:
    """The key set of the least expected work."""
    choices = [(m, t) for m in range(2, 9) for t in range(1, m) if sum(comb(BITS * t // m, i) for i in range(distance * t // m + 1)) * comb(m, t) < 2000]
    return min((key_set(distance, m, t) for m, t in choices), key=lambda k: work(k, n))


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null and wordless texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, width) for x in utf8_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _tables(distinct: DataFrame, wanted: list[Key]) -> tuple[DataFrame, DataFrame]:
    """((seg, val, a), (seg, val, b)): the entries of all tables, and the values that each fingerprint looks up."""
    value = lambda k: F.col("fp").bitwiseAND(F.lit(_signed(k.mask)))
    entries = F.array(*(F.struct(F.lit(n).alias("seg"), value(k).alias("val")) for n, k in enumerate(wanted)))
    flip = lambda n, k: F.transform(F.lit([_signed(f) for f in k.flips]).cast("array<long>"), lambda f: F.struct(F.lit(n).alias("seg"), value(k).bitwiseXOR(f).alias("val")))
    probes = F.concat(*(flip(n, k) for n, k in enumerate(wanted)))
    return distinct.select(F.col("fp").alias("a"), F.inline(entries)), distinct.select(F.col("fp").alias("b"), F.inline(probes))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, distance: int = DISTANCE, wanted: list[Key] | None = None) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints (column fp) within ``distance`` bits."""
    index, probe = _tables(distinct, wanted or keys(distance, distinct.count()))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return index.join(probe, ["seg", "val"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def roots(distinct: DataFrame, distance: int = DISTANCE, wanted: list[Key] | None = None, many: int = MANY) -> DataFrame:
    """(node, root): the components over all links, without listing all links.

    First every probe meets all entries of values that ``many`` have at most, and the least entry of the
    others; then, in those others, entries of other components alone. Fingerprints without a link are left out.
    """
    index, probe = _tables(distinct, wanted or keys(distance, distinct.count()))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    sizes = index.groupBy("seg", "val").agg(F.count("*").alias("n"), F.min("a").alias("least"))
    crowded = stored(sizes.where(F.col("n") > many).select("seg", "val", "least"), "crowded")
    marked = index.join(small(crowded, BROADCAST_ROWS), ["seg", "val"], "left").where(F.col("least").isNull() | (F.col("a") == F.col("least"))).drop("least")
    first = connected_components(marked.join(probe, ["seg", "val"]).where((F.col("a") != F.col("b")) & near).select("a", "b"))
    first = checkpointed(distinct.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    only = lambda rows: rows.join(small(crowded.select("seg", "val"), BROADCAST_ROWS), ["seg", "val"], "left_semi")
    of = lambda c: first.select(F.col("fp").alias(c), F.col("root").alias(f"{c}_root"))
    left, right = only(index).join(of("a"), "a"), only(probe).join(of("b"), "b")
    across = left.join(right, ["seg", "val"]).where((F.col("a_root") != F.col("b_root")) & near)
    more = connected_components(across.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    whole = first.join(more.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left")
    return whole.select(F.col("fp").alias("node"), F.coalesce("whole", "root").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable over links.

    Ids may repeat (each row is kept) or be null (a null id is no candidate for component_id unless
    its whole component is null). Other columns, whatever their names, are not read.
    """
    marks = checkpointed(fingerprints(docs, width, id_col, text_col))
    distinct = checkpointed(marks.groupBy("fp").agg(F.min(id_col).alias("least")))
    joined = distinct.join(roots(distinct.select("fp"), distance).withColumnRenamed("node", "fp"), "fp")
    whole = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(whole, "root").select("fp", "component_id")
    return marks.join(of, "fp").select(id_col, "fp", "component_id")
