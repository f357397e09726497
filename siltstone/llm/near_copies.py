"""Near copies by word shingles: SimHash multi-index hashing proposes links, the real shingle similarity decides.

Two texts are near copies if the sets of their ``WIDTH``-word shingles have a Jaccard similarity of ``LEAST``
or more. At 0.8 the SimHashes of two texts differ in 15 % of their bits, too many for balls around the
segments of 64 bits. So fingerprints have 1,536 bits, and tables of segments are drawn from
permuted fingerprints; a pair is proposed if some segment agrees and the whole fingerprints differ in no more
bits than nearly any pair of that similarity would (four standard deviations above the mean, 99.997 % of pairs
at a similarity of exactly ``LEAST``). Segments are as long as
the number of texts asks for (most values then hold one text), and there are as many tables as give RECALL
at a similarity of ``LEAST`` by the binomial distribution (at 0.9 all but a few in 10^5). Most pairs below a
similarity of 0.7 differ in more bits, so that few are verified in vain.

1. Rows with the same words are one node. In a segment's value that up to MANY nodes have, all of them are
   paired; of more nodes, each is paired with the least one. Values are counted with their least and greatest
   node and the exclusive or of the first fingerprint words, which is all that a value of two nodes takes.
2. Of each node's pairs one is verified first, then those of the others that this hasn't joined; the links make
   components. In a value of more than MANY nodes, those of different components are then paired
   by whole fingerprints, in the first such value that they share. What has been joined isn't verified again; what remains of a large group near the
   threshold is paired in full.

Nodes meet each other by equality joins, which adaptive execution splits; no value is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from siltstone.llm.common import checkpointed, small, stored, utf8_rows
from siltstone.llm.components import connected_components
from siltstone.llm.simhash_core import shingles
from siltstone.llm.words import mixed

WIDTH, LEAST = 5, 0.8
WORDS, RECALL, LEAST_SEGMENT = 24, 0.96, 18
#: Differing bits allowed in the first 64 bits and in all; 9.7 and 233 are expected at a similarity of 0.8.
FIRST_BITS, ALL_BITS = 22, 289
#: In values of more nodes than this, nodes meet the least one first.
MANY = 4
#: Lists of such values are broadcast up to this many, else shuffled.
BROADCAST_ROWS = 200_000
_SALTS = np.array([0x9E3779B97F4A7C15 * k & (2**64 - 1) for k in range(1, WORDS + 1)], np.uint64)
_BLOCK = 240


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes."""
    return np.unique(np.array([xxh64_intdigest(x) for x in shingles(text, width)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of WORDS signed longs. Ones are summed as bytes, a block of rows at a time."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        salted = mixed(hashes[at : at + _BLOCK, None] + _SALTS)
        ones += np.add.reduce(np.unpackbits(salted.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)


@lru_cache(maxsize=1)
def segments(n: int, least: float) -> np.ndarray:
    """(tables, bits): the fingerprint bits that each table's segment takes, for n texts."""
    bits = max(LEAST_SEGMENT, int(n).bit_length() + 2)
    agree = 1 - acos(2 * least / (1 + least)) / pi
    tables = max(1, ceil(log(1 - RECALL) / log(1 - agree**bits)))
    return np.array([np.random.default_rng(t).permutation(64 * WORDS)[:bits] for t in range(tables)])


def slots(wide: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each fingerprint (a row of WORDS longs) its segment values, numbered across tables."""
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
    value = np.zeros((len(wide), len(chosen)), np.int64)
    for k in range(chosen.shape[1]):
        value = value * 2 + bits[:, chosen[:, k]]
    return value + (np.arange(len(chosen)) << chosen.shape[1])


def _nodes(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key) of each row; (node, key, id, size, w0, w1, ...) of each different text, with its least id and number of shingles."""
    names = ["size", *(f"w{k}" for k in range(WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_rows(batch.column(1))
            keys = [xxh3_128_digest(b" ".join(x.lower().split())) for x in texts]
            wide = np.zeros((len(texts), WORDS + 1), np.int64)
            for row, text in zip(wide, texts, strict=True):
                hashes = shingle_hashes(text, width)
                row[0], row[1:] = len(hashes), wide_fingerprint(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *(pa.array(c) for c in wide.T.copy())], ["id", "key", *names])

    schema = "id long, key binary, " + ", ".join(f"{n} long" for n in names)
    marks = checkpointed(docs.select(id_col, text_col).mapInArrow(run, schema))
    nodes = marks.groupBy("key").agg(F.min("id").alias("id"), *(F.first(n).alias(n) for n in names))
    return marks.select("id", "key"), checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))


def _entries(nodes: DataFrame, n: int, least: float) -> DataFrame:
    """(slot, node, w0): the tables of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = segments(n, least)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                wide = np.stack([batch.column(1 + k).to_numpy() for k in range(WORDS)], axis=1)
                node, first = (np.repeat(batch.column(k).to_numpy(), len(chosen)) for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slots(wide, chosen).ravel(), node, first)], ["slot", "node", "w0"])

    return nodes.select("node", *(f"w{k}" for k in range(WORDS))).mapInArrow(run, "slot long, node long, w0 long")


def _apart(a: str, b: str, n: int) -> Column:
    """Bits in which the first n words of two fingerprints differ."""
    return sum((F.bit_count(F.col(f"{a}w{k}").bitwiseXOR(F.col(f"{b}w{k}"))) for k in range(n)), F.lit(0))


def _near(least: float) -> Column:
    """Whether the whole fingerprints a_ and b_ are near, and the texts so alike in size that they may be ``least`` alike."""
    sizes = F.least("a_size", "b_size") >= F.lit(least) * F.greatest("a_size", "b_size")
    return sizes & (_apart("a_", "b_", WORDS) <= ALL_BITS)


def _close(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b, a_id, b_id) of the pairs (a, b) that ``_near`` lets pass and whose roots don't say already that they belong together."""
    columns = ["node", "root", "id", "size", *(f"w{k}" for k in range(WORDS))]
    of = lambda side: nodes.select(*(F.col(c).alias({"node": side}.get(c, f"{side}_{c}")) for c in columns))
    joined = (F.col("a_root") == F.col("b_root")) | (F.col("a_root") == F.col("b")) | (F.col("b_root") == F.col("a"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(~joined & _near(least)).select("a", "b", "a_id", "b_id")


def _alike(close: DataFrame, docs: DataFrame, width: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of ``close`` whose shingle sets, as 64-bit hashes, are at least ``least`` alike."""
    close = checkpointed(close)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(x, width).view(np.int64) for x in utf8_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "grams"])

    ids = checkpointed(close.select(F.col("a_id").alias(id_col)).union(close.select("b_id")).distinct())
    grams = docs.select(id_col, text_col).join(small(ids, BROADCAST_ROWS), id_col, "left_semi").mapInArrow(run, "id long, grams array<long>")
    both = close.join(grams.select(F.col("id").alias("a_id"), F.col("grams").alias("a_grams")), "a_id")
    both = both.join(grams.select(F.col("id").alias("b_id"), F.col("grams").alias("b_grams")), "b_id")
    both = both.select("a", "b", F.size("a_grams").alias("n"), F.size("b_grams").alias("m"), F.size(F.array_intersect("a_grams", "b_grams")).alias("common"))
    return checkpointed(both.where(F.col("common") >= F.lit(least) * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b"))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes with the roots of (node, root); a node that isn't there is its own."""
    return nodes.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, group) of every row; rows of one group are linked by near copies. Ids are unique longs.

    Texts without words are copies of each other.
    """
    marks, nodes = _nodes(docs, width, id_col, text_col)
    n = nodes.count()
    entries = _entries(nodes, n, least)
    values = entries.groupBy("slot").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor("w0").alias("apart"))
    values = stored(values.where("n > 1"), "values")
    of_two = values.where((F.col("n") == 2) & (F.bit_count("apart") <= FIRST_BITS)).select("a", "b")
    more = values.where("n > 2").select("slot", (F.col("n") > MANY).alias("many"))
    shared = stored(entries.join(small(more, BROADCAST_ROWS), "slot"), "shared")
    left, right = (shared.where("not many").select("slot", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "w0"))) for s in "ab")
    paired = left.join(right, "slot").where((F.col("a_node") < F.col("b_node")) & (_apart("a_", "b_", 1) <= FIRST_BITS)).select("a_node", "b_node")

    crowd = shared.where("many").select("slot", F.col("node").alias("b"), F.col("w0").alias("b_w0"))
    pivots = values.where(F.col("n") > MANY).select("slot", "a").join(shared.select("slot", F.col("node").alias("a"), F.col("w0").alias("a_w0")), ["slot", "a"])
    stars = crowd.join(pivots, "slot").where((F.col("a") < F.col("b")) & (_apart("a_", "b_", 1) <= FIRST_BITS)).select("a", "b")
    pairs = checkpointed(of_two.union(paired).union(stars).distinct())
    verified = lambda close: _alike(close, docs, width, least, id_col, text_col)
    nodes = nodes.withColumn("root", F.col("node"))
    one = verified(_close(pairs.groupBy("b").agg(F.min("a").alias("a")), nodes, least))
    nodes = checkpointed(_rooted(nodes, one.select(F.col("b").alias("node"), F.col("a").alias("root"))))
    links = one.union(verified(_close(pairs, nodes, least)))
    nodes = checkpointed(_rooted(nodes, connected_components(links)))

    crowd = crowd.select("slot", F.col("b").alias("node"))
    marked = checkpointed(crowd.join(nodes.select("node", "root"), "node"))
    apart = marked.groupBy("slot").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("slot")
    dense = checkpointed(marked.join(small(checkpointed(apart), BROADCAST_ROWS), "slot", "left_semi").select("slot", "node"))
    held = dense.groupBy("node").agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # one for each table at most
    names = ["node", "root", "id", "size", "slots", *(f"w{k}" for k in range(WORDS))]
    known = dense.join(nodes.join(held, "node").select(names), "node")
    of = lambda side: known.select("slot", *(F.col(c).alias({"node": side}.get(c, f"{side}_{c}")) for c in names))
    first = F.element_at(F.array_intersect("a_slots", "b_slots"), 1)  # a pair comes from the first value that it shares
    across = of("a").join(of("b"), "slot").where((F.col("a_root") < F.col("b_root")) & _near(least) & (F.col("slot") == first)).select("a", "b", "a_id", "b_id")
    stars = nodes.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b"))
    nodes = _rooted(nodes, connected_components(stars.union(verified(across))))
    return marks.join(nodes.select("key", F.col("root").alias("group")), "key").select(F.col("id").alias(id_col), "group")
