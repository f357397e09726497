"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are extended so that the largest inner product becomes the smallest angle, rotated by
rotations learned on a bounded sample (iterative quantisation), and cut to their signs. A code has TABLES
substrings of about log2(rows) bits, each entered in a table of its own.

1. Probing. A query looks up, in every table, all values within a few bits of its own substring. By the
   pigeonhole rule that retrieves every code within TABLES * (bits + 1) - 1 bits, and most of those farther
   away. Where the sample has neighbours that near, a first round flips one bit, and a query whose k nearest lie
   within half of the radius that this guarantees is settled. The others flip as many bits as retrieve RECALL
   of the neighbours within the sample.
2. Of the codes retrieved, those within the learned Hamming radius are scored by inner products of the
   original vectors in double precision. No other pair is.
3. A query that has fewer than k answers by then is scored against all rows, in blocks.

A table is dealt to tasks by the leading bits of the substring, a range of values each: entries and probing
queries meet by equality of (table, leading bits), the rest of the substring is enumerated within the task.
Ranges that hold more than BLOCK entries (clusters) are split, and their queries go to every part. Rows
with equal vectors are one entry, represented by their k + 1 smallest ids, which is exact, as equal scores
go to smaller ids. Nothing is capped: of a range each query keeps its k + 1 best, by score.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import checkpointed, small

TABLES = 32
#: Bits of a substring that are enumerated within a task; the leading ones deal the table to tasks.
INNER_BITS, LEAST_PIECE, MOST_PIECE = 13, 10, 30
#: Rows of the sample that rotations and radii are learned on, about.
SAMPLE_ROWS = 8192
CALIBRATION_QUERIES = 512
#: Shares of the sample's neighbours that probing retrieves and that lie within the Hamming radius.
RECALL, QUANTILE = 0.97, 0.985
BLOCK = 16384
BROADCAST_ROWS = 100_000
_PAIRS = 1 << 20


@dataclass(frozen=True)
class Coder:
    """rotation: (dims + 1, bits); largest: the largest norm; piece: bits of a substring; flips, radius, close: learned.

    close: whether some neighbours of the sample lie within half of what one flip guarantees.
    """

    rotation: np.ndarray
    largest: float
    piece: int
    flips: int = 0
    radius: int = 0
    close: bool = True

    @property
    def kind(self) -> str:
        """How a substring is stored."""
        return "<u2" if self.piece <= 16 else "<u4"

    @property
    def lead(self) -> int:
        return max(0, self.piece - INNER_BITS)

    def pieces(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """(n, TABLES) substrings: queries are extended by 0, rows by what their norm lacks."""
        lack = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.largest**2 - (vectors**2).sum(axis=1), 0))
        bits = (np.column_stack([vectors, lack]) @ self.rotation > 0).reshape(len(vectors), TABLES, self.piece)
        return (bits << np.arange(self.piece, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes (rows of substrings), pair by pair."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def settled_bits(flips: int) -> int:
    """Half of the bits within which so many flips retrieve every code."""
    return (TABLES * (flips + 1) - 1) // 2


def flips_of(bits: int, most: int) -> np.ndarray:
    """All values of ``bits`` bits with ``most`` ones at most."""
    return np.array([sum(1 << i for i in c) for n in range(min(most, bits) + 1) for c in combinations(range(bits), n)], np.uint32)


def learn_rotation(vectors: np.ndarray, seed: int, rounds: int = 15) -> np.ndarray:
    """An orthogonal matrix that brings the vectors near to the corners of a cube (signs)."""
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(vectors.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(vectors.T @ np.where(vectors @ rotation > 0, 1.0, -1.0))
        rotation = u @ w
    return rotation


def fit(sample: np.ndarray, largest: float, rows: int, k: int) -> Coder:
    """Learn rotations on the sample, and the flips and radius that its rows' neighbours need.

    A row's k neighbours among all rows are as near as its k * sample / rows nearest in the sample.
    """
    extended = np.column_stack([sample, np.sqrt(np.maximum(largest**2 - (sample**2).sum(axis=1), 0))])
    piece = min(MOST_PIECE, max(LEAST_PIECE, int(rows).bit_length()))
    parts = [learn_rotation(extended, seed) for seed in range(-(-TABLES * piece // extended.shape[1]))]
    coder = Coder(np.column_stack(parts)[:, : TABLES * piece], largest, piece)
    n = min(CALIBRATION_QUERIES, len(sample))
    if len(sample) < 2:
        return coder
    scores = sample[:n] @ sample.T
    scores[np.arange(n), np.arange(n)] = -np.inf
    near = max(1, min(len(sample) - 1, round(k * len(sample) / max(rows, 1))))
    at = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    apart = np.bitwise_count(coder.pieces(sample[:n], True)[:, None] ^ coder.pieces(sample, False)[at])
    flips = int(np.quantile(apart.min(axis=2), RECALL, method="higher"))
    bits = apart.sum(axis=2, dtype=np.int32)
    radius = int(np.quantile(bits, QUANTILE)) + 1
    return Coder(coder.rotation, largest, piece, flips, radius, bool((bits.max(axis=1) <= settled_bits(1)).any()))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that take part, components in double precision."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary rows as a matrix, of doubles or of unsigned 32-bit substrings."""
    found = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
    return found.astype(np.uint32 if "u" in kind else float)


def _coded(df: DataFrame, coder: Coder, name: str, query: bool, kind: str) -> DataFrame:
    """(name, v, code): vector and substrings of each row as bytes, vectors as numbers of ``kind``."""
    shared = df.sparkSession.sparkContext.broadcast(coder)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
                codes = shared.value.pieces(v, query).astype(shared.value.kind)
                yield pa.RecordBatch.from_arrays([batch.column(name), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (v.astype(kind), codes))], [name, "v", "code"])

    return df.select(name, "v").mapInArrow(run, f"{name} long, v binary, code binary")


def _dealt(coded: DataFrame, coder: Coder, flips: int | None) -> DataFrame:
    """coded with table and lead: the range that an entry stands in (flips None), or the ranges that a query probes."""
    lead, shift, kind, names = coder.lead, coder.piece - coder.lead, coder.kind, coded.columns
    masks = flips_of(lead, 0 if flips is None else flips)
    each = TABLES * len(masks)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, (1 << 16) // each)):
                some = batch.slice(at, max(1, (1 << 16) // each))
                own = _matrix(some.column("code"), kind) >> np.uint32(shift)
                leads = (own[:, :, None] ^ masks).reshape(-1).astype(np.int32)
                index = pa.array(np.repeat(np.arange(some.num_rows), each))
                tables = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), len(masks)), some.num_rows)
                yield pa.RecordBatch.from_arrays([*(c.take(index) for c in some.columns), pa.array(tables), pa.array(leads)], [*names, "table", "lead"])

    return coded.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema) + ", table int, lead int")


@dataclass
class Found:
    """Scored pairs of one range, collected block by block; ``scored`` counts them all."""

    k: int
    rows: list[tuple] = field(default_factory=list)

    def add(self, q: np.ndarray, x: np.ndarray, bits: np.ndarray, score: np.ndarray) -> None:
        """Keep the k best of each query; all pairs of a query must come at once."""
        order = np.lexsort((x, -score, q))
        q, x, bits, score = q[order], x[order], bits[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.rows.append((q[keep], x[keep], bits[keep], score[keep]))

    def table(self) -> pa.Table:
        parts = [np.concatenate(p) for p in zip(*self.rows, strict=True)] if self.rows else [np.zeros(0)] * 4
        kinds = (np.int64, np.int64, np.int32, np.float64)
        return pa.table({n: p.astype(t) for n, p, t in zip(("q", "x", "bits", "score"), parts, kinds, strict=True)})


def candidates(own: np.ndarray, theirs: np.ndarray, inner: int, lead: int, flips: int, piece: int):
    """(query, entry) indexes, block by block of queries, of substrings within ``flips`` bits.

    own: the queries' substrings; theirs: the sorted substrings of a range, which share the leading bits
    ``lead``. Values are enumerated and looked up, unless they outnumber the entries, which are then compared.
    """
    low = theirs & np.uint32((1 << inner) - 1)
    listed = sum(comb(piece, n) for n in range(min(flips, piece) + 1)) <= len(theirs)
    masks = flips_of(piece, flips) if listed else None
    starts = np.searchsorted(low, np.arange((1 << inner) + 1)) if listed else None
    step = max(1, _PAIRS // max(len(masks) if listed else len(theirs), 1))
    for at in range(0, len(own), step):
        some = own[at : at + step]
        if not listed:
            q, x = np.nonzero(np.bitwise_count(some[:, None] ^ theirs) <= flips)
            yield q + at, x
            continue
        probes = some[:, None] ^ masks
        q, m = np.nonzero(probes >> np.uint32(inner) == np.uint32(lead))
        value = probes[q, m] & np.uint32((1 << inner) - 1)
        first, many = starts[value], starts[value + 1] - starts[value]
        q, first, many = (z[many > 0] for z in (q, first, many))
        ends = np.cumsum(many)
        yield np.repeat(q, many) + at, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - first, many)


def to_score(own: np.ndarray, theirs: np.ndarray, table: int, lead: int, coder: Coder, flips: int):
    """(query, entry, bits), block by block of queries: what a range of a table retrieves within the radius.

    own, theirs: codes (rows of substrings), the entries' sorted by the table's substring. A pair comes
    from the first table that retrieves it.
    """
    for i, j in candidates(own[:, table], theirs[:, table], coder.piece - coder.lead, lead, flips, coder.piece):
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for at in range(0, len(i), _PAIRS // 8):
            a, b = i[at : at + _PAIRS // 8], j[at : at + _PAIRS // 8]
            apart = np.bitwise_count(own[a] ^ theirs[b])
            bits = apart.sum(axis=1, dtype=np.int32)
            keep = np.flatnonzero((bits <= coder.radius) & ((apart <= flips).argmax(axis=1) == table))
            parts.append((a[keep], b[keep], bits[keep]))
        yield tuple(np.concatenate(z) for z in zip(*parts, strict=True))


def probed(queries: DataFrame, entries: DataFrame, coder: Coder, flips: int, k: int, kind: str) -> DataFrame:
    """(q, x, bits, score): of what the tables retrieve within ``flips`` bits and the radius, the k best of each query and range.

    queries: (q, v, code); entries: (x, v, code).
    """
    right = _dealt(entries, coder, None)
    sizes = _dealt(entries.select("code"), coder, None).groupBy("table", "lead").count().select("table", "lead", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    sizes = small(checkpointed(sizes), BROADCAST_ROWS)
    right = right.join(sizes, ["table", "lead"]).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).drop("parts")
    left = _dealt(queries, coder, flips).join(sizes, ["table", "lead"])
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        found = Found(k)
        if q.num_rows and x.num_rows:
            table, lead = q.column("table")[0].as_py(), q.column("lead")[0].as_py()
            qc, xc = (_matrix(d.column("code").combine_chunks(), coder.kind) for d in (q, x))
            qv, xv = (_matrix(d.column("v").combine_chunks(), kind) for d in (q, x))
            order = np.argsort(xc[:, table], kind="stable")
            asked, names = q.column("q").to_numpy(), x.column("x").to_numpy()[order]
            for a, b, bits in to_score(qc, xc[order], table, lead, coder, flips):
                score = [(qv[a[at : at + _PAIRS // 8]] * xv[order[b[at : at + _PAIRS // 8]]]).sum(axis=1) for at in range(0, len(a), _PAIRS // 8)]
                found.add(asked[a], names[b], bits, np.concatenate([np.zeros(0), *score]))
        return found.table()

    return left.groupBy("table", "lead", "part").cogroup(right.groupBy("table", "lead", "part")).applyInArrow(run, "q long, x long, bits int, score double")


def scanned(queries: DataFrame, entries: DataFrame, n_entries: int, k: int, kind: str) -> DataFrame:
    """(q, x, score): the k best of all entries, block by block, for the queries that probing left short."""
    blocks = max(1, -(-n_entries // BLOCK))
    left = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = entries.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        found = Found(k)
        if q.num_rows and x.num_rows:
            qv, xv = (_matrix(d.column("v").combine_chunks(), kind) for d in (q, x))
            for at, name in enumerate(q.column("q").to_pylist()):
                score = (xv * qv[at]).sum(axis=1)
                found.add(np.full(len(xv), name), x.column("x").to_numpy(), np.zeros(len(xv), np.int32), score)
        return found.table().drop_columns("bits")

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, "q long, x long, score double")


def _best(rows: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    window = Window.partitionBy(by).orderBy(F.col("score").desc(), tie)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query row.

    ``is_query`` is a condition on column ``id``. Candidates are all rows that take part but those with
    the query's own id; ties go to smaller ids. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do those of another length than most (the shortest of equally
    frequent lengths counts). No usable row: an empty result.
    """
    rows = _usable(vectors, id_col, vector_col)
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (lengths["n"] if lengths else -1))
    groups = checkpointed(rows.groupBy("v").agg(F.min("id").alias("x"), F.count("*").alias("rows")))
    square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    n_entries, largest = groups.agg(F.count("*"), F.max(F.sqrt(square))).first()
    sample = groups.where(F.pmod(F.xxhash64("x"), F.lit(max(n_entries, 1))) < SAMPLE_ROWS).select("x", "v").orderBy("x").toPandas()
    sample = np.stack(sample["v"].to_numpy()) if len(sample) else np.ones((1, max(lengths["n"] if lengths else 1, 1)))
    coder = fit(sample, largest or 1.0, n_entries, k)

    members = checkpointed(rows.join(groups.select("v", "x"), "v").select("x", "id"))
    asked = members.where(is_query)
    entries = checkpointed(_coded(groups, coder, "x", False, kind))
    wanted = groups.join(asked.select("x").distinct(), "x", "left_semi").select(F.col("x").alias("q"), "v")
    queries = checkpointed(_coded(wanted, coder, "q", True, kind))

    # An entry of a query's own copies is one of its answers, so k + 1 entries, and k + 1 rows of each, are enough.
    left, found = queries, None
    if coder.close and coder.flips > 1:
        near = checkpointed(probed(queries, entries, coder, 1, k + 1, kind))
        safe = F.col("bits") <= settled_bits(1)
        sure = near.where(safe).join(groups.select("x", "rows"), "x").groupBy("q").agg(F.sum("rows").alias("n")).where(F.col("n") > k).select("q")
        left, found = checkpointed(queries.join(sure, "q", "left_anti")), near.join(sure, "q", "left_semi")
    last = probed(left, entries, coder, coder.flips, k + 1, kind)
    found = last if found is None else found.union(last)
    found = checkpointed(_best(found, "q", k + 1, "x").select("q", "x", "score"))
    enough = found.join(groups.select("x", "rows"), "x").groupBy("q").agg(F.sum("rows").alias("n")).where(F.col("n") > k).select("q")
    short = checkpointed(queries.join(enough, "q", "left_anti"))
    rest = _best(scanned(short.select("q", "v"), entries.select("x", "v"), n_entries, k + 1, kind), "q", k + 1, "x").select("q", "x", "score")
    found = found.join(enough, "q", "left_semi").union(rest)

    smallest = members.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("n") <= k + 1).select("x", "id")
    found = _best(found.join(smallest, "x"), "q", k + 1, "id").select("q", "id", "score")
    own = asked.select(F.col("x").alias("q"), F.col("id").alias("query_id"))
    answers = _best(own.join(found, "q").where(F.col("id") != F.col("query_id")), "query_id", k, "id")
    return answers.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
