"""Centroid clustering of whole-number vectors, exact to the last unit.

Components become integers, floor(scale * x). Squared distances of a block of vectors to all centroids are one
matrix product, |x|^2 - 2 x.c + |c|^2 in float64. That is exact while every term and partial sum is a whole
number below 2^53, which a bound on magnitudes ensures row by row; rows beyond it are computed in Python's integers.
Each task adds up its vectors by cluster, and ``treeAggregate`` combines the sums, so that the driver gets a few of
k * (dims + 2) numbers, whatever the input's size. Every round reads the vectors' table anew: nothing is kept in
executors, and a task that is lost is just run again. Centroids (k of them) travel in the tasks' closures.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix product. With so many, sums by cluster of safe rows are below 2^53 too.
BLOCK = 4096
#: What whole numbers a float64 holds one by one.
EXACT = 2**53
Centroid = tuple[int, ...]


@dataclass(frozen=True)
class Clustering:
    """centroids by number; sizes and inertia (squared distances added up) of the vectors assigned to each."""

    centroids: tuple[Centroid, ...]
    sizes: tuple[int, ...]
    inertia: tuple[int, ...]

    def digest(self, cluster: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[cluster])).encode()).hexdigest()


def usable(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integers (as float64) of the vectors of ``dims`` components that are all finite."""
    length = pc.equal(pc.list_value_length(batch.column("__vector")), dims).fill_null(False)
    kept = batch.filter(length)
    values = kept.column("__vector").flatten().cast(pa.float64())
    x = values.to_numpy(zero_copy_only=False).reshape(kept.num_rows, dims)  # nulls become NaN
    finite = np.isfinite(x).all(axis=1)
    whole = np.floor(x[finite] * scale)
    if whole.size and not np.abs(whole).max() < 2.0**63:
        raise OverflowError("a component times the scale does not fit 64 bits")
    return kept.column("__id").filter(pa.array(finite)), whole


def nearest(x: np.ndarray, centroids: tuple[Centroid, ...]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """The nearest centroid (of equal ones the first) and the squared distance of each row of a block."""
    dims = x.shape[1]
    greatest = max((abs(v) for c in centroids for v in c), default=0)
    room = isqrt((EXACT - 1) // max(dims, 1)) - greatest  # dims * (|x| + |c|)^2 stays below EXACT
    safe = np.abs(x).max(axis=1, initial=0) <= room
    if safe.all():
        c = np.array(centroids, np.float64).reshape(len(centroids), dims)
        apart = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        who = apart.argmin(axis=1)
        return who, apart[np.arange(len(x)), who].astype(np.int64)
    who, far = np.zeros(len(x), np.int64), [0] * len(x)
    if safe.any():
        at = np.flatnonzero(safe)
        who[at], near = nearest(x[at], centroids)
        for k, d in zip(at.tolist(), near.tolist(), strict=True):
            far[k] = d
    for k in np.flatnonzero(~safe).tolist():
        row = [int(v) for v in x[k].tolist()]
        far[k], who[k] = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), i) for i, c in enumerate(centroids))
    return who, far


def added(x: np.ndarray, who: np.ndarray, far: list[int] | np.ndarray, k: int) -> list[list[int]]:
    """A row for each cluster: sums of components, the number of vectors, the sum of distances."""
    dims = x.shape[1]
    if isinstance(far, np.ndarray):
        parts = np.column_stack([x, np.ones(len(x)), far >> 32, far & 0xFFFFFFFF])
        sums = (np.eye(k)[:, who] @ parts).astype(np.int64).tolist()
        return [[*s[: dims + 1], (s[-2] << 32) + s[-1]] for s in sums]
    out = [[0] * (dims + 2) for _ in range(k)]
    for row, c, d in zip(x.tolist(), who.tolist(), far, strict=True):
        out[c] = [a + b for a, b in zip(out[c], [*map(int, row), 1, d], strict=True)]
    return out


def combined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[p + q for p, q in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]


def _source(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__vector")).where(F.size("__vector") == dims)


def _sums(rows: DataFrame, centroids: tuple[Centroid, ...], dims: int, scale: int, depth: int) -> list[list[int]]:
    k = len(centroids)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dims + 2) for _ in range(k)]
        for batch in batches:
            _, x = usable(batch, dims, scale)
            for at in range(0, len(x), BLOCK):
                block = x[at : at + BLOCK]
                total = combined(total, added(block, *nearest(block, centroids), k))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(total)])], ["sums"])

    nothing = [[0] * (dims + 2) for _ in range(k)]
    parts = rows.mapInArrow(part, "sums string").rdd.map(lambda r: json.loads(r[0]))
    return parts.treeAggregate(nothing, combined, combined, depth)


def starts(vectors: DataFrame, k: int, seed: int, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[Centroid, ...]:
    """The k vectors of smallest sha256("seed:id"), in its order (a null id is empty text; equal ids: by their components)."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, dims, scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dims, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), lists], ["id", "x"])

    rows = _source(vectors, dims, id_col, vector_col).mapInArrow(kept, "id string, x array<double>")
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256).alias("hash"), "x")
    return tuple(tuple(map(int, r["x"])) for r in hashed.orderBy("hash", "x").limit(k).collect())


def fit(vectors: DataFrame, k: int, rounds: int, seed: int, dims: int, scale: int, depth: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """k-means in integers: vectors go to the nearest centroid (ties: smaller number), centroids become floors of means.

    Vectors of another number of components, and such as are null or hold null or non-finite components, take
    no part; rows that repeat count as often as they are there. Empty centroids stay where they are. Fewer
    vectors than k give fewer clusters, none gives none. Rounds end when no centroid moves, as the rest would
    change nothing. A component beyond 64 bits is an error. Other columns are not read. depth: of the tree.
    """
    rows = _source(vectors, dims, id_col, vector_col)
    centroids = starts(vectors, k, seed, dims, scale, id_col, vector_col)
    if not centroids:
        return Clustering((), (), ())
    sums = _sums(rows, centroids, dims, scale, depth)
    for _ in range(rounds):
        after = tuple(tuple(v // s[dims] for v in s[:dims]) if s[dims] else c for s, c in zip(sums, centroids, strict=True))
        if after == centroids:
            break
        centroids, sums = after, _sums(rows, after, dims, scale, depth)
    return Clustering(centroids, tuple(s[dims] for s in sums), tuple(s[dims + 1] for s in sums))


def assigned(vectors: DataFrame, found: Clustering, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance) of every vector that takes part; a squared distance beyond 64 bits is an error."""
    kind = vectors.schema[id_col].dataType.simpleString()
    centroids = found.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, dims, scale)
            for at in range(0, len(x), BLOCK):
                who, far = nearest(x[at : at + BLOCK], centroids)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(who)), pa.array(who, pa.int32()), pa.array(far, pa.int64())], ["__id", "cluster", "distance"])

    out = _source(vectors, dims, id_col, vector_col).mapInArrow(run, f"__id {kind}, cluster int, distance long")
    return out.withColumnRenamed("__id", id_col)
