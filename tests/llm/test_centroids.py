import hashlib
import math

import numpy as np
import pytest
from siltstone.llm import centroids as C
from siltstone.llm.queries import op11_centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, rounds, dims, scale):
    """The contract in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in order[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    return centres, sorted(((i, *reversed(place(v))) for i, v in kept), key=key)


def key(r):
    return (r[0] is None, r)


@pytest.mark.parametrize("magnitude", [1, 3e4, 1e7])
def test_against_integers(spark, magnitude):
    """With small values all rows go through the matrix product, with the largest ones most go through integers."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) * magnitude * 10.0 ** rng.integers(-3, 1, size=(300, 1))
    rows = list(enumerate(x.tolist()))
    df = frame(spark, rows)
    found = C.fit(df, 4, 6, 3, 6, 16)
    centres, want = brute(rows, 4, 6, 6, 16)
    assert [list(c) for c in found.centroids] == centres
    assert sorted(map(tuple, C.assigned(df, found, 6, 16).collect())) == want
    assert sum(found.sizes) == len(rows) and sum(found.inertia) == sum(d for *_, d in want)


def test_blocks_of_mixed_magnitude_agree_with_integers():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(200, 8)) * 10.0 ** rng.integers(0, 12, size=(200, 1)))
    centres = tuple(tuple(int(v) for v in row) for row in x[:5])
    who, far = C.nearest(x, centres)
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)), n) for n, c in enumerate(centres)) for row in x.tolist()]
    assert [(int(d), int(n)) for d, n in zip(far, who, strict=True)] == want
    sums = C.added(x, who, far, 5)
    for n in range(5):
        own = [[int(v) for v in row] for row, w in zip(x.tolist(), who, strict=True) if w == n]
        assert sums[n][:8] == [sum(c) for c in zip(*own, strict=True)] and sums[n][8] == len(own)
    small = np.floor(x / np.abs(x).max(axis=1)[:, None] * 1000)
    who, far = C.nearest(small, centres[:1] + ((0,) * 8, (5,) * 8))
    assert C.added(small, who, np.asarray(far), 3) == C.added(small, who, [int(d) for d in far], 3)


def test_query_unusable_repeats_ties_and_null_ids(spark, folder):
    rng = np.random.default_rng(3)
    same = [0.25] * 64
    rows = [(k, (rng.normal(size=64) / 8).tolist()) for k in range(60)] + [(100 + k, same) for k in range(40)] + [(7, same), (7, same), (None, same)]
    odd = [(201, None), (202, same[:63]), (203, [*same, 0.1]), (204, [None, *same[1:]]), (205, [float("nan"), *same[1:]]), (206, [float("inf"), *same[1:]]), (207, [])]
    got = [tuple(r) for r in op11_centroids(spark, folder(embeddings=frame(spark, rows + odd))).collect()]
    centres, want = brute(rows + odd, 8, 10, 64, 1024)
    assert sorted((r[:3] for r in got), key=key) == sorted(want, key=key)
    total, by = sum(r[2] for r in want), {}
    for _, c, d in want:
        by[c] = by.get(c, 0) + d
    for _, c, _, own, every, digest in got:
        assert (own, every) == (by[c], total) and digest == hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()


def test_fewer_vectors_than_clusters_and_empty(spark, folder):
    few = frame(spark, [(1, [0.5] * 64), (2, [0.5] * 64), (3, [1.0] * 64)])
    found = C.fit(few, 8, 10, 3, 64, 1024)
    assert len(found.centroids) == 3 and sum(found.sizes) == 3 and 0 in found.sizes  # equal ones: the first takes all
    assert op11_centroids(spark, folder(embeddings=frame(spark, []))).collect() == []


def test_too_large_is_an_error(spark):
    df = frame(spark, [(1, [1e300, 0.0]), (2, [0.0, 0.0])])
    with pytest.raises(Exception, match="does not fit 64 bits"):
        C.fit(df, 2, 1, 3, 2, 1024)
