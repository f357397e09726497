import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.llm import sliced_topk as S
from siltstone.llm.queries import op13_sliced_topk

SCHEMA = "vec_id long, embedding array<double>, block string, id int, chunk int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "b", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, scale, k, every=50):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in {r for r in kept if r[0] % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for i, v in kept if i != q and len(v) == len(w))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "most"), [(1, 3), (3, 1), (5, 1000), (17, 2**25), (0, 1)])
def test_scores_of_slices(dims, most):
    rng = np.random.default_rng(dims)
    ids = rng.permutation(150)
    x = rng.integers(-most, most + 1, size=(150, dims))
    if dims:
        x[:, 0] = 7  # a component that is the same everywhere has no slices
    block = S.Block.of(ids, x)
    assert block.ids.tolist() == sorted(ids.tolist())
    for _ in range(20):
        weights = rng.integers(-most, most + 1, size=dims).tolist()
        k, own = int(rng.integers(1, 12)), int(rng.integers(0, 160))
        want = sorted((-sum(int(a) * b for a, b in zip(row, weights, strict=True)), i) for i, row in zip(ids.tolist(), x.tolist(), strict=True) if i != own)
        assert sorted((-s, i) for i, s in S.best(block, own, weights, k)) == want[:k]


def test_ties_at_every_level():
    numbers = [5, 1, 5, 3, 5, 3, 0, 5, 1]
    slices = [np.array([sum((v >> p & 1) << r for r, v in enumerate(numbers))], np.uint64) for p in range(4)]
    for k in range(1, 12):
        want = sorted(range(9), key=lambda r: (-numbers[r], r))[:k]
        assert sorted(S.top(slices, np.array([0b111111111], np.uint64), k)) == sorted(want)


@pytest.mark.parametrize("cells", [1 << 20, 700])
def test_query_against_brute_force(spark, folder, monkeypatch, cells):
    """In one block and in many, with several chunks of queries."""
    monkeypatch.setattr(S, "CELLS", cells)
    monkeypatch.setattr(S, "QUERIES", 3 if cells < 1 << 20 else 1024)
    rng = np.random.default_rng(4)
    same = (rng.normal(size=16) / 4).tolist()
    rows = [(k, (rng.normal(size=16) / 4).astype(np.float32).tolist()) for k in range(400)] + [(1000 + k, same) for k in range(200)] + [(50, same), (50, same), (1000, same)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [None, *same[1:]]), (2150, [float("nan"), *same[1:]]), (2200, [float("inf"), *same[1:]]), (None, same), (2250, [0.5, -0.5]), (2251, [0.25, 4.0]), (2300, []), (2301, [])]
    got = sorted(tuple(r) for r in op13_sliced_topk(spark, folder(embeddings=frame(spark, rows))).collect())
    assert got == brute(rows, 256, 5)


def test_empty_and_few(spark, folder):
    assert S.search(S.build(frame(spark, []), 256), frame(spark, []), F.col("id") % 50 == 0, 256, 5).collect() == []
    few = frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])])
    assert [tuple(r) for r in S.search(S.build(few, 256), few, F.col("id") % 50 == 0, 256, 5).collect()] == [(0, 1, 1, 256 * 256 * 3)]


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit 62 bits"):
        S.build(frame(spark, [(1, [1e300])]), 256)
