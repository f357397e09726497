import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.llm import hamming_search as H

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    out = {}
    for q in (i for i in ok if i % 20 == 0):
        scored = sorted((-float((ok[q] * x).sum()), i) for i, x in ok.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "norms"])
def test_recall_and_scores(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    if kind == "clusters":
        x = x[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 32)) * 0.05
    if kind == "norms":
        x *= rng.uniform(0.2, 3, 1500)[:, None]
    rows = list(enumerate(x.astype(np.float32).tolist()))
    want, got = brute(rows, 20), result(H.search(frame(spark, rows), F.col("id") % 20 == 0, 20))
    assert set(got) == set(want)
    found = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    vectors = dict(rows)
    for q, best in got.items():
        assert [r for r, _, _ in best] == list(range(1, 21))
        assert q not in [i for _, i, _ in best]
        for _, i, s in best:
            assert s == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[i], float))), abs=1e-9)
        assert best == sorted(best, key=lambda b: (-b[2], b[1]))


def test_unusable_vectors_copies_and_ties(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(k, same) for k in range(30)] + [(40, [-1.0, 0.0, 0.5]), (60, None), (80, [0.0, 0.0, 0.0]), (100, [1.0, None, 2.0]), (120, [float("nan"), 1.0, 1.0]), (140, [float("inf"), 1.0, 1.0]), (160, [1.0, 2.0]), (None, same)]
    got = result(H.search(frame(spark, rows), F.col("id") % 20 == 0, 20))
    assert set(got) == {0, 20, 40}
    assert [i for _, i, _ in got[0]] == list(range(1, 21))
    assert [i for _, i, _ in got[20]] == list(range(20))
    assert [i for _, i, _ in got[40]] == list(range(20))


def test_fewer_candidates_than_k_and_empty(spark):
    got = result(H.search(frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])]), F.col("id") % 20 == 0, 20))
    assert got == {0: [(1, 1, 0.5)]}
    assert H.search(frame(spark, [(0, [1.0, 0.0])]), F.col("id") % 20 == 0, 20).count() == 0
    assert H.search(frame(spark, []), F.col("id") % 20 == 0, 20).count() == 0


def coder_of(piece, flips=0, radius=10**6):
    return H.Coder(np.zeros((1, 1)), 1.0, piece, flips, radius)


def retrieved(own, theirs, coder, flips):
    """{(query, entry): bits}, over all tables and ranges; each pair once."""
    found = {}
    for table in range(H.TABLES):
        leads = theirs[:, table] >> np.uint32(coder.piece - coder.lead)
        for lead in np.unique(leads):
            rows = np.flatnonzero(leads == lead)
            rows = rows[np.argsort(theirs[rows, table], kind="stable")]
            for a, b, bits in H.to_score(own, theirs[rows], table, int(lead), coder, flips):
                for q, x, n in zip(a.tolist(), rows[b].tolist(), bits.tolist(), strict=True):
                    assert (q, x) not in found
                    found[q, x] = n
    return found


@pytest.mark.parametrize("piece", [10, 13, 16])
@pytest.mark.parametrize("flips", [0, 1, 3])
def test_probing_retrieves_what_a_substring_is_near_to(piece, flips):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << piece, (60, H.TABLES), dtype=np.uint32)
    noise = (rng.random((60, H.TABLES, piece)) < 0.2) << np.arange(piece)
    theirs = np.concatenate([base ^ noise.sum(axis=2).astype(np.uint32), np.tile(base[:1], (3000, 1))])
    got = retrieved(base, theirs, coder_of(piece), flips)
    apart = np.bitwise_count(base[:, None] ^ theirs)
    want = {(int(a), int(b)): int(apart[a, b].sum()) for a, b in zip(*np.nonzero((apart <= flips).any(axis=2)), strict=True)}
    assert got == want
    sure = apart.sum(axis=2) < H.TABLES * (flips + 1)  # the pigeonhole rule
    assert all((int(a), int(b)) in got for a, b in zip(*np.nonzero(sure), strict=True))


def test_floats_are_scored_for_few_pairs_and_recall_is_that_of_the_tables():
    """On vectors without near neighbours: the tables supply the answers, and few pairs are scored."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12_000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    coder = H.fit(x[:8000], 1.0, len(x), 20)
    asked = np.arange(0, len(x), 400)
    found = retrieved(coder.pieces(x[asked], True), coder.pieces(x, False), coder, coder.flips)
    assert len(found) < 0.06 * len(asked) * len(x)
    top = np.argsort(-(x[asked] @ x.T), axis=1)[:, 1:21]
    assert np.mean([(q, int(n)) in found for q, row in enumerate(top) for n in row]) >= 0.9


def test_ranges_are_split_and_short_queries_see_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1, 16)) + rng.normal(size=(300, 16)) * 0.01, rng.normal(size=(60, 16))])
    rows = list(enumerate(x.astype(np.float32).tolist()))
    want = brute(rows, 20)
    monkeypatch.setattr(H, "BLOCK", 50)
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    got = result(H.search(frame(spark, rows), F.col("id") % 20 == 0, 20))
    assert {q: len(v) for q, v in got.items()} == {q: 20 for q in want}
    assert sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
    real = H.fit
    monkeypatch.setattr(H, "fit", lambda *a: H.Coder(real(*a).rotation, real(*a).largest, real(*a).piece, 0, 0))  # probing finds next to nothing
    got = result(H.search(frame(spark, rows), F.col("id") % 20 == 0, 20))
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
