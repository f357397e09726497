import random
import re

import numpy as np
import pytest
from siltstone.llm import simhash
from siltstone.llm.components import connected_components
from siltstone.llm.queries import op9_simhash
from xxhash import xxh64_intdigest

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    parts = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(values, distance=4):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(values))]


def test_query_against_brute_force(spark, documents, folder):
    rng = random.Random(2)
    base = [rng.choice(["alpha", "Beta", "γάμμα", "delta x", "eps", "Zeta", "É"]) + str(rng.randint(0, 40)) for _ in range(400)]
    texts = [None, "", "  \t\n", "one", "one  TWO\tthree", "a b c d", "x " * 9000]
    for _ in range(25):
        w = base[:]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "other"
        texts.append(rng.choice([" ", "\n"]).join(w))
    texts += [" ".join(rng.choices(base, k=30)) for _ in range(20)]
    got = {r["doc_id"]: r for r in op9_simhash(spark, folder(documents=documents(texts))).collect()}
    values = [plain_fingerprint(t) for t in texts]
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{v:016x}" for v in values]
    assert [got[k]["component_id"] for k in range(len(texts))] == components(values)


def clustered(seed, size=40):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 6)
    values = sorted({int(b) ^ int(sum(1 << int(i) for i in rng.permutation(64)[: rng.integers(0, 4)])) for b in base for _ in range(size)})
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


@pytest.mark.parametrize(("distance", "segments", "joined"), [(4, 3, 1), (4, 4, 1), (3, 2, 1), (0, 3, 1), (4, 6, 2), (4, 7, 3), (4, 8, 4), (5, 4, 2)])
def test_links_lose_none(spark, distance, segments, joined):
    values, mask = clustered(1), (1 << 64) - 1
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(distinct, distance, simhash.key_set(distance, segments, joined)).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and bin((a ^ b) & mask).count("1") <= distance}


def test_more_fingerprints_take_longer_keys():
    assert [k.mask.bit_count() for k in simhash.keys(4, 200_000)] == [22, 21, 21]
    for n in (10**9, 10**11):
        best = simhash.keys(4, n)
        assert simhash.work(best, n) <= min(simhash.work(simhash.key_set(4, m, t), n) for m, t in ((3, 1), (5, 2), (7, 3), (8, 4)))
        assert min(k.mask.bit_count() for k in best) > 22


@pytest.mark.parametrize("many", [1, 3, 1000])
def test_components_of_clusters_need_no_list_of_all_pairs(spark, many, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0 if many == 3 else 1000)
    values, mask = clustered(7, 60), (1 << 64) - 1
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in simhash.roots(distinct, many=many).collect()}
    want = components([v & mask for v in values])
    groups = {}
    for v, r in zip(values, want, strict=True):
        groups.setdefault(r, []).append(v)
    assert got == {v: min(own) for own in groups.values() for v in own}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {k: 200 for k in (200, 201, 202)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids_repeated_rows_and_empty_table(spark, documents):
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (7, "q w r t z")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert got == [(0, 3), (3, 3), (3, 3), (7, 7)]
    assert simhash.near_duplicates(documents([])).count() == 0
