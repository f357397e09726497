import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from siltstone.llm import suffix_core, suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = {}
    for k, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts():
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, line = prose(700), prose(230)
    out = [None, "", "short", passage[:199], prose(1500), passage, passage[3:], prose(100) + passage[100:450] + prose(90), line * 4, prose(60) + line + prose(40)]
    out += ["a" * 450, "ab" * 300, "x" * 200, "x" * 200, passage[:200] + "é" * 120, prose(20) + "é" * 110 + prose(20)]
    return out + [prose(rng.randint(0, 300)) + passage[200:500] + prose(rng.randint(0, 300)) for _ in range(8)] + [out[4]] * 3


@pytest.mark.parametrize("bucket_kinds", [10**6, 2])
def test_against_brute_force(documents, bucket_kinds):
    rows = suffix_dedup.deduplicated(documents(texts()), bucket_kinds=bucket_kinds).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == brute(texts(), 200)


def test_empty_table_and_repeated_ids(spark, documents):
    assert suffix_dedup.deduplicated(documents([])).count() == 0
    same = spark.createDataFrame([(1, "y" * 100 + "z" * 150), (1, "y" * 100 + "z" * 150), (None, None)], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicated(same).collect()) == [(0, 0), (250, 250), (250, 250)]


def test_multikey_sort():
    rng = np.random.default_rng(2)
    leads = rng.integers(0, 3, (500, 12)).astype(np.uint8)
    leads[::7] = leads[0]
    order, run = suffix_core.multikey_order(leads)
    rows = [bytes(leads[i]) for i in order]
    assert rows == sorted(rows)
    assert [a == b for a, b in zip(run, run[1:])] == [a == b for a, b in zip(rows, rows[1:])]


def test_equal_windows_choose_equal_anchors():
    rng = np.random.default_rng(9)
    window = rng.integers(0, 256, 200).astype(np.uint8)
    places = []
    for _ in range(5):
        data = np.concatenate([rng.integers(0, 256, rng.integers(0, 300)), window, rng.integers(0, 256, 50)]).astype(np.uint8)
        start = len(data) - 250
        a = suffix_core.anchors(data, np.array([0, len(data)]), 200, 40, suffix_core.RollingHash(data))
        k = int(np.flatnonzero((a.first <= start) & (start <= a.last))[0])
        places.append(int(a.place[k]) - start)
    assert len(set(places)) == 1


def test_very_long_texts_beyond_one_piece(spark, documents):
    """Two texts of over 2 MB that share a passage in the middle; the rest repeats nowhere."""
    rng = np.random.default_rng(6)
    prose = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = prose(1000)
    long = [prose(2_300_000) + passage + prose(50_000), prose(100_000) + passage + prose(2_200_000), passage[:300]]
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(documents(long)).collect()}
    assert [(got[k]["n_removed"], got[k]["n_spans"]) for k in range(3)] == [(1000, 1), (1000, 1), (300, 1)]
    assert got[0]["kept_sha256"] == hashlib.sha256(long[0].replace(passage, "").encode()).hexdigest()


def test_many_small_buckets(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicated(documents(texts())).collect()}
    assert got == brute(texts(), 200)
