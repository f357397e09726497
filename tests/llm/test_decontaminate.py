import hashlib
import random
import re

from siltstone.llm import decontaminate

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(texts, items, window=10):
    out = {}
    for k, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        for item, body in items:
            t = words(body)
            n = min(window, len(t))
            for j in range(len(t) - n + 1 if t else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == t[j : j + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out[k] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_against_brute_force(spark, documents):
    rng = random.Random(1)
    vocabulary = ["the", "a", "Of", "naïve", "É", "é", "x1", "42", "rare", "word"]
    passage = [f"w{k}" for k in range(30)]
    texts = [None, "", "---", "the", " ".join(passage), " ".join(passage[:9]), "pre " + "-".join(passage[5:20]).upper() + " post", "a a a a a a a a a a a a", "É é x1"]
    texts += [" ".join(rng.choices(vocabulary, k=60)) for _ in range(20)] + [" ".join(passage[10:25] + ["the"] + passage[10:25])] * 3
    items = [(1, " ".join(passage)), (12, "a a a a a a a a a a a"), (3, "É é"), (4, None), (5, ""), (6, " ".join(rng.choices(vocabulary[:3], k=12))), (7, " ".join(passage)), (7, " ".join(passage))]
    df = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(documents(texts), df).collect()}
    assert got == brute(texts, items)


def test_near_matches_and_shuffled_joins(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    passage = [f"w{k}" for k in range(12)]
    changed = passage[:6] + ["other"] + passage[7:]
    df = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    texts = [" ".join(changed), " ".join(passage), "w6 w6 w6"]
    rows = {r["doc_id"]: r for r in decontaminate.report(documents(texts), df).collect()}
    assert [rows[k]["contaminated"] for k in range(2)] == [False, True]
    assert [rows[k]["n_near_items"] for k in range(2)] == [1, 1]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.report(documents(["a b", None]), none).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in rows) == [(0, 2, 0, False), (1, 0, 0, False)]
    assert decontaminate.report(documents([]), none).count() == 0


def near_items(text, items, window=10):
    w, found = words(text), set()
    for item, body in items:
        t = words(body)
        n = min(window, len(t))
        for j in range(len(t) - n + 1):
            for p in range(-n, len(w)):
                found |= {item} if sum(0 <= p + k < len(w) and w[p + k] == t[j + k] for k in range(n)) >= 0.8 * n else set()
    return len(found)


def test_near_matches_against_brute_force(spark, documents):
    rng = random.Random(5)
    passage = [f"w{k}" for k in range(10)]
    change = lambda ws, places: [f"c{rng.randrange(10**6)}" if k in places else x for k, x in enumerate(ws)]
    texts = [["pre", *change(passage, {j, k}), "post"] for j in range(10) for k in range(j, 10)]
    texts += [change(passage, set(rng.sample(range(10), 3))) for _ in range(20)]
    texts += [change([f"m{k}" for k in range(18)], {9}), [f"s{k}" for k in range(4)] + ["x"], [f"m{k}" for k in range(7)], [f"m{k}" for k in range(8)], [], ["w0"], ["one"]]
    texts += [[f"w{k}"] * (k + 2) for k in range(10)]  # so that any term can be rare or common
    items = [(1, " ".join(passage)), (2, " ".join(f"m{k}" for k in range(18))), (3, "s0 s1 s2 s3 s4"), (4, "one"), (5, "zero none nothing never nowhere nil nought nix")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["n_near_items"] for r in decontaminate.report(documents([" ".join(x) for x in texts]), df).collect()}
    assert got == {k: near_items(" ".join(x), items) for k, x in enumerate(texts)}
    assert got[len(texts) - 17] == 1


def test_null_repeated_and_clashing_ids(spark):
    passage = [f"w{k}" for k in range(12)]
    rows = [(None, " ".join(passage)), (5, " ".join(passage[:6])), (5, " ".join(["x"] * 6 + passage[6:])), (5, None), (None, "w1"), (7, " ".join(passage[:10]))]
    docs = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], "id long, text string, own string, n_words int, term_id string").repartition(3)
    items = spark.createDataFrame([(1, " ".join(passage))], "id int, text string")
    got = sorted(((r["id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.report(docs, items, id_col="id", item_col="id").collect()), key=str)
    assert got == sorted([(None, 12, 12, True), (5, 6, 0, False), (5, 12, 0, False), (5, 0, 0, False), (None, 1, 0, False), (7, 10, 10, True)], key=str)


def test_very_long_texts(spark, documents):
    passage = [f"w{k}" for k in range(12)]
    long = ["the", "of", "w3"] * 200_000 + passage + ["and"] * 200_000 + passage[:10]
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id int, text string")
    rows = {r["doc_id"]: r for r in decontaminate.report(documents([" ".join(long), "w3"]), items).collect()}
    assert (rows[0]["n_words"], rows[0]["n_hit"], rows[0]["n_items"]) == (len(long), 22, 1)
    assert (rows[1]["n_words"], rows[1]["n_hit"]) == (1, 0)
