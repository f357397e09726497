import random

import corpus_pipeline
from siltstone.llm import near_copies


def jaccard(a, b, width=5):
    one, two = (({tuple(w[k : k + width]) for k in range(len(w) - width + 1)}) for w in (a, b))
    return len(one & two) / len(one | two)


def copy_of(rng, words, least):
    """Single words replaced for as long as the similarity stays at ``least`` or more."""
    best = list(words)
    for k in rng.sample(range(len(words)), len(words)):
        changed = [*best[:k], f"new{rng.random()}", *best[k + 1 :]]
        if jaccard(words, changed) >= least:
            best = changed
    return best


def test_the_stage_finds_planted_copies(spark, documents):
    rng = random.Random(3)
    texts, planted = [], {}
    for least in (0.8, 0.9, 0.95):
        for _ in range(60):
            words = [f"v{rng.randrange(5000)}" for _ in range(rng.choice((120, 200, 400)))]
            changed = copy_of(rng, words, least)
            assert least <= jaccard(words, changed) < 1
            planted.setdefault(least, []).append(len(texts) + 1)
            texts += [" ".join(words), " ".join(changed)]
    far = [copy_of(rng, text.split(), 0.5) for text in texts[:40:2]]
    assert all(jaccard(a.split(), b) < 0.8 for a, b in zip(texts[:40:2], far, strict=True))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(texts + [" ".join(x) for x in far]), "").collect()}
    found = {least: sum(k not in kept for k in ids) / len(ids) for least, ids in planted.items()}
    assert found[0.8] >= 0.9 and found[0.9] >= 0.95 and found[0.95] == 1, found
    assert set(range(0, len(texts), 2)) | set(range(len(texts), len(texts) + len(far))) <= kept


def test_groups_against_brute_force_with_a_large_group(spark, documents):
    rng = random.Random(4)
    base = [f"u{k}" for k in range(150)]
    texts = [[*base[:k], "x", *base[k + 1 :]] for k in range(0, 150, 3)] + [[f"z{rng.random()}" for _ in range(80)] for _ in range(20)] + [["a", "b"], ["A", "b"], ["a", "c"], [], []]
    docs = documents([" ".join(x) for x in texts])
    rows = near_copies.near_copies(docs, id_col="doc_id").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["group"], set()).add(r["doc_id"])
    assert len(rows) == len(texts)
    assert sorted(map(sorted, groups.values())) == [list(range(50)), *([k] for k in range(50, 70)), [70, 71], [72], [73, 74]]


def test_very_long_texts_and_ties(spark, documents):
    """Texts of megabytes, copies of them but for a word or for blanks, and rows that repeat."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(90_000)}" for _ in range(300_000)]
    other = [f"x{rng.randrange(90_000)}" for _ in range(200_000)]
    texts = [" ".join(words), " ".join([*words[:5], "changed", *words[6:]]), "  ".join(words), " ".join(other), "a b c", "a b c", None]
    rows = near_copies.near_copies(documents(texts), id_col="doc_id").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["group"], []).append(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3], [4, 5], [6]]
