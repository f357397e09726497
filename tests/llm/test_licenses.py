import random
import re
import time

import numpy as np
from siltstone.llm import licenses
from siltstone.llm.license_texts import TELLING, TEMPLATES


def scan(documents, texts):
    return {r["doc_id"]: r for r in licenses.scan(documents(texts)).collect()}


def test_every_template_is_found_in_place(documents):
    rng = random.Random(1)
    names = sorted(TEMPLATES)
    before = ["é " * rng.randint(0, 30) + "lorem ipsum dolor\n" for _ in names]
    got = scan(documents, [b + TEMPLATES[n] + "\nsit amet" for b, n in zip(before, names, strict=True)])
    for k, name in enumerate(names):
        assert name in got[k]["licenses"].split(","), name
        start, end = (int(x) for s in got[k]["spans"].split(",") if s.startswith(f"{name}:") for x in s.split(":")[1:3])
        text = TEMPLATES[name]
        assert (start, end) == (len(before[k]) + len(text) - len(text.lstrip()), len(before[k]) + len(text.rstrip('.,;:"/>)!\n ')))


def test_changed_words_and_other_layout(documents):
    words = TEMPLATES["mit"].split()
    for k in range(7, len(words), 12):
        words[k] = "changed"
    del words[20:23]
    got = scan(documents, ["# " + "\n# ".join(" ".join(words[k : k + 9]).upper() for k in range(0, len(words), 9))])
    assert got[0]["licenses"] == "mit" and 0.8 <= got[0]["coverage"] < 1


def test_clean_and_odd_texts(documents):
    texts = [None, "", "the license plate of a car was released", "permission is hereby granted", "free of charge " * 3000, "MIT License"]
    got = scan(documents, texts)
    assert [got[k]["n_matches"] for k in range(len(texts))] == [0] * len(texts)
    assert scan(documents, []) == {}


def test_two_licences_in_one_text(documents):
    got = scan(documents, [TEMPLATES["mit-line"] + " x " + TEMPLATES["gpl-3.0-line"] + " y " + TEMPLATES["mit-line"]])
    assert (got[0]["n_matches"], got[0]["licenses"]) == (3, "gpl-3.0-line,mit-line")


#: Templates that a full table of scores can be made for in a test.
SMALL = sorted(n for n in TEMPLATES if len(TEMPLATES[n].split()) < 400)


def test_bands_against_single_cells():
    """The banded alignment of several texts at once, and the full table where the band holds all of it."""
    rng = np.random.default_rng(6)
    for size, band in ((5, 6), (12, 6), (30, 31)):
        template = rng.integers(1, 8, size).astype(np.uint64)
        windows = rng.integers(1, 8, (40, size + 2 * band)).astype(np.uint64)
        windows[::3, band : band + size] = template
        windows[::6, band + size // 2] = 0
        for got, window in zip(licenses.align(template, windows, band).tolist(), windows.tolist(), strict=True):
            assert got == banded(template.tolist(), window, band)
        if band > size:
            short = windows[:, band - 3 : band + size + 3]  # the rest is none of the template's words: the band has all that matters
            padded = np.zeros_like(windows)
            padded[:, band - 3 : band + size + 3] = short
            assert [m for m, *_ in licenses.align(template, padded, band).tolist()] == [best_local(template.tolist(), w) for w in short.tolist()]


def banded(template, window, band):
    """[matches, first, end], cell by cell: score, then matched words, then the later first word."""
    before, best = {}, (0, 0, 0, 0)
    for i, word in enumerate(template):
        row = {}
        for x in range(i, i + 2 * band + 1):
            s, m, f = before.get(x - 1, (0, 0, 0))
            options = [((s + 2, m + 1, f) if s else (2, 1, x)) if window[x] == word else (s - 1, m, f)]
            options += [(o[0] - 1, *o[1:]) for o in (row.get(x - 1), before.get(x)) if o]
            if max(options)[0] > 0:
                row[x] = max(options)
                if row[x][:2] > best[:2] or (row[x][:2] == best[:2] and best[3] == -i and row[x][2] > best[2]):
                    best = (*row[x], -i)
                    end = x + 1
        before = row
    return [best[1], best[2], end] if best[0] else [0, 0, 0]


def test_whole_licences_and_their_neighbours(documents):
    """Files of the long licences: with another beginning, without their appendix, with changed words."""
    long = sorted(set(TEMPLATES) - set(SMALL))
    texts = ["Copyright (c) 2020 Somebody\n\n" + TEMPLATES[n] for n in long]
    texts += [" ".join(w if k % 13 != 12 else "changed" for k, w in enumerate(TEMPLATES[n].split())) for n in long]
    texts += [TEMPLATES["apache-2.0"][: TEMPLATES["apache-2.0"].index("APPENDIX")], TEMPLATES["gpl-3.0"][: TEMPLATES["gpl-3.0"].index("END OF TERMS")]]
    texts.append(TEMPLATES["gpl-3.0"].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE"))
    got = scan(documents, texts)
    for k, name in enumerate([*long, *long, "apache-2.0", "gpl-3.0"]):
        assert name in got[k]["licenses"].split(",") and got[k]["coverage"] > 0.8, (k, name, got[k]["licenses"])
    assert "gpl-3.0" not in got[len(texts) - 1]["licenses"].split(",") and "gpl-3.0:" in got[len(texts) - 1]["parts"]


def test_time_of_a_licence():
    """Texts with a licence, each changed in its own way, so that every one is aligned."""
    rng = random.Random(8)
    texts = []
    for k in range(60):
        words = TEMPLATES["mit"].split()
        words[rng.randrange(40, len(words))] = f"word{k}"
        texts.append(f"Copyright (c) {k} Somebody. " + " ".join(words) + "\nsome code\n" * 20)
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    indexes = licenses.build(TEMPLATES)
    begun = time.perf_counter()
    got = licenses.matches(indexes, np.frombuffer(data, np.uint8), offsets)
    assert (time.perf_counter() - begun) / len(texts) < 0.005
    assert all([x[0] for x in got[k] if x[4]] == ["mit"] for k in range(len(texts)))


def best_local(template, text):
    """(matched words, end) of the best local alignment, by the full table of Smith and Waterman."""
    score, hits, best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)], [[0] * (len(text) + 1) for _ in range(len(template) + 1)], (0, 0)
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            hit = template[i - 1] == text[j - 1]
            s, m = max((score[i - 1][j - 1] + (licenses.MATCH if hit else licenses.MISMATCH), hits[i - 1][j - 1] + hit), (score[i][j - 1] + licenses.GAP, hits[i][j - 1]), (score[i - 1][j] + licenses.GAP, hits[i - 1][j]))
            score[i][j], hits[i][j] = (s, m) if s > 0 else (0, 0)
            best = max(best, (score[i][j], hits[i][j]))
    return best[1]


def split(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def shares_a_run(text, name):
    """Whether a text has as many words of a template in a row as make it a candidate for certain."""
    w, t = split(text), split(TEMPLATES[name])
    size = sum(licenses.LONG_GRAMS if len(t) >= licenses.LONG else licenses.SHORT_GRAMS) - 1
    runs = {tuple(t[k : k + size]) for k in range(max(1, len(t) - size + 1))}
    return any(tuple(w[k : k + len(next(iter(runs)))]) in runs for k in range(len(w)))


def holds(text, name):
    """Whether a text holds enough of a template, and what tells it from others."""
    w, t = split(text), split(TEMPLATES[name])
    joined = " ".join(w)
    return best_local(t, w) >= 0.8 * len(t) and all(f" {' '.join(split(r))} " in f" {joined} " for r in TELLING.get(name, ()))


def test_against_full_alignment(documents):
    """Every name that is reported is one that full alignment of all templates finds, and the largest such is never missed."""
    rng = random.Random(5)
    texts = []
    for name in SMALL:
        words = TEMPLATES[name].split()
        for share in (0.05, 0.25):
            out = [w if rng.random() > share else rng.choice(["", "word", w + " word"]) for w in words]
            texts.append(" ".join(["lorem"] * rng.randint(0, 5) + out + ["ipsum"] * rng.randint(0, 5)))
    got = scan(documents, texts)
    for k, text in enumerate(texts):
        want = {n for n in SMALL if holds(text, n)}
        found = set(got[k]["licenses"].split(",")) - {""}
        assert found <= want, (text, found, want)
        assert found or not any(shares_a_run(text, n) for n in want), (text, want)


def test_neighbours_keep_their_names(documents):
    texts = [
        TEMPLATES["lgpl-2.1-or-later-header"], TEMPLATES["agpl-3.0-or-later-header"], TEMPLATES["bsd-3-clause"], TEMPLATES["bsd-2-clause"], TEMPLATES["gpl-2.0-line"], TEMPLATES["cc-by-3.0-line"],
        "This work is licensed under a Creative Commons Attribution 2.5 Generic License.", TEMPLATES["gpl-3.0-line"].replace("3", "4"), " ".join(TEMPLATES["mit"].split()[:90]),
    ]
    got = scan(documents, texts)
    assert [got[k]["licenses"] for k in range(6)] == ["lgpl-2.1-or-later-header", "agpl-3.0-or-later-header", "bsd-3-clause", "bsd-2-clause", "gpl-2.0-line", "cc-by-3.0-line"]
    assert [got[k]["n_matches"] for k in (6, 7, 8)] == [0, 0, 0]
    assert got[6]["parts"] and got[7]["parts"] and got[8]["parts"].startswith("mit:0:")
    assert all(not got[k]["parts"] for k in range(6))


def test_very_long_texts_ties_and_ids(spark):
    long = "free of charge " * 200_000 + TEMPLATES["mit"] + " x" * 300_000 + " " + TEMPLATES["mit-line"]
    rows = [(None, long), (3, TEMPLATES["mit-line"]), (3, TEMPLATES["mit-line"]), (None, None)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, spans string, licenses string").repartition(2)
    got = sorted((str(r["doc_id"]), r["licenses"], r["n_matches"]) for r in licenses.scan(docs).collect())
    assert got == [("3", "mit-line", 1), ("3", "mit-line", 1), ("None", "", 0), ("None", "mit,mit-line", 2)]
