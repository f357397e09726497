import zlib

from siltstone.llm import langid
from siltstone.llm.queries import op8_language

WORDS = {"en": "the and of this that with from have which their", "de": "und der die nicht eine werden haben durch über für", "fr": "les des une dans pour être avec cette où même"}


def texts(n):
    out, langs = [], {}
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        words = WORDS[lang].split()
        langs[k] = lang
        out.append(" ".join(words[(k * 7 + j * j) % 10] for j in range(5 + k % 40)).capitalize() + ".")
    return out, langs


def test_held_out_accuracy(spark, documents, folder):
    rows, langs = texts(240)
    rows += [None, "", "12 34 ...", "a", "Und " * 20_000]
    langs |= {240: "en", 241: "en", 242: "en", 243: None, 244: "de"}
    got = {r["doc_id"]: r for r in op8_language(spark, folder(documents=documents(rows, langs))).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    held = [k for k in range(240) if got[k]["held_out"]]
    assert sum(got[k]["lang_pred"] == langs[k] for k in held) >= 0.95 * len(held)
    assert [got[k]["lang_pred"] for k in (240, 241, 242)] == ["und"] * 3
    assert got[244]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn_from(documents):
    model = langid.fit(documents([None, "abc def"], {0: "en", 1: None}))
    assert [r["lang_pred"] for r in langid.predict(documents(["abc def"]), model).collect()] == ["und"]
    assert langid.predict(documents([]), model).count() == 0


def test_score_does_not_depend_on_neighbours(documents):
    rows, langs = texts(60)
    model = langid.fit(documents(rows, langs))
    one = {r["doc_id"]: r["score"] for r in langid.predict(documents(rows), model).collect()}
    two = {r["doc_id"]: r["score"] for k in (3, 17) for r in langid.predict(documents(rows).where(f"doc_id = {k}"), model).collect()}
    assert all(one[k] == two[k] for k in two)


def test_more_languages_than_a_bitmask_word_holds(documents):
    """A language in the second word of the bitmask is learned and told like any other."""
    words = [f"{'abc'[k // 26]}{chr(97 + k % 26)}q" * 2 for k in range(70)]
    rows = [f"{words[k % 70]} " * (4 + k // 70) for k in range(280)]
    docs = documents(rows, {k: f"l{k % 70:02d}" for k in range(280)})
    model = langid.fit(docs)
    assert len(model.languages) == 70 and len(model.slots) == 2
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()} == {k: f"l{k % 70:02d}" for k in range(280)}


def plain_grams(text):
    """Bytes lower-cased A-Z, other ASCII but letters as one blank for a run of it; all grams of 3 and of 4."""
    out = []
    for b in (text or "").encode():
        c = b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
        if not (c == 32 and out and out[-1] == 32):
            out.append(c)
    return [(n, bytes(out[k : k + n])) for n in langid.SIZES for k in range(len(out) - n + 1)]


def plain_slots(gram):
    n, data = gram
    code = n
    for b in data:
        code = (code << 8 | b) & (2**64 - 1)
    return [(code * m & (2**64 - 1)) >> (64 - langid.SLOT_BITS) for m in langid._MULTIPLIERS[: langid.PROBES]]


def brute_model(rows, langs):
    """language: (filter as a set of slots, false-positive rate), by counting documents in plain Python."""
    model = {}
    for lang in sorted({x for x in langs.values() if x}):
        own = [t for k, t in enumerate(rows) if langs.get(k, "en") == lang and t]
        copies = {t: min(2, own.count(t)) for t in own}
        counts = {}
        for t, n in copies.items():
            for g in set(plain_grams(t)):
                counts[g] = counts.get(g, 0) + n
        least = max(2, round(langid.LEAST_SHARE * min(len(own), langid.PER_LANGUAGE)))
        slots = {s for g, n in counts.items() if n >= least for s in plain_slots(g)}
        model[lang] = (slots, (len(slots) / 2**langid.SLOT_BITS) ** langid.PROBES)
    return model


def brute_shares(model, text):
    found = plain_grams(text)
    out = {}
    for lang, (slots, rate) in model.items():
        hits = sum(all(s in slots for s in plain_slots(g)) for g in found)
        out[lang] = min(1, max(0, (hits - rate * len(found)) / max((1 - rate) * len(found), 1e-9)))
    return out


def test_against_brute_force(spark, documents):
    rows, langs = texts(90)
    rows += ["", None, "é", "ab", "THE and; the--und der", "les des une und der die", "the and of", "the and of", "the and of"] + ["  Und\tder\n" * 30]
    docs = documents(rows, langs)
    model, want = langid.fit(docs), brute_model(rows, langs)
    assert list(model.languages) == sorted(want)
    assert [round(float(r), 15) for r in model.rates] == [round(want[n][1], 15) for n in model.languages]
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for k, text in enumerate(rows):
        shares = brute_shares(want, text)
        if not any(c.isalpha() for c in text or ""):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0)
            continue
        best = max(shares.values())
        assert abs(got[k]["score"] - best) < 1e-12
        assert got[k]["lang_pred"] == min(n for n, s in shares.items() if abs(s - best) < 1e-12)


def test_texts_longer_than_a_piece(documents):
    rows, langs = texts(60)
    model, want = langid.fit(documents(rows, langs)), brute_model(rows, langs)
    long = ["the and of this zzq " * 30_000, "und der die! " * 60_000, "a", "the " * 20]
    got = {r["doc_id"]: r for r in langid.predict(documents(long), model).collect()}
    for k, text in enumerate(long):
        shares = brute_shares(want, text)
        assert abs(got[k]["score"] - max(shares.values())) < 1e-9


def test_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(None, "the and of this that"), (None, "und der die nicht"), (4, "the and of"), (4, "the and of"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en" if t and t.startswith("the") else "de", "x", 1.5) for i, t in rows] * 3, "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(docs)
    got = sorted((str(r["doc_id"]), r["__l"], r["score"]) for r in langid.predict(docs, model, keep=("doc_id", "score"), names=("__l", "__s")).collect())
    assert got == sorted([("None", "en", 1.5), ("None", "de", 1.5), ("4", "en", 1.5), ("4", "en", 1.5), ("4", "und", 1.5)] * 3)
    try:
        langid.predict(docs, model, keep=("score",))
        raise AssertionError
    except ValueError as e:
        assert "score" in str(e)
