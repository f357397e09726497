import hashlib
import re

import pytest
from pyspark.sql import functions as F
from siltstone.llm import fill_middle as M
from siltstone.llm.queries import op12_fill_middle

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
TEXTS = [
    None, "", "a", "   ", "abc def", "a<P>b c d", "x <S> y", "z<M>", "<P", "S> <", "naïve Straße 東京 tower 😀😀 end", "\n\r\n\tx y\x00z", "ééé", "é", "é combining", "<<S <S<M P>>",
    *(f"word{k} and, some more{'!' * k} ünï{'漢' * k} <S{'>' * 0} tail" for k in range(60)), "tie text", "tie text",
]


def brute(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_single_units(spark, documents):
    docs = documents(TEXTS)
    got = {r["doc_id"]: tuple(r)[1:] for r in M.transformed(docs, 1).collect()}
    assert got == {k: brute(k, t) for k, t in enumerate(TEXTS)}
    assert {f for _, f, *_ in got.values()} == {"plain", "psm", "spm"}


def test_restored_exactly(spark, documents):
    out = M.transformed(documents(TEXTS), 1)
    back = {r["doc_id"]: r["t"] for r in out.select("doc_id", M.restored(F.col("output"), F.col("form")).alias("t")).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}


@pytest.mark.parametrize("text", ["", "ab", "é", "aé東😀b", "  ab  c", "東京a東京"])
def test_every_cut(text):
    tokens = TOKEN.findall(text)
    runs = M.Runs.of(text.encode())
    assert runs.units == len(tokens)
    for u in range(len(tokens) + 1):
        before = "".join(tokens[:u])
        assert runs.cut(u) == (len(before.encode()), len(before))


def test_query_null_ids_long_texts_repeats_and_clashing_columns(spark, folder):
    long = ("word, 東 " * 700_000)[:3_000_000]
    rows = [(1, "a b c", "x", 0), (1, "a b c", "y", 1), (None, "no id", "z", 2), (2, long, "l", 3), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output int").withColumns({"n": F.lit("n"), "__id": F.lit(1), "__h1": F.lit(2)})
    got = [tuple(r) for r in op12_fill_middle(spark, folder(documents=docs)).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        n, form, a, b, out = brute(i, t)
        want.append((i, n, form, a, b, sha(out), sha(t or "")))
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)



def test_empty_table(spark, documents):
    assert M.transformed(documents([]), 1).count() == 0
