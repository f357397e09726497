import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_near_copies import jaccard


def least_of_groups(texts):
    """By brute force: the smallest index of each group of texts linked at a similarity of 0.8."""
    words, root = [tuple((t or "").lower().split()) for t in texts], list(range(len(texts)))
    alike = lambda a, b: a == b or (min(len(a), len(b)) >= 5 and jaccard(a, b) >= 0.8)
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if alike(words[k], words[j])) for k in range(len(texts))]
    return set(root)


@pytest.fixture
def data(spark, documents, folder):
    passage = " ".join(f"bench{k}" for k in range(14))
    prose = [" ".join(f"{w}{(k * 7 + j * 3) % 50}" for j, w in enumerate(["the", "and", "of", "this", "that", "with"] * 6)) for k in range(12)]
    texts = [*prose, prose[0], prose[3], f"{prose[1]} {passage} {prose[2]}", "12 ... 34", None, "", f"the and token = abcdefgh12345 {prose[5]} and of these words no other text has any more than it has of that"]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    return texts, folder(documents=documents(texts), benchmark=items)


def test_each_stage_takes_effect_on_its_own_input(spark, data):
    texts, sf_dir = data
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}

    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == least_of_groups(texts)

    kept = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, t in enumerate(texts) if "bench0" not in (t or "")}

    kept = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, docs, sf_dir).collect()}
    assert "abcdefgh" not in kept[18]["text"] and kept[18]["n_chars"] == len(kept[18]["text"])
    assert all(kept[k]["text"] == t for k, t in enumerate(texts) if k != 18)


def test_run_is_the_stages_one_after_another(spark, data):
    texts, sf_dir = data
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {k for k in range(len(texts)) if k < 12 or k == 18}
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_null_and_repeated_ids_lose_nothing_else(spark, folder):
    rows = [(None, "the and of this that 1"), (None, "with from have which their 2"), (4, "one two three four five six"), (4, "one two three four five six"), (4, "seven eight nine ten eleven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["text"] for r in kept.collect()) == sorted({t for _, t in rows})


def test_empty_documents(spark, documents, folder):
    sf_dir = folder(documents=documents([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_columns_with_clashing_names_survive_every_stage(spark, data):
    texts, sf_dir = data
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, name in enumerate(("score", "lang_pred", "id", "row", "word", "group", "n", "pos", "item", "starts")):
        docs = docs.withColumn(name, F.lit(f"x{k}"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert {r["score"] for r in kept.select("score").collect()} == {"x0"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(texts)
