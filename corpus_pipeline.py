"""A corpus pipeline of five stages, each calling one training-data operator on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents`` (the last one: packed
pieces); ``run`` writes each result as Parquet to the shared folder and rereads it. ``docs`` must be such
a table, one that every scan reads in the same order: rows are told apart by their place in its files, so
repeated or null doc_ids are no problem.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, langid, near_copies, packing, secrets
from siltstone.llm.common import shared_folder, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
#: A text of this many letters or more in which no language explains LEAST_SCORE of the n-grams is rejected.
LEAST_LETTERS, LEAST_SCORE = 20, 0.2


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.monotonically_increasing_id())


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter, and longer ones that are in no learned language."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = langid.fit(docs.where(~held))
    judged = langid.predict(docs, model, keep=tuple(docs.columns), names=("__lang", "__share"))
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    strange = (F.col("__share") < LEAST_SCORE) & (letters >= LEAST_LETTERS)
    return judged.where((F.col("__lang") != langid.UNKNOWN) & ~strange).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest doc_id stays (of equal ids the first row).

    Near copies share 0.8 or more of their five-word shingles; SimHash proposes the pairs.
    """
    rows = _numbered(docs)
    groups = near_copies.near_copies(rows, id_col="__row")
    chosen = rows.select("__row", "doc_id").join(groups, "__row").groupBy("group").agg(F.min(F.struct("doc_id", "__row"))["__row"].alias("__row"))
    return rows.join(chosen, "__row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    rows = _numbered(docs)
    found = decontaminate.matches(rows, table(spark, sf_dir, "benchmark"), id_col="__row")
    hit = found.where(F.size("starts") > 0).select(F.col("id").alias("__row")).distinct()
    return rows.join(hit, "__row", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences of CAPACITY tokens at most."""
    return packing.pack_documents(docs, VOCABULARY, end_id=0, capacity=CAPACITY)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: learned n-gram filters, SimHash components and BPE tokens cannot be expressed there. The tests
#: hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
