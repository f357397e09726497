import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(texts): rows numbered from 0, in several partitions; clashing column names included."""

    def make(texts, langs=None):
        rows = [(k, t, (langs or {}).get(k, "en"), f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")

    return make


@pytest.fixture
def folder(tmp_path):
    """folder(name=DataFrame, ...): a data folder with these tables."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
