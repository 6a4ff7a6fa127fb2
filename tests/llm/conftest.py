import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, _x int"


@pytest.fixture
def make_docs(spark):
    """Documents of (doc_id, text[, source[, lang]]), with columns no operator knows."""

    def make(rows):
        full = []
        for r in rows:
            i, text, source, lang = (*r, None, None)[:4]
            full.append((i, text, lang, source, None if text is None else len(text), "r", 1))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def write_table(tmp_path):
    def write(df, name="documents"):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
