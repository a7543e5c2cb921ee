import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with columns of clashing names."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            names = "bucket size start run own keys key kept n_shingles score quality_score _parts _copy text_hash".split()
            df = df.selectExpr("*", *(f"'x' as `{n}`" for n in names))
        return df

    return make
