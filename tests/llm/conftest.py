import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, bucket int, row int, words string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]), with extra columns whose names clash with those that operators use."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "a")), None if r[1] is None else len(r[1]), "x", 1, 2, "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
