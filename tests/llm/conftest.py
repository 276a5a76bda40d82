import pytest

CLASHING = ("node", "path", "rank", "hit_id", "lm_text", "salt")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with the columns of the real table and some whose names operators use themselves."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *CLASHING) for i, t in zip(ids, texts)], schema)

    return make
