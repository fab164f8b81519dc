import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of the given (doc_id, text) rows, with the driver's columns and some that clash with the operators' own."""

    def make(rows, **extra):
        names = ["doc_id", "text", "lang", "source", "n_chars", *extra]
        types = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {k} string" for k in extra)
        data = [(i, t, "en", "s", None if t is None else len(t), *extra.values()) for i, t in rows]
        return spark.createDataFrame(data, types).select(*names)

    return make
