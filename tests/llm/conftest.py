import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(*texts, ids=None, sources=None, extra=()):
        rows = [((ids or range(len(texts)))[k], t, "en", (sources or ["s"] * len(texts))[k], None if t is None else len(t), *(7 for _ in extra)) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS + "".join(f", {c} long" for c in extra))

    return make
