import pytest

from vigil.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture
def docs(shipped):
    """Frame of documents from texts, (id, text) or (id, text, lang)."""
    def make(rows, extra=""):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")))
        df = shipped.createDataFrame(full, SCHEMA)
        for name in extra.split():
            df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make
