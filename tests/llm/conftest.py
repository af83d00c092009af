from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A function from texts (or pairs of id and text) to a documents table with a clashing extra column."""

    def make(*texts, **columns):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 7, "x") for i, t in rows], DOCS + ", length int, cid string")

    return make
