import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark, docs_schema):
    """documents from texts, or (doc_id, text) / (doc_id, text, source) rows."""
    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            doc_id, text, source = (*r, "s0")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(full, docs_schema)
    return make
