import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark):
    from cases import documents

    return documents(spark).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts(docs):
    """(doc_id, text) of every row."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
