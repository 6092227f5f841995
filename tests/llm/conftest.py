import pytest
from odd_tables import DOCS, TEXTS


@pytest.fixture
def odd_docs(spark):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "src0", 3), (None, "no id here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
