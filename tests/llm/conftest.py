import pytest


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text) with an extra column of a clashing name."""
    return lambda rows: spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ref string")
