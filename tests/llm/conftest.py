import pytest

from pagewell.llm.common import written


@pytest.fixture
def frame(spark):
    """Rows of documents as a table with the columns of ``documents`` and an odd one."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, copy int, row int"):
        width = len(schema.split(","))
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return written(spark.createDataFrame(full, schema).repartition(3), "test")

    return make
