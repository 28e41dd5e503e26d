import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def docs_dir(spark, tmp_path):
    """Writes documents (and labels) where a query finds them."""
    from llm_tables import table

    def write(rows, labels=(), clashes=True):
        table(spark, rows, clashes).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write
