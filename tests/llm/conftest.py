from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names operators use inside."""

    def build(rows, partitions=3):
        full = [(k, t, "en", "src", None, "x", 7) for k, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, tags string, h int"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return build
