import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, in several partitions, with columns named like internal ones."""

    def make(rows, parts=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, found string, block int, `odd.name` int"
        full = [(i, t, "en", "s", None if t is None else len(t), 1, "f", 2, 3) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)
