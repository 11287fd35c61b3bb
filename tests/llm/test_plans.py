"""Queries of the text operators over the smallest test tables."""

import os

import pytest

from tamarack.llm.plans import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {"p5_found": ["file_id", "line_start", "routine_name"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
