"""Every text query on empty tables: no crash, no rows."""

import os

import pytest

import __spark_entry__ as E
from paperloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    if not os.path.isdir(E.SMOKE):
        pytest.skip("no test tables")
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("candidates", "documents", "eval_items", "mix_targets"):
        spark.read.parquet(f"{E.SMOKE}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
