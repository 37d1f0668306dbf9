"""Every general query on empty tables: no crash, the same columns."""

import os

import pytest

import __spark_entry__ as E
from paperloom.plans.queries import QUERIES

TABLES = ["candidates", "documents", "download_safety_log", "preprocess_log", "eval_items", "mix_targets", "missing_slots", "events"]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    if not os.path.isdir(E.SMOKE):
        pytest.skip("no test tables")
    d = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{E.SMOKE}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    if name in ("targets", "places_open"):
        assert len(rows) == 36
    elif name == "cell_queries":
        assert len(rows) == 54
    elif name == "saved_count":
        assert [tuple(r) for r in rows] == [(0, 0)]
    elif name == "status_tally":
        assert [r.summary for r in rows] == ["0"]
    else:
        assert rows == []
