import os
import time

import pytest
from pyspark.sql import functions as F

from paperloom import session
from paperloom.session import materialise, shared_dir, tidy


def tables(spark):
    d = shared_dir(spark).removeprefix("file://") + "/paperloom"
    return set(os.listdir(d)) if os.path.isdir(d) else set()


def test_tidy_keeps_only_what_results_read(spark):
    df = spark.range(10)

    @tidy
    def inner(x):
        materialise(x, "gone")
        return materialise(x, "kept").union(materialise(x, "kept"))

    @tidy
    def outer(x):
        a = inner(x)
        return materialise(a, "last"), 5

    before = tables(spark)
    out = inner(df)
    assert sorted(n.split("-")[0] for n in tables(spark) - before) == ["kept", "kept"] and out.count() == 20
    before = tables(spark)
    last, five = outer(df)
    assert [n.split("-")[0] for n in tables(spark) - before] == ["last"] and last.count() == 20 and five == 5

    @tidy
    def fails(x):
        materialise(x, "lost")
        raise ValueError

    with pytest.raises(ValueError):
        fails(df)
    assert session._made == []


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_materialise_leaves_no_shuffle_files(spark):
    def files():
        return [f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f]

    before = set(files())
    t = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while set(files()) - before and time.time() < end:  # they are deleted in the background
        time.sleep(0.2)
    assert not set(files()) - before and t.count() == 7  # counting makes files of its own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
