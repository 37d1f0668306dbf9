"""Session helpers: a tuned local session, and tables in the folder the cluster shares."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The tables made so far by the operators that are running, one list for each.
_made: list[list[tuple[SparkSession, str]]] = []


def local_session(app: str = "paperloom", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session; where that is unset, a temporary one on a single machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile deletes its shuffle files at its end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage with a table that outlives any executor, and unlike
    an RDD checkpoint it is columnar and compressed, so later steps read only
    the columns they need.  Rows and columns are those of ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex[:12]}"
    if _made:
        _made[-1].append((spark, path))
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialise` once nothing reads them."""
    for f in _folders(df):
        _delete(df.sparkSession, f)


def tidy(operator: Callable) -> Callable:
    """An operator whose intermediate tables are deleted when it returns, but for those that its results read."""

    @functools.wraps(operator)
    def run(*args, **kwargs):
        _made.append([])
        try:
            out = operator(*args, **kwargs)
        finally:
            made = _made.pop()
        if made:
            results = [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
            names = {f.rsplit("/", 1)[1] for x in results for f in _folders(x)}
            for spark, path in made:
                if path.rsplit("/", 1)[1] not in names:
                    _delete(spark, path)
                elif _made:
                    _made[-1].append((spark, path))
        return out

    return run
