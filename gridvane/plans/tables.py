"""Tables in the folder that driver and executors share, which end a plan's lineage."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths that written() made within the innermost scratch(), if there is one.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local master and an error for a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and (conf := sc.getConf().get("spark.checkpoint.dir")):
        sc.setCheckpointDir(conf)
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridvane-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, by the denser of Parquet's codecs, and read again."""
    path = _write(df)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written; the tables that it needed on the way are deleted."""
    with scratch(spark):
        df = make()
        path = _write(df)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what written() makes within, at the end; for steps whose results are elsewhere by then.

    A DataFrame that is built within and not yet written or collected must not leave it.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
