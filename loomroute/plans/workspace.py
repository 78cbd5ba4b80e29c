"""Work tables in the folder that the whole cluster shares.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it back: any
executor may die afterwards without recomputing what led to it.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side that is counted first may be broadcast.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, one master in one process (tests) gets a temporary one.

    A cluster without the setting is an error: executors cannot see each other's local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            base = "file://" + tempfile.mkdtemp(prefix="loomroute-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


_open = threading.local()


@contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...] = ()):
    """Work tables written inside go when the block ends, but for those of the names in ``keep``.

    What leaves the block may read kept tables only.
    """
    outer, own = getattr(_open, "paths", None), []
    _open.paths = own
    try:
        yield
    finally:
        _open.paths = outer
        for name, path in own:
            if name not in keep:
                _delete(spark, path)
            elif outer is not None:
                outer.append((name, path))


def _parent(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _parent(spark, path)
    fs.delete(at, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; it goes with its scratch block, or when the application ends."""
    path = f"{shared_dir(spark)}/loomroute/{uuid.uuid4().hex}/{name}"
    fs, at = _parent(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append((name, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back with the same schema."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Work tables of a loop: each one goes once the next is written."""

    def __init__(self, name: str) -> None:
        self.name, self.path = name, None

    def save(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = new_folder(spark, self.name)
        df.write.parquet(path)
        if self.path:
            _delete(spark, self.path)
        self.path = path
        return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the counted rows are within the limit; otherwise the planner's shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
