"""Session helpers: shared scratch tables that cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by `small_broadcast` only up to this many bytes of plan statistics.
BROADCAST_BYTES = 8 << 20

_OWN: dict[str, str] = {}
_LEFT: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``. Where that is unset, an own temporary one on a local master; elsewhere an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="flowspark-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


class Scratch:
    """Tables of one operator run, written as Parquet into the shared folder.

    A written table survives lost executors, ends the lineage and gives the optimizer true sizes.
    Tables of finished rounds are dropped by the caller; what the result reads stays until the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/flowspark/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: set[str] = set()
        if not _LEFT:
            atexit.register(_remove_left)
        _LEFT.append(self)

    def put(self, df: DataFrame, path: str | None = None) -> DataFrame:
        """Write df and return it as read back, with the schema kept without a scan for it."""
        path = path or self.new_path()
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._flowspark_path = path
        self.paths.add(path)
        return out

    def only(self, *kept: DataFrame) -> None:
        """Drops all tables but the given ones; nothing lazy that reads the others may be in use."""
        for path in self.paths - {df._flowspark_path for df in kept}:
            self._delete(path)

    def new_path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n:04d}"

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_flowspark_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        self.paths.discard(path)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def bytes(self, df: DataFrame) -> int:
        """Bytes on disk of a table written by put()."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(df._flowspark_path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def _remove_left() -> None:
    """At the end of the program the tables go, if the session still runs."""
    for s in _LEFT:
        try:
            if s.paths:
                s._delete(s.root)
        except Exception:  # noqa: BLE001  the session has ended
            return


def small_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimizer's size statistic proves it small, else df as it is (shuffled join)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df
