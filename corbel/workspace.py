"""Where operators keep the tables that cut lineage: Parquet folders below ``spark.checkpoint.dir``.

A table written there outlives any executor, so nothing is recomputed after a loss and nothing is
kept in an executor's own folder.  The setting is read from the session; only a local session (tests on
one machine) may leave it unset, and then gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; one is made only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corbel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Workspaces of this process that have not been closed.
_OPEN: list[Workspace] = []


class Workspace:
    """Named intermediate tables of one run of an operator.

    A result is computed from them when it is read, so whoever writes it closes the workspace afterwards: either by
    ``close``, or for all workspaces opened since by ``closing``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/corbel/{label}-{uuid.uuid4().hex[:12]}"
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as read back, with no lineage before the file."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Delete all tables; nothing that was computed from them may be read any more."""
        self._delete(self.root)
        if self in _OPEN:
            _OPEN.remove(self)


class closing:
    """``with closing():`` closes, at its end, the workspaces that were opened inside."""

    def __enter__(self) -> None:
        self.before = list(_OPEN)

    def __exit__(self, *error: object) -> None:
        for ws in [w for w in _OPEN if w not in self.before]:
            ws.close()
