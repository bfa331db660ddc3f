"""Tables written once to the folder that the whole cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_registered: list[tuple[SparkSession, str]] = []
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with its scheme; where that is unset, a temporary one, which only a local master may use."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        at = at or tempfile.mkdtemp(prefix="seqframe-shared-")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
        _folders[app] = f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole
    return _folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own, removed when the driver ends."""
    path = f"{shared_dir(spark)}/seqframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _registered:
        atexit.register(_remove_all)
    _registered.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _registered:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder belongs to the cluster
            return


class Stored:
    """A table written once to the shared folder: later reads don't recompute it, and it outlives any executor."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """For tables that nothing reads any more."""
        remove(self.spark, self.path)
