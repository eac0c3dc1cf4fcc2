"""The folder that driver and executors share, for tables that outlive a query's plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Folder of each application for which none is configured; only local masters get one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a temporary folder serves a local master, which has no other machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and (own := spark._jsc.sc().getCheckpointDir()).isDefined():
        path = own.get()
    if not path:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _LOCAL:
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _LOCAL[app] = tempfile.mkdtemp(prefix="lorekeep-")
        path = _LOCAL[app]
    return path.rstrip("/")


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that lazy results read removed when the application ends (Hadoop's deleteOnExit), so that nothing stays in the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
