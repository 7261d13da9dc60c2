"""Tables that outlive executors.

Iterative and multi-pass operators cut their lineage by writing a Parquet table to
the folder the cluster shares (``spark.checkpoint.dir``).  Only where that setting is
absent and the session runs on one machine, as in tests, a folder of our own is made.

Tables lie in a folder of the application.  Loops give back the table of the round
before; the rest, which results may still read, goes when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own and of tables, by application.
_OWN: dict[str, str] = {}
_USED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read and write."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="mooring-")
    return _OWN[app]


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/mooring-tables/{spark.sparkContext.applicationId}"
    if folder not in _USED:
        _USED[folder] = spark
        atexit.register(_delete, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        if path := table.__dict__.pop("_written", None):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # the driver's JVM may be gone already
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def broadcast_array(spark: SparkSession, array, limit_bytes: int = 128 << 20):
    """Broadcast a numpy array whose size is checked against ``limit_bytes``."""
    if array.nbytes > limit_bytes:
        raise ValueError(f"{array.nbytes} bytes exceed the broadcast limit of {limit_bytes}")
    return spark.sparkContext.broadcast(array)
