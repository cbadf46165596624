"""Session helpers: shared-folder tables that cut lineage, and partition sizing.

Nothing here holds data on the driver.  `cut` writes a table into the folder the
cluster names in ``spark.checkpoint.dir`` (all executors share it), so a lost
executor costs a re-read, never a re-run of everything before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}
_RUN = uuid.uuid4().hex  # tables of this driver process lie together, apart from others'


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the session names in spark.checkpoint.dir,
    else the one given to setCheckpointDir, else (on a local master only, as in tests) a
    temporary one that goes with the process.  A cluster without a named folder is an error:
    a folder of one machine would be read back incomplete."""
    sc = spark.sparkContext
    # The conf of the running context, not the session's: reading it sets nothing.
    named = sc._jsc.sc().conf().get(CHECKPOINT_KEY, "") or spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = sc.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="lexmill-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = "file://" + path
    return _OWN[app]


def table_dir(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table of this run."""
    return f"{shared_dir(spark)}/lexmill/{_RUN}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = table_dir(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete every table this process has written to the session's shared folder.

    A query's result reads such tables when it is run, so its caller calls this once the
    result has been used; tables of other processes stay."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexmill/{_RUN}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def partitions(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions that hold about `per_partition` rows each; never fewer than the
    cluster's slots when there is enough to share out, never below one."""
    by_rows = -(-rows // max(1, per_partition))
    return int(max(1, by_rows, min(slots(spark), -(-rows // 2000))))
