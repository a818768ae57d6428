"""Session construction and lineage cutting.

Iterative operators cut lineage with reliable ``checkpoint()`` into the shared
folder named by ``spark.checkpoint.dir``. A private folder is created only when
the setting is absent and the master is local (tests, benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "ledgerlens",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset and
    the master is local does this create a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
        _delete_on_exit(spark, sc.getCheckpointDir())
    return base


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the driver ends (Hadoop's own mark, for any file system)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.deleteOnExit(folder)


_stage_roots: dict[str, str] = {}


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written stage, in this application's own folder under the shared checkpoint
    folder. The application owns its stages: they go when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _stage_roots:
        root = os.path.join(checkpoint_dir(spark), "stages", f"{app}-{uuid.uuid4().hex[:12]}")
        _delete_on_exit(spark, root)
        _stage_roots[app] = root
    return os.path.join(_stage_roots[app], f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); keeps output partitioning."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet in the shared folder and read again: a fraction of a checkpoint's bytes,
    kept until the application ends."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
