"""Session settings the jobs rely on, and the checkpoint folder rule."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method of more bytes; a stage that would need one runs operator by operator instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build(master: str | None = None, app: str = "postern", **extra: str) -> SparkSession:
    """A session with the settings above; the cluster's own values win when passed in."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """The limit above for a session built elsewhere, unless it names one: wide projections run many times slower without it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, SETTINGS[key])


_STAGED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where none is named, a local session gets a folder of its own, removed at exit; a cluster is refused, since
    its executors would write to disks that the others do not see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="postern-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def clear_staged(spark: SparkSession) -> int:
    """Remove the tables and folders this process has staged; for the end of a run, when its results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def staged_folder(spark: SparkSession, kind: str = "stage") -> str:
    """A new folder name in the shared folder, which `clear_staged` removes with what it holds."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, **written: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the files; `written` are options of the writer.

    Used where one table (findings, server snapshots) feeds several branches of a plan: it is then
    computed once, keeps column pruning, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = staged_folder(spark)
    df.write.options(**written).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an iterative step, in the same shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
