"""The session settings that results depend on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(name: str = "tabloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); only local sessions get one of their own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not set_before.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-"))
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_before.get().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tabloom-{label}-{uuid.uuid4().hex[:12]}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Checkpoints are deleted with the frames that read them, if the session says so when its context starts.
_CLEANS = "spark.cleaner.referenceTracking.cleanCheckpoints"
_left: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            if spark.sparkContext._jsc is not None:
                removed(spark, path)
        except Exception:  # the JVM may be gone already
            return


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: stays as it is when executors are lost.

    Where the session cleans checkpoints (``SETTINGS`` asks for it) the copy goes when nothing reads it any more; elsewhere it
    is a table written by name, which goes when the driver ends."""
    spark = df.sparkSession
    shared_folder(spark)
    if spark.sparkContext.getConf().get(_CLEANS, "false") == "true" or "void" in dict(df.dtypes).values():
        return df.checkpoint()
    path = new_folder(spark, "settled")
    df.write.parquet(path)
    _left.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
