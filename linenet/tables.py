"""Tables in the shared folder: what cuts lineage, survives lost executors, and goes once nothing reads it.

`settled` writes a DataFrame as Parquet under spark.checkpoint.dir and reads it again. A table's files are deleted by a
later call once the JVM holds no plan that reads them, so long chains of steps keep only what is still in use.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[str, object, str]] = []  # application, weak reference to the table's file index, path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (in local mode only) one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="linenet-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/linenet/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written to the shared folder and read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    plan = out._jdf.queryExecution().analyzed()
    _kept.append((spark.sparkContext.applicationId, spark._jvm.java.lang.ref.WeakReference(plan.relation().location()), path))
    del plan
    sweep(spark)
    return out


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark deletes shuffle files of finished jobs, and delete the tables that no
    plan reads any more."""
    gc.collect()
    spark._jvm.System.gc()
    app, still = spark.sparkContext.applicationId, []
    for kept in _kept:
        if kept[0] != app:
            continue
        if kept[1].get() is None:
            _delete(spark, kept[2])
        else:
            still.append(kept)
    _kept[:] = still


def discard(df: DataFrame) -> None:
    """Delete at once what settled() wrote for df, where a name still holds it but nothing will read it."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
