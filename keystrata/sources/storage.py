"""Folders and small files through Spark, so that any store it reads will do."""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a folder of this machine, as tests do; a cluster, whose executors
    don't share one, is refused.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
        found = "/tmp/checkpoints"
    return found.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the session's checkpoint folder; sets one only where the session has none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _forget(spark: SparkSession, paths: list[str]) -> None:
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/keystrata/{app}/{label}-{uuid.uuid4().hex}"
    if app not in _made:
        _made[app] = []
        atexit.register(_forget, spark, _made[app])
    _made[app].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).collect()
    return json.loads("".join(r.value for r in rows))
