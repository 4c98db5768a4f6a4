"""Saving, reloading and exporting result tables, and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """Where this application keeps its scratch tables; ``release`` deletes it."""
    return f"{shared_folder(spark)}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a scratch table."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results read from them must be stored before."""
    _delete(spark, scratch_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a saved table."""
    _delete(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(found)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, by any file system that Spark knows; none if it is missing."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory())


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Keep an intermediate table as Parquet, optionally laid out by partition columns."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table once to the shared folder and continue from the file, which ``release`` deletes."""
    path = scratch_path(df.sparkSession, name)
    save(df, path)
    return load(df.sparkSession, path)


def discard(table: DataFrame) -> None:
    """Delete a ``materialised`` table ahead of ``release``, when nothing will read it any more."""
    folders = {file.rpartition("/")[0] for file in table.inputFiles()}
    for folder in folders:
        if scratch_folder(table.sparkSession).rpartition("/")[2] in folder.split("/"):
            _delete(table.sparkSession, folder)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Export a result table with a header row, as one folder of part files."""
    df.write.mode(mode).csv(path, header=True, escape='"')


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read an exported table; all columns are strings unless a schema is given."""
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_snapshot(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Reload an archived table, its measures optionally renamed for a comparison."""
    df = load(spark, path)
    keys = {"user", "category", "item"}
    return df.select(*[df[c].alias(c if c in keys else c + suffix) for c in df.columns])
