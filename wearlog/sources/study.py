"""Scans of the multi-user study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearlog import defaults
from wearlog.schema import CATEGORY_CHANGES, STUDY_ITEMS, USERS


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the known columns; text that does not fit becomes null."""
    kinds = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def _scan(spark: SparkSession, path: str, file_format: str) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"') if file_format == "csv" else spark.read
    return reader.format(file_format).load(path)


def prepare_study(df: DataFrame, open_project: bool = False) -> DataFrame:
    """Rows with category and item; missing wears count as 0.

    The listing date is dropped, or stands in for the purchase date in open projects.
    """
    if open_project:
        df = df.drop("date_purchased").withColumnRenamed("listed_date", "date_purchased")
    else:
        df = df.drop("listed_date")
    return (
        typed(df, STUDY_ITEMS)
        .where(F.col("category").isNotNull() & F.col("item").isNotNull())
        .fillna({"wears": 0})
    )


def read_study(spark: SparkSession, path: str, open_project: bool = False, file_format: str = "parquet") -> DataFrame:
    return prepare_study(_scan(spark, path, file_format), open_project)


def prepare_users(df: DataFrame) -> DataFrame:
    """User profiles without empty rows and the end-of-list mark."""
    return typed(df, USERS).where(F.col("user").isNotNull() & (F.col("user") != defaults.END_OF_USER_LIST))


def read_users(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return prepare_users(_scan(spark, path, file_format))


def read_category_changes(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Change log with its running number, the later entry being the valid one."""
    return typed(_scan(spark, path, file_format), CATEGORY_CHANGES)


def read_comparison(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """External products to compare with, unchanged from the export."""
    return _scan(spark, path, file_format)
