"""Table schemas and the category dimension."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns of the tables that are read.
ITEMS = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("photo", T.StringType()),
        T.StructField("materials", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("used_init", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("date_purchased", T.DateType()),
        T.StructField("date_divested", T.DateType()),
    ]
)
USAGE_LOG = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("used", T.BooleanType()),
    ]
)
STUDY_ITEMS = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("secondhand_type", T.StringType()),
        T.StructField("divestment_way", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("repair_kind", T.StringType()),
        T.StructField("reason_not_repaired", T.StringType()),
        T.StructField("repair_willing_to_pay", T.StringType()),
        T.StructField("special_care_kind", T.StringType()),
        T.StructField("wears", T.DoubleType()),
        T.StructField("total_wears", T.DoubleType()),
        T.StructField("washed", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("cpw", T.DoubleType()),
        T.StructField("repaired", T.DoubleType()),
        T.StructField("date_purchased", T.DateType()),
        T.StructField("date_divested", T.DateType()),
        T.StructField("secondhand", T.BooleanType()),
        T.StructField("needs_repair", T.BooleanType()),
        T.StructField("needs_repair_start", T.BooleanType()),
        T.StructField("sentimental_value", T.BooleanType()),
    ]
)
USERS = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("exchange_rate", T.DoubleType()),
    ]
)
CATEGORY_CHANGES = T.StructType(
    [
        T.StructField("change_seq", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("target_category", T.StringType()),
    ]
)
STEPS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("steps", T.DoubleType()),
    ]
)


def category_dim(
    spark: SparkSession,
    order: Sequence[str],
    urls: Iterable[str | None] | None = None,
    photos: Iterable[str | None] | None = None,
) -> DataFrame:
    """Ranked categories; the list order is the report order.

    A local table, whose size Spark knows, so that it chooses the join by itself.
    """
    urls = list(urls) if urls is not None else [None] * len(order)
    photos = list(photos) if photos is not None else [None] * len(order)
    categories = pa.table(
        {
            "category": pa.array(list(order), pa.string()),
            "rank": pa.array(range(1, len(order) + 1), pa.int32()),
            "url": pa.array(urls, pa.string()),
            "category_photo": pa.array(photos, pa.string()),
        }
    )
    return spark.createDataFrame(categories)
