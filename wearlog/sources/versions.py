"""A table kept in versions, of which each writes only the periods that changed.

Folder layout: ``rows/in_version=V/in_period=P`` has the rows that version V wrote for a period (a year
or month), ``manifest/V`` says for each period of version V which version has its rows. The manifest is
written last: a version that broke off is not seen, and is written again under the same number.

A period is unchanged if it has the same rows, in any order and any number of files, by two sums of
64-bit hashes over all columns. A version with other columns or types is written whole. Comparing two
versions reads only the periods whose entries differ, and these are folders, so the others are neither
listed nor scanned. Manifests have a row per period, so the calendar bounds what comes to the driver.

Behaviour: rows without a period are a period of their own. Repeated rows count. An empty table is a
version without periods. Column names that differ from the table's own by case only are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearlog.sources import storage

VERSION, PERIOD = "in_version", "in_period"
#: Name of the period of rows that have none.
NO_PERIOD = "none"
ENTRY = ("n_rows", "first_sum", "second_sum", "shape")


def by_year(date: str) -> Column:
    return F.date_format(date, "yyyy")


def by_month(date: str) -> Column:
    return F.date_format(date, "yyyy-MM")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that are complete."""
    names = storage.subfolders(spark, f"{folder}/manifest")
    return sorted(int(n) for n in names if storage.exists(spark, f"{folder}/manifest/{n}/_SUCCESS"))


def _entries(df: DataFrame, period: Column) -> DataFrame:
    """Per period: number of rows and sums of hashes, in which a null is not the same as nothing."""
    cells = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)")).cast("string")
    return df.groupBy(period.alias(PERIOD)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        total(1).alias("first_sum"),
        total(2).alias("second_sum"),
        F.lit(df.schema.simpleString()).alias("shape"),
    )


def manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """Per period of a version: its entry and ``in_version``, the version that wrote its rows."""
    return storage.load(spark, f"{folder}/manifest/{version}")


def _by_period(spark: SparkSession, folder: str, version: int) -> dict[str, dict]:
    return {row[PERIOD]: row.asDict() for row in manifest(spark, folder, version).collect()}


def write_version(df: DataFrame, folder: str, period: Column) -> int:
    """Add a version and return its number. The table is read twice, so it should be a saved one."""
    spark = df.sparkSession
    taken = {c.lower() for c in df.columns} & {VERSION, PERIOD}
    if taken:
        raise ValueError(f"columns of the layout: {sorted(taken)}")
    named = F.coalesce(period.cast("string"), F.lit(NO_PERIOD))
    done = versions(spark, folder)
    number = done[-1] + 1 if done else 1
    before = _by_period(spark, folder, done[-1]) if done else {}
    found = []
    for row in _entries(df, named).collect():
        old = before.get(row[PERIOD])
        same = old is not None and all(old[c] == row[c] for c in ENTRY)
        found.append((*row, old[VERSION] if same else number))
    changed = [row[0] for row in found if row[-1] == number]
    if changed:
        rows = df.withColumn(PERIOD, named).where(F.col(PERIOD).isin(changed))
        storage.save(rows, f"{folder}/rows/{VERSION}={number}", [PERIOD])
    storage.save(df.limit(0), f"{folder}/shape/{number}")
    layout = T.StructType(
        [T.StructField(PERIOD, T.StringType()), T.StructField("n_rows", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ENTRY[1:]]
        + [T.StructField(VERSION, T.LongType())]
    )
    storage.save(spark.createDataFrame(found, layout).coalesce(1), f"{folder}/manifest/{number}")
    return number


def _read(spark: SparkSession, folder: str, version: int, entries: dict[str, dict]) -> DataFrame:
    schema = storage.load(spark, f"{folder}/shape/{version}").schema
    if not entries:
        return spark.createDataFrame([], schema)
    paths = [f"{folder}/rows/{VERSION}={e[VERSION]}/{PERIOD}={p}" for p, e in sorted(entries.items())]
    return spark.read.schema(schema).parquet(*paths)


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return _read(spark, folder, version, _by_period(spark, folder, version))


def read_changed(spark: SparkSession, folder: str, old: int, new: int) -> tuple[DataFrame, DataFrame]:
    """Rows of two versions in the periods that differ between them.

    A comparison of rows by keys gives the same changes as one of the whole tables if a key has one row
    a version: a row that moved to another period changes both.
    """
    then, now = _by_period(spark, folder, old), _by_period(spark, folder, new)
    differ = {p for p in then.keys() | now.keys() if p not in then or p not in now or any(then[p][c] != now[p][c] for c in ENTRY)}
    return tuple(_read(spark, folder, v, {p: e for p, e in of.items() if p in differ}) for v, of in ((old, then), (new, now)))
