"""Wide diary sheets: one row per item, attribute columns, then one column per day."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearlog.sources.workbook import read_workbook

# Sheet header -> column name and type.
ATTRIBUTES = {
    "User": ("user", "string"),
    "Category": ("category", "string"),
    "Item": ("item", "string"),
    "Photo": ("photo", "string"),
    "Price": ("price", "double"),
    "Date purchased": ("date_purchased", "date"),
    "Date divested": ("date_divested", "date"),
    "Times used init": ("used_init", "double"),
    "Materials": ("materials", "string"),
    "Weight": ("weight", "double"),
}
# Sheet columns that are known and not read.
UNREAD = ("Photo placeholder", "Details", "Times used", "Cost per wear")
DAY_HEADER = re.compile(r"(\d{1,2})\.(\d{1,2})\.(\d{4})")
SERIAL_HEADER = re.compile(r"(\d{5})(\.0+)?")
ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
SERIAL_ORIGIN = dt.date(1899, 12, 30)


def _quoted(name: str) -> Column:
    return F.col(_name(name))


def _header_day(header: str, serial: bool) -> dt.date | None:
    """The day that a header names; ``1.2.2018`` and ``01.02.2018`` are one, as are ``43102`` and ``43102.0``."""
    text = header.strip()
    if serial:
        found = SERIAL_HEADER.fullmatch(text)
        return SERIAL_ORIGIN + dt.timedelta(days=int(found[1])) if found else None
    found = DAY_HEADER.fullmatch(text)
    return dt.date(int(found[3]), int(found[2]), int(found[1])) if found else None


def clean_sheet(sheet: DataFrame, header: str = "date", owner: str = "me") -> DataFrame:
    """Typed attributes and boolean day columns named ``yyyy-MM-dd``.

    Day columns are found by their header. ``header='date'`` reads ``dd.MM.yyyy`` headers
    and true/false cells, where an empty cell is unknown. ``header='serial'`` reads
    spreadsheet day numbers, where any mark means used and an empty cell not used; line
    breaks in item names become spaces. Rows without a value in the first column go. A header
    that is neither an attribute, a column known as unread nor a day is an error, and so are
    two columns for one day.
    """
    if header not in ("date", "serial"):
        raise ValueError(f"unknown header style {header!r}")
    days, serial = sheet_days(sheet, header), header == "serial"
    columns = _attributes(sheet, serial, owner)
    for name, day in days.items():
        cell = "{0} IS NOT NULL" if serial else "try_cast({0} AS boolean)"
        columns.append(F.expr(f"{cell.format(_name(name))} AS `{day.isoformat()}`"))
    return sheet.where(_quoted(sheet.columns[0]).isNotNull()).select(*columns)


def sheet_days(sheet: DataFrame, header: str = "date") -> dict[str, dt.date]:
    """The day columns of a sheet, by their headers; fails on other columns that are not known."""
    found: dict[str, dt.date] = {}
    seen: dict[dt.date, str] = {}
    for name in sheet.columns:
        if name in ATTRIBUTES or name in UNREAD:
            continue
        day = _header_day(name, header == "serial")
        if day is None:
            raise ValueError(f"column {name!r} is neither an attribute nor a day")
        if day in seen:
            raise ValueError(f"columns {seen[day]!r} and {name!r} are the same day")
        found[name] = day
        seen[day] = name
    return found


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _attributes(sheet: DataFrame, serial: bool, owner: str, wanted: tuple[str, ...] | None = None) -> list[Column]:
    """Typed attribute columns of a sheet, all or those wanted."""
    columns, names = [], set(sheet.columns)
    for name, (alias, kind) in ATTRIBUTES.items():
        if wanted is not None and alias not in wanted:
            continue
        if name in names:
            value = _quoted(name).try_cast(kind)
            if serial and alias == "item":
                value = F.regexp_replace(value, "\r\n", " ")
            columns.append(value.alias(alias))
        elif alias == "user":
            columns.append(F.lit(owner).alias("user"))
    return columns


def read_wide(
    spark: SparkSession, path: str, header: str = "date", file_format: str = "csv", owner: str = "me", multi_line: bool = False
) -> DataFrame:
    """Scan a diary sheet: an export (CSV with header, or Parquet) or workbooks (``xlsx``: the first sheet).

    ``multi_line`` is for sheets whose item names hold line breaks; a file is then read by one task.
    """
    return clean_sheet(_scan(spark, path, file_format, multi_line), header, owner)


def _scan(spark: SparkSession, path: str, file_format: str, multi_line: bool) -> DataFrame:
    if file_format == "xlsx":
        return read_workbook(spark, path)
    reader = spark.read
    if file_format == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.format(file_format).load(path)


def day_columns(sheet: DataFrame) -> list[str]:
    return [c for c in sheet.columns if ISO_DAY.fullmatch(c)]


def sheet_range(sheet: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last day of the sheet, from its columns alone."""
    days = day_columns(sheet)
    return dt.date.fromisoformat(min(days)), dt.date.fromisoformat(max(days))


def sheet_items(sheet: DataFrame) -> DataFrame:
    """Item attributes without the day columns."""
    return sheet.drop(*day_columns(sheet))


def _spread(rows: DataFrame, cells: list[str], days: list[dt.date]) -> DataFrame:
    """One row per sheet row and cell: the cells of a row are one array, spread once.

    The days are one literal next to it, so that the plan does not grow by an expression a day.
    Cells of different types, as of columns without any mark, are strings.
    """
    kinds = dict(rows.dtypes)
    one = "{}" if len({kinds[c] for c in cells}) < 2 else "cast({} AS string)"
    array = F.expr(f"array({', '.join(one.format(_name(c)) for c in cells)})")
    listed = f"split('{','.join(d.isoformat() for d in days)}', ',')" if days else "array()"
    dates = F.expr(f"cast({listed} AS array<date>)")
    spread = rows.select("user", "category", "item", F.posexplode(array).alias("_day", "cell"))
    return spread.withColumn("date", F.get(dates, "_day")).drop("_day")


def _within(day: dt.date, first: dt.date | None, last: dt.date | None) -> bool:
    return (first is None or day >= first) and (last is None or day <= last)


def to_log(sheet: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Tidy log with one row per filled cell; an empty cell is not an unused day.

    Day columns outside the range are not read.
    """
    days = [d for d in day_columns(sheet) if _within(dt.date.fromisoformat(d), first, last)]
    log = _spread(sheet, days, [dt.date.fromisoformat(d) for d in days])
    return log.where(F.col("cell").isNotNull()).select("user", "category", "item", "date", F.col("cell").cast("boolean").alias("used"))


def read_log(
    spark: SparkSession,
    path: str,
    header: str = "date",
    file_format: str = "csv",
    owner: str = "me",
    multi_line: bool = False,
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> DataFrame:
    """The tidy log straight from a sheet, for sheets with thousands of days.

    As ``to_log`` of ``read_wide``, but cells are typed after they are spread: the plan has no
    expression per day, and columns outside the range are not read.
    """
    serial = header == "serial"
    sheet = _scan(spark, path, file_format, multi_line)
    days = {n: d for n, d in sheet_days(sheet, header).items() if _within(d, first, last)}
    attributes = _attributes(sheet, serial, owner, ("user", "category", "item"))
    rows = sheet.where(_quoted(sheet.columns[0]).isNotNull()).select(*attributes, *map(_quoted, days))
    log = _spread(rows, list(days), list(days.values()))
    used = F.col("cell").isNotNull() if serial else F.col("cell").try_cast("boolean")
    return log.withColumn("used", used).where(F.col("used").isNotNull()).select("user", "category", "item", "date", "used")
