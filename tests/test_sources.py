from __future__ import annotations

import datetime as dt
import re
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import day, rows
from wearlog.operators.portfolio import compare
from wearlog.plans import reports
from wearlog.schema import category_dim
from wearlog.sources import storage, study, wide

SHEET = '''Category,Item,Photo,Photo placeholder,Details,Price,Date purchased,Date divested,Times used init,Materials,Weight,Times used,Cost per wear,01.01.2020,02.01.2020,03.01.2020
Shirts,"Blue, old",p1,,,20,2019-12-01,,3,Cotton,0.2,9,1,TRUE,FALSE,
Shirts,White,p2,,,cheap,2020-01-02,2020-01-02,x,,,,,,TRUE,TRUE
,,,,,,,,,,,,,,,
Pants,ADD NEXT,,,,,,,,,,,,FALSE,FALSE,FALSE
'''
SERIAL = 'Category,Item,Price,Times used init,Date purchased,43831,43832\nShirts,"Blue\r\ntop",10,0,2020-01-01,x,\nPants,Jeans,30,1,2020-01-01,,x\n'


@pytest.fixture
def folder(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(text.encode())
        return str(path)

    return write


def test_wide_sheet(spark, folder):
    sheet = wide.read_wide(spark, folder("sheet.csv", SHEET))
    assert wide.day_columns(sheet) == ["2020-01-01", "2020-01-02", "2020-01-03"]
    assert wide.sheet_range(sheet) == (day(1), day(3))
    items = wide.sheet_items(sheet)
    assert rows(items, "item", "price", "used_init", "date_divested") == [
        ("ADD NEXT", None, None, None), ("Blue, old", 20.0, 3.0, None), ("White", None, None, day(2)),
    ]
    log = wide.to_log(sheet)
    assert rows(log.where("item <> 'ADD NEXT'"), "user", "item", "date", "used") == [
        ("me", "Blue, old", day(1), True), ("me", "Blue, old", day(2), False),
        ("me", "White", day(2), True), ("me", "White", day(3), True),
    ]


def test_serial_sheet(spark, folder):
    sheet = wide.read_wide(spark, folder("old.csv", SERIAL), header="serial", multi_line=True)
    assert rows(wide.to_log(sheet), "item", "date", "used") == [
        ("Blue top", day(1), True), ("Blue top", day(2), False), ("Jeans", day(1), False), ("Jeans", day(2), True),
    ]
    with pytest.raises(ValueError):
        wide.read_wide(spark, folder("old2.csv", SERIAL), header="roman")


def test_refresh_builds_all_tables(spark, folder):
    sheet = wide.read_wide(spark, folder("sheet.csv", SHEET))
    tables = reports.refresh(sheet, category_dim(spark, ["Shirts", "Pants"]))
    assert rows(tables["usage"], "item", "date", "active", "cumuse", "photo") == [
        ("Blue, old", day(1), True, 4.0, "Photos/p1.png"),
        ("Blue, old", day(2), True, 4.0, "Photos/p1.png"),
        ("Blue, old", day(3), False, 4.0, "Photos/p1.png"),
        ("White", day(2), True, None, "Photos/p2.png"),
        ("White", day(3), False, None, "Photos/p2.png"),
    ]
    assert rows(tables["item_listing"], "item", "status", "times_worn", "cost_per_wear") == [
        ("Blue, old", "Divested", 4.0, 5.0), ("White", "Divested", None, None),
    ]
    assert {name for name, table in tables.items() if table.count() == 0} == {"category_listing"}  # nothing is active
    assert rows(reports.category_view(tables["usage"], ["Shirts"]), "item") == [("Blue, old",), ("White",)]


def test_study_scans(spark, folder):
    text = "user,category,item,wears,price,listed_date,date_purchased\nu,Shirts,a,,12.5,2021-06-01,2020-01-01\nu,,b,1,1,,\nu,Knits,,1,1,,\nu,Knits,c,2,free,2021-07-01,\n"
    path = folder("study.csv", text)
    found = study.read_study(spark, path, file_format="csv")
    assert "listed_date" not in found.columns
    assert rows(found, "item", "wears", "price", "date_purchased") == [("a", 0.0, 12.5, day(1)), ("c", 2.0, None, None)]
    opened = study.read_study(spark, path, open_project=True, file_format="csv")
    assert rows(opened, "item", "date_purchased") == [("a", dt.date(2021, 6, 1)), ("c", dt.date(2021, 7, 1))]
    users = study.read_users(spark, folder("users.csv", "user,gender\nu,Female\n,\nEND OF LIST,\n"), "csv")
    assert rows(users, "user") == [("u",)]
    log = study.read_category_changes(spark, folder("changes.csv", "change_seq,user,item,target_category\n2,u,a,Knits\nx,u,b,Pants\n"))
    assert rows(log, "change_seq", "target_category") == [(None, "Pants"), (2, "Knits")]


def test_prepared_study(spark, folder):
    items = spark.createDataFrame(
        [("u", "Shirts", "a", 10.0, 1.0, None), ("u", "Other", "b", 10.0, 1.0, None), ("v", "Shirts", "c", 10.0, 1.0, day(1))],
        "user string, category string, item string, price double, cpw double, date_divested date",
    )
    users = spark.createDataFrame([("u", 2.0), ("v", 1.0)], "user string, exchange_rate double")
    changes = spark.createDataFrame([(1, "u", "b", "Knits")], "change_seq long, user string, item string, target_category string")
    dim = category_dim(spark, ["Knits", "Other", "Shirts"])
    found = reports.prepare_study_items(items, day(2), dim, changes, users, exclude=["x"])
    assert rows(found, "category", "item", "price") == [("Knits", "b", 20.0), ("Shirts", "a", 20.0)]


def test_comparison_rows_join_own_categories(spark, folder):
    external = study.read_comparison(spark, folder("c.csv", "Category,photo,monthly cost,category use,Details\nPhone,ph.png,12.5,1,x\n"))
    own = spark.createDataFrame(
        [("me", "Shirts", day(3), 0.5, 120.0, "s.png")],
        "user string, category string, date date, category_use double, yearly_cost double, photo string",
    )
    assert rows(compare(own, external), "category", "monthly_cost", "category_use", "comparison", "date") == [
        ("Phone", 12.5, 1.0, True, day(3)), ("Shirts", 10.0, 0.5, False, day(3)),
    ]


def test_tables_come_back_unchanged(spark, tmp_path):
    df = spark.createDataFrame([("u", 'a "quoted", name', 1.5, None), ("v", "b", None, day(1))], "user string, item string, x double, d date")
    assert rows(storage.materialised(df)) == rows(df)
    storage.save(df, str(tmp_path / "parted"), partition_by=["user"])
    assert rows(storage.load(spark, str(tmp_path / "parted")), "user", "x") == rows(df, "user", "x")
    storage.write_csv(df, str(tmp_path / "csv"))
    assert rows(storage.read_csv(spark, str(tmp_path / "csv"), df.schema)) == rows(df)
    storage.save(df, str(tmp_path / "snap"))
    assert storage.read_snapshot(spark, str(tmp_path / "snap"), "_old").columns == ["user", "item", "x_old", "d_old"]


def test_scratch_folder_comes_from_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert storage.scratch_path(spark, "x").startswith(shared.rstrip("/"))
    assert rows(storage.materialised(spark.range(3).toDF("n"))) == [(0,), (1,), (2,)]


def test_discarded_tables_leave_nothing(spark):
    table = storage.materialised(spark.range(5).toDF("n"), "gone")
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    storage.discard(table)
    assert not os.path.exists(folder)
    elsewhere = spark.range(1).toDF("n")
    storage.discard(elsewhere)  # not a scratch table: nothing happens


@pytest.mark.parametrize(
    ("header", "columns", "days"),
    [
        ("date", "1.2.2018,01.03.2018,2.02.2018", ["2018-02-01", "2018-03-01", "2018-02-02"]),
        ("serial", "43102.0,43103", ["2018-01-02", "2018-01-03"]),
    ],
)
def test_forms_of_day_headers(spark, folder, header, columns, days):
    sheet = wide.read_wide(spark, folder("forms.csv", f"Category,Item,Details,{columns}\nShirts,Blue,x,{',' * columns.count(',')}\n"), header=header)
    assert wide.day_columns(sheet) == days
    assert wide.sheet_range(sheet) == (dt.date.fromisoformat(min(days)), dt.date.fromisoformat(max(days)))


@pytest.mark.parametrize("columns", ["Notes", "1.2.2018,01.02.2018", "43102"])
def test_headers_that_are_no_days_are_errors(spark, folder, columns):
    with pytest.raises(ValueError):
        wide.read_wide(spark, folder("bad.csv", f"Category,Item,{columns}\nShirts,Blue,{',' * columns.count(',')}\n"))


def test_category_list_has_no_limit(spark):
    assert category_dim(spark, [str(i) for i in range(10_001)]).count() == 10_001
    assert rows(category_dim(spark, ["b", "a"], ["b.html", None]), "category", "rank", "url") == [("a", 2, None), ("b", 1, "b.html")]


def test_intraday(spark):
    from wearlog.operators.cleaning import intraday

    raw = spark.createDataFrame([("2020-01-01", "10:01:00", "7"), ("2020-01-01", "??", "x")], "dateTime string, dataset_time string, dataset_value string")
    assert rows(intraday(raw).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm"))) == [(None, None), ("2020-01-01 10:01", 7.0)]


def test_sheet_of_eleven_years_is_one_array(spark, tmp_path):
    """Four thousand day columns are planned in seconds, and a range reads only its own."""
    import time

    days = [dt.date(2015, 1, 1) + dt.timedelta(n) for n in range(4000)]
    names = ["Category", "Item", "Price", *[d.strftime("%d.%m.%Y") for d in days]]
    cells = [[c, i, p, *[None if (n + k) % 3 else str(n % 2 == 0) for n in range(4000)]] for k, (c, i, p) in enumerate([("Shirts", "a", "1"), ("Shoes", "b", "2")])]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*cells, strict=True)), strict=True))), str(tmp_path / "sheet.parquet"))
    path, read = str(tmp_path / "sheet.parquet"), wide.read_log
    began = time.time()
    log = read(spark, path, file_format="parquet")
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 30 and "Expand" not in plan and "Generate" in plan
    got = log.groupBy("item").agg(F.count("used"), F.min("date"), F.sum(F.col("used").cast("int"))).orderBy("item").collect()
    assert [tuple(r) for r in got] == [("a", 1334, days[0], 667), ("b", 1333, days[2], 667)]
    part = read(spark, path, file_format="parquet", first=days[10], last=days[12])
    scan = next(x for x in part._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert len(set(re.findall(r"\d\d\.\d\d\.\d{4}", scan))) == 3
    assert sorted(map(tuple, part.select("item", "date").collect())) == [("a", days[12]), ("b", days[11])]
    assert read(spark, path, file_format="parquet", first=dt.date(2099, 1, 1)).count() == 0


@pytest.mark.parametrize(("text", "header"), [(SHEET, "date"), (SERIAL, "serial")])
def test_log_straight_from_a_sheet(spark, folder, text, header):
    path = folder("direct.csv", text)
    sheet = wide.read_wide(spark, path, header=header, multi_line=True)
    log = wide.read_log(spark, path, header=header, multi_line=True)
    assert rows(log) == rows(wide.to_log(sheet)) and log.columns == wide.to_log(sheet).columns
    first, last = wide.sheet_range(sheet)
    assert rows(wide.read_log(spark, path, header=header, multi_line=True, last=first)) == rows(wide.to_log(sheet, last=first))
    assert rows(wide.to_log(sheet, first=last)) == [r for r in rows(log) if r[3] == last]
