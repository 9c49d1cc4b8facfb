"""The 14 retail tables by their schemas: written as CSV and Parquet, read back, and queried."""

from __future__ import annotations

import pytest

from kartlane.operators import business as B
from kartlane.plans import reports as RP
from kartlane.sources.catalog import SCHEMAS, TABLE_NAMES, external, read_checked, read_table


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_tables_round_trip(spark, cat, tmp_path, fmt):
    assert set(SCHEMAS) == set(TABLE_NAMES)
    want = {}
    for n in TABLE_NAMES:
        df = spark.createDataFrame([], SCHEMAS[n])
        df = cat.table(n).select(*[cat.table(n)[f.name].cast(f.dataType) for f in df.schema.fields])
        # CSV knows no difference between null and an empty text, and drops spaces around it
        df = df.na.replace(" ", "blank") if n == "customers" else df
        getattr(df.write.option("header", True), fmt)(f"{tmp_path}/{n}.{fmt}")
        want[n] = df
    files = external(spark, str(tmp_path), fmt)
    for n in ("orders", "customers", "promotions", "sales"):
        got = files.table(n)
        assert got.dtypes == want[n].dtypes
        key = lambda r: str(tuple(r))
        assert sorted(map(key, got.collect())) == sorted(map(key, want[n].collect()))
    assert B.segment_margin(files.table("products")).count() == B.segment_margin(cat.table("products")).count()
    assert files.table("item_values").count() == cat.table("order_items").count()


def test_unknown_tables_and_formats(spark, cat, tmp_path):
    with pytest.raises(KeyError, match="Available tables"):
        read_table(spark, "nothing", str(tmp_path))
    with pytest.raises(ValueError):
        read_table(spark, "sales", str(tmp_path), "xml")
    with pytest.raises(KeyError, match="Available tables"):
        cat.table("nothing")


def test_unreadable_rows_are_quarantined_by_column_and_reason(spark, tmp_path):
    (tmp_path / "s.csv").write_text("order_id,ship_date,delivery_date,shipping_fee\n1,2020-01-02,2020-01-05,3.5\n2,,,\n3,2020-13-02,2020-01-05,3.5\n"
                                    "x4,2020,2020-01-05,abc\n5,2020-01-02\n6,2020-01-02,2020-01-05,1.0,more\n7,2020-01-02,\"2020-01-05\",1e2\n")
    clean, bad = read_checked(spark, "shipments", str(tmp_path / "s.csv"))
    assert clean.dtypes == spark.createDataFrame([], SCHEMAS["shipments"]).dtypes
    assert sorted((r.order_id, str(r.ship_date), r.shipping_fee) for r in clean.collect()) == [(1, "2020-01-02", 3.5), (2, "None", None), (7, "2020-01-02", 100.0)]
    got = sorted((r.column, r.reason, r.value) for r in bad.collect() if r.column != "_row")
    assert got == [("order_id", "not a bigint", "x4"), ("ship_date", "not a date", "2020"), ("ship_date", "not a date", "2020-13-02"), ("shipping_fee", "not a double", "abc")]
    broken = [r.line for r in bad.collect() if r.column == "_row"]
    assert len(broken) == 2 and any(x.startswith("5,") for x in broken) and any("more" in x for x in broken)
    (tmp_path / "empty.csv").write_text("order_id,ship_date,delivery_date,shipping_fee\n")
    clean, bad = read_checked(spark, "shipments", str(tmp_path / "empty.csv"))
    assert clean.count() == bad.count() == 0
    with pytest.raises(KeyError, match="Available tables"):
        read_checked(spark, "nothing", str(tmp_path))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_write_that_fails_half_way_leaves_the_version_before(spark, tmp_path, fmt):
    from pyspark.sql import functions as F
    root = f"{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        RP.read_version(spark, root)
    one, two = spark.createDataFrame([(1, "a"), (2, None)], "x int, s string"), spark.range(5).toDF("y")
    RP.commit({"one": one, "two": two}, root, fmt)
    fails = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.lit("z")).cast("string").alias("y"))
    with pytest.raises(Exception, match="no"):
        RP.commit({"one": one.union(one), "two": fails}, root, fmt)
    now = RP.read_version(spark, root, check=True)
    assert sorted(map(tuple, now["one"].collect()), key=str) == [(1, "a"), (2, None)] and now["two"].count() == 5
    assert RP.latest(spark, root)["version"] == 1
    RP.commit({"one": one.union(one)}, root, fmt)
    now = RP.read_version(spark, root, check=True)
    assert RP.latest(spark, root)["version"] == 2 and list(now) == ["one"] and now["one"].count() == 4


def test_a_changed_file_is_noticed(spark, tmp_path):
    root = f"{tmp_path}/out"
    path = RP.commit({"one": spark.range(5).toDF("y")}, root)["one"]
    spark.range(1).toDF("y").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="one is not what version 1 says"):
        RP.read_version(spark, root, check=True)


def test_derived_tables_are_shared_by_catalogs_over_the_same_files(spark, tmp_path):
    import shutil

    from kartlane.sources.catalog import Catalog
    for t in ("orders", "customer"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    made = []

    def ask(c):
        return c.shared("days", lambda: made.append(1) or c.raw("orders").groupBy(c.raw("orders").o_orderdate).count()).count()
    days = ask(Catalog(spark, str(tmp_path)))
    assert days == ask(Catalog(spark, str(tmp_path) + "/")) > 100 and len(made) == 1
    own = Catalog(spark, str(tmp_path), {"days_": spark.range(1)})
    assert ask(own) == ask(own) == days and len(made) == 2         # tables of its own: written for this catalog
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(10).coalesce(1).write.parquet(f"{tmp_path}/new")
    part = next(p for p in (tmp_path / "new").iterdir() if p.suffix == ".parquet")
    shutil.copy(part, tmp_path / "orders.parquet")
    assert ask(Catalog(spark, str(tmp_path))) <= 10 and len(made) == 3


def test_odd_texts_are_judged_as_by_the_patterns_and_counted_in_one_reading(spark, tmp_path):
    from pyspark.sql import functions as F
    dates = ["2020-01-02", "2020-01-2 ", "2020-01-5T", " 999-01-02", "+999-01-02", "2020-1-002", "20200-01-2", "2020-01- 2", "2020-02-30", "+10000-01-01",
             "-001-01-02", "0001-01-01", "2020-01-02 ", " 2020-01-02", "2020-01-02T00:00", "2020-01", "2020", "2020/01/02", "٢020-01-02", "2020-01-0٢", "9999-12-31"]
    numbers = ["1", "-1", "+1", "007", "-0", " 7", "7 ", "\t7", "1.0", "1e3", "0x1", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "١", "1 1", "- 1", "1_0", " 7"]
    rows = [(n, d, "2020-01-05", "1.5") for d in dates for n in ("1", numbers[len(d) % 3])] + [(n, "2020-01-02", "2020-01-05", "x") for n in numbers] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "order_id string, ship_date string, delivery_date string, shipping_fee string")
    df.repartition(3).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quoteAll", True).csv(f"{tmp_path}/s")
    spark.createDataFrame([("1,2020-01-02",), ("1,2020-01-02,2020-01-05,1.0,more",)], "value string").coalesce(1).write.text(f"{tmp_path}/broken")
    whole = next(p for p in (tmp_path / "broken").iterdir() if p.suffix == ".txt").read_text()
    (tmp_path / "s" / "more.csv").write_text("order_id,ship_date,delivery_date,shipping_fee\n" + whole)
    out = read_checked(spark, "shipments", f"{tmp_path}/s")
    clean, bad = out
    at, day = df.withColumn("d", F.expr("case when ship_date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' then try_cast(ship_date as date) end")), "ship_date is not null and d is null"
    at = at.withColumn("n", F.expr(r"case when order_id rlike '^\\s*[+-]?[0-9]+\\s*$' then try_cast(order_id as bigint) end"))
    want = {"ship_date": at.where(day).count(), "order_id": at.where("order_id is not null and n is null").count(), "shipping_fee": len(numbers), "_row": 2}
    found = {r.column: r["count"] for r in bad.groupBy("column").count().collect()}
    assert found == want and 10 < want["ship_date"] and 5 < want["order_id"]
    fine = at.where(f"not ({day}) and (order_id is null or n is not null) and coalesce(shipping_fee, '') <> 'x'")
    key = lambda r: str(tuple(r))
    assert sorted(map(key, clean.select("order_id", "ship_date").collect())) == sorted(map(key, fine.select("n", "d").collect()))
    got = {r.what: (r.table_name, r.reason, r.rows) for r in out.counts.collect()}
    assert got.pop("clean") == ("shipments", None, fine.count())
    assert got == {c: ("shipments", {"ship_date": "not a date", "order_id": "not a bigint", "shipping_fee": "not a double", "_row": "fields"}[c], n) for c, n in want.items()}
    plan = out.counts._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan csv") == 1


def test_a_table_of_texts_alone_and_an_empty_one_are_counted(spark, tmp_path):
    (tmp_path / "g.csv").write_text("zip,city,region,district\n1,a,b,c\n,,,\nx,a,b,c\n2,a\n")
    got = sorted((r.what, r.rows) for r in read_checked(spark, "geography", str(tmp_path / "g.csv")).counts.collect())
    assert got == [("_row", 1), ("clean", 2), ("zip", 1)]
    (tmp_path / "e.csv").write_text("zip,city,region,district\n")
    assert [tuple(r) for r in read_checked(spark, "geography", str(tmp_path / "e.csv")).counts.collect()] == [("geography", "clean", None, 0)]
