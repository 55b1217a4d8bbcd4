import datetime as dt

import pytest

from cubeloom.streaming.ingest import Selector, follow, rows_of, run_once


def test_follow_appends_new_identifiers_once(spark, tmp_path):
    schema = "class string, param int"
    for k, rows in enumerate([[("a", 1), ("a", 1)], [("a", 1), ("b", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, f"{tmp_path}/in", schema, ["class", "param"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == k + 1


def test_selectors(spark, tmp_path):
    df = spark.createDataFrame([("od", "20240101"), ("od", "20240110"), ("rd", "20240110")], "class string, date string")
    today = dt.date(2024, 1, 12)
    rolling = Selector("r", {"class": ["od"]}, "schedule", last_n_days=3)
    assert [r.date for r in rows_of(df, rolling, today).collect()] == ["20240110"]
    fixed = Selector("f", {}, from_date="20240101", to_date="20240105")
    run_once(df, [fixed, rolling], ["class"], str(tmp_path / "out"), today)
    assert spark.read.parquet(str(tmp_path / "out/f")).count() == 1
    with pytest.raises(ValueError):
        Selector("x", {}).dates(today)
