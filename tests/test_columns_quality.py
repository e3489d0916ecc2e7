import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns
from plumbline.operators import profile, quality


def rows(df, *keys):
    return sorted(tuple(r[k] for k in keys) for r in df.collect())


def test_selectors(spark):
    df = spark.createDataFrame([(25, 50000.0, "a", True, datetime.datetime(2024, 1, 1))],
                               "age long, income double, name string, employed boolean, date timestamp_ntz")
    assert columns.numeric_columns(df) == ["age", "income"]
    assert columns.categorical_columns(df) == ["name", "employed"]
    assert columns.datetime_columns(df) == ["date"]
    assert columns.column_types(df) == {"age": "numeric", "income": "numeric", "name": "categorical",
                                        "employed": "numeric", "date": "datetime"}


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 6, float("nan")), (float("nan"), 7, 9.0), (4.0, 8, 10.0)],
                               "a double, b long, c double")
    assert rows(profile.missing_values(df), "column", "missing_count", "missing_percent") == [("a", 1, 25.0), ("c", 2, 50.0)]
    s = profile.table_summary(df).first()
    assert (s.n_rows, s.n_numeric, s.total_missing, s.missing_percent) == (4, 3, 3, 25.0)


def test_empty_table_summary(spark):
    df = spark.createDataFrame([], "a double, b string")
    s = profile.table_summary(df).first()
    assert (s.n_rows, s.total_missing, s.missing_percent) == (0, 0, 0.0)
    assert rows(profile.distinct_counts(df), "column", "n_unique") == [("a", 0), ("b", 0)]


def test_column_info(spark):
    df = spark.createDataFrame([(25.0,), (30.0,), (25.0,), (None,)], "age double")
    r = profile.column_info(df, "age").first()
    assert (r.n_unique, r.type_category, r.missing_percent, r.is_constant) == (2, "numeric", 25.0, False)
    with pytest.raises(KeyError):
        profile.column_info(df, "nope")


def test_distinct_counts_of_awkward_values(spark):
    long_a, long_b = "x" * 500 + "a", "x" * 500 + "b"
    df = spark.createDataFrame(
        [(0.0, long_a, 2**60, True), (-0.0, long_b, 2**60 + 1, False), (1.5, long_a, 2**60, None)],
        "d double, s string, big long, flag boolean")
    assert rows(profile.distinct_counts(df), "column", "n_unique", "n_missing") == [
        ("big", 2, 0), ("d", 2, 0), ("flag", 2, 1), ("s", 2, 0)]
    near = profile.distinct_counts(df, rsd=0.05)
    assert rows(near, "column", "n_unique") == [("big", 2), ("d", 2), ("flag", 2), ("s", 2)]


def test_guard(spark):
    df = spark.createDataFrame([(1, 3), (2, 4)], "a long, b long")
    assert columns.require_table(df, min_rows=2, required=["a", "b"])
    with pytest.raises(ValueError, match=r"at least 5 row\(s\), found 2"):
        columns.require_table(df, min_rows=5)
    with pytest.raises(ValueError):
        columns.require_table(None)
    with pytest.raises(ValueError, match=r"at least 1 row\(s\), found 0"):
        columns.require_table(df.where("a > 5"))
    with pytest.raises(KeyError, match=r"\['x', 'y'\]"):
        columns.require_table(df, required=["y", "a", "x"])


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame(
        [(1.0, "Alice", "a@x", 25), (2.0, "Bob", "b@x", 30), (3.0, "Charlie", None, 28), (4.0, "David", "d@x", 35),
         (5.0, None, "e@x", 29), (None, "Frank", "f@x", 32)],
        "user_id double, user_name string, user_email string, age long")


def test_quality_demo(demo):
    got = rows(quality.completeness(demo), "column", "null_count", "null_percentage", "complete_count", "overall_completeness")
    assert got == [("age", 0, 0.0, 6, 87.5), ("user_email", 1, 16.67, 5, 87.5), ("user_id", 1, 16.67, 5, 87.5),
                   ("user_name", 1, 16.67, 5, 87.5)]
    assert rows(quality.consistency(demo), "column", "unique_values", "duplicate_count") == [
        ("age", 6, 0), ("user_email", 5, 1), ("user_id", 5, 1), ("user_name", 5, 1)]
    v = {r["column"]: r for r in quality.validity(demo, {"age": {"min": 0, "max": 150}}).collect()}
    assert (v["age"].valid_count, v["age"].invalid_count, v["age"].issues) == (6, 0, [])


def test_validity_messages_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (200.0,), (-5.0,)], "age double")
    r = quality.validity(df, {"age": {"min": 0, "max": 150}}).first()
    assert (r.valid_count, r.invalid_count) == (2, 2)
    assert r.issues == ["1 values below minimum 0", "1 values above maximum 150"]


def test_field_checks(demo):
    got = {r.field: r for r in quality.check_fields(demo, [
        {"name": "age", "type": "int"}, {"name": "user_id", "type": "int"}, {"name": "nope", "type": "int"},
        {"name": "user_name", "type": "str", "required": False}]).collect()}
    assert got["age"].status == "OK" and got["age"].issues == []
    assert got["user_id"].issues == ["Missing values: 1 (16.67%)", "Type mismatch: 5 values"]
    assert got["nope"].status == "FAIL" and got["nope"].issues == ["Column 'nope' not found"]
    assert got["user_name"].status == "OK" and got["user_name"].non_null_count == 5


def test_type_compliance_of_text(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", "2024-02-30"), (None, None)], "n string, t string")
    assert rows(quality.type_compliance(df, {"n": "int", "t": "datetime"}), "column", "mismatch_count") == [("n", 1), ("t", 2)]
    strict = quality.type_compliance(df, {"n": "int"}, parse_text=False)
    assert rows(strict, "column", "mismatch_count") == [("n", 2)]


def test_records(demo):
    issues = quality.issue_records(demo, ["age"], {"age": {"max": 30}}, required=["user_name"])
    assert rows(issues, "age", "column", "issue") == [
        (29, "user_name", "missing"), (32, "age", "above maximum"), (35, "age", "above maximum")]
    twice = demo.unionByName(demo.where("age = 25"))
    assert rows(quality.duplicate_records(twice), "age", "copies") == [(25, 2)]
    lookup = demo.where("age > 28").select("age")
    assert rows(quality.allowed_values(demo, "age", lookup), "value", "n") == [(25, 1), (28, 1)]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "a")], "`a.b` double, `c``d` string")
    assert rows(quality.completeness(df), "column", "complete_count") == [("a.b", 1), ("c`d", 1)]
    assert quality.report(df)["header"].select(F.col("total_columns")).first()[0] == 2
