"""Reading tables: Parquet as it is, CSV with missing-value tokens and inferred types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import ref
from plumbline.sources.csv_records import records

# Texts that mean "missing" in a CSV file
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Texts that mean true or false
TRUE_TOKENS, FALSE_TOKENS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]

_WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def _raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All fields as text; names as Spark's own reader gives them from the first header."""
    names = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    fields = F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE"})
    return records(spark, path).where("not head").select(fields.alias("fields")).select(
        *[F.col("fields").getField(n).alias(n) for n in names])


def read_csv(spark: SparkSession, path: str, infer: bool = True, na_tokens: list[str] | None = None) -> DataFrame:
    """CSV with a header; missing tokens become null, then columns are typed in one pass.

    Whole numbers without gaps become bigint, other numbers double (a whole-number
    column with gaps too), true/false without gaps boolean; the rest, dates
    included, stays text.  Line breaks inside quotes are kept, and files are split over tasks all the same.
    """
    text = _raw_csv(spark, path)
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    text = text.select(*[F.when(~ref(c).isin(tokens), ref(c)).alias(c) for c in text.columns])
    if not infer:
        return text
    flags = text.columns
    row = text.agg(*[e for i, c in enumerate(flags) for e in (
        F.count_if(ref(c).isNull()).alias(f"missing{i}"),
        F.count_if(ref(c).isNotNull() & (ref(c).try_cast("double").isNull() | ref(c).rlike("(?i)[df]\\s*$"))).alias(f"text{i}"),
        F.count_if(ref(c).isNotNull() & (~ref(c).rlike(_WHOLE) | ref(c).try_cast("bigint").isNull())).alias(f"broken{i}"),
        F.count_if(ref(c).isNotNull() & ~ref(c).isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"other{i}"),
        F.count(ref(c)).alias(f"filled{i}"))]).first()

    def typed(i: int, c: str) -> Column:
        if row[f"filled{i}"] == 0:
            return ref(c).cast("double")
        if row[f"text{i}"] == 0:
            whole = row[f"broken{i}"] == 0 and row[f"missing{i}"] == 0
            return ref(c).try_cast("bigint" if whole else "double")
        if row[f"other{i}"] == 0 and row[f"missing{i}"] == 0:
            return ref(c).isin(TRUE_TOKENS)
        return ref(c)

    return text.select(*[typed(i, c).alias(c) for i, c in enumerate(flags)])


def read_table(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """A table by its ending: ``.csv`` (also compressed) or Parquet. A missing path raises."""
    name = path.lower().rstrip("/")
    if name.endswith((".csv", ".csv.gz", ".csv.bz2")):
        return read_csv(spark, path, **csv_options)
    return spark.read.parquet(path)
