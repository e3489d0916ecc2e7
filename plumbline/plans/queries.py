"""The registered queries: each operator over whole tables of the star schema.

Every callable takes (spark, folder) and returns a DataFrame; floating results
are rounded so that they can be compared with another engine's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import ref, require_table, rows_from
from plumbline.functions.ordering import shared_folder
from plumbline.plans import jobs
from plumbline.operators import (
    distributions, importance, outliers, profile, quality, segments, stattests, temporal)
from plumbline.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RULES = {
    "l_quantity": {"min": 3, "max": 45},
    "l_extendedprice": {"min": 2000.0},
    "l_returnflag": {"allowed": ["A", "N"]},
}
FIELDS = [
    {"name": "doc_id", "type": "int"},
    {"name": "quality", "type": "int"},
    {"name": "toxic", "type": "float", "required": False},
    {"name": "lang", "type": "int"},
    {"name": "source", "type": "str"},
    {"name": "author", "type": "str"},
]
TEXT_TYPES = {"text": "datetime", "url": "int"}
SEGMENT_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; most rows have none, so this table has missing values."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(ref(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else ref(f.name)
        for f in df.schema])


def _to_cents(df: DataFrame, cols: list[str]) -> DataFrame:
    """Amounts in the hundreds of millions, compared to the cent."""
    return df.withColumns({c: F.round(c, 2) for c in cols})


def _joined_issues(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", F.array_join("issues", "; "))


def _event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.series_rows(table(spark, folder, "events"), "ts", ["value"], ["event_id"])


def _monthly_rows(spark: SparkSession, folder: str) -> DataFrame:
    monthly = temporal.by_period(table(spark, folder, "orders"), "o_orderdate", "month", ["o_totalprice"])
    return temporal.series_rows(monthly, "period", ["o_totalprice_sum", "n_rows"])


def _scaled_lines(spark: SparkSession, folder: str) -> DataFrame:
    return segments.scaled(table(spark, folder, "lineitem"), SEGMENT_COLS, LINE_KEY)


def _labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    emb = table(spark, folder, "embeddings")
    return emb.select("vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("x"))


def _typed_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("text", F.lit(None).cast("string").alias("url"))
    pages = table(spark, folder, "pages").select(F.lit(None).cast("string").alias("text"), "url")
    return docs.unionByName(pages)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return segments.scaled(table(spark, folder, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


def _csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents, line breaks included, written as CSV with its gaps and read back with inferred types."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}.csv"
    (labelled_documents(spark, folder).write.option("header", True).option("nullValue", "NA").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_table(spark, path)


def _guarded(spark: SparkSession, folder: str) -> DataFrame:
    """Row count of a table that meets the guard's demands."""
    lines = table(spark, folder, "lineitem")
    require_table(lines, min_rows=2, min_cols=5, required=LINE_KEY)
    return lines.agg(F.count("*").alias("n_rows"))


def _written(spark: SparkSession, job: Callable[[str], dict], sections: dict[str, int], extra: dict[str, list[str]] | None = None) -> DataFrame:
    """A job's published sections, read back and told column by column: rows with a value, and their sum.

    ``sections``: digits to which a section's values are rounded first.  Texts and flags are told by the number of
    different values; times and nested columns are left out.
    """
    made, out = job(f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"), None
    for name, digits in sections.items():
        df = rounded(made[name], digits)
        cols = [f for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))
                and f.name not in (extra or {}).get(name, [])]
        told = df.agg(*[e for i, f in enumerate(cols) for e in (
            F.count(ref(f.name)).alias(f"n{i}"),
            (F.sum(ref(f.name).cast("double")) if isinstance(f.dataType, T.NumericType) else F.countDistinct(ref(f.name)).cast("double")).alias(f"t{i}"))])
        part = rows_from(told, [{"section": F.lit(name), "field": F.lit(f.name), "n": F.col(f"n{i}"), "total": F.round(F.col(f"t{i}"), 2)}
                                for i, f in enumerate(cols)])
        out = part if out is None else out.unionByName(part)
    return out


def registry() -> dict[str, Query]:
    q: dict[str, Query] = {}

    # sources and guard
    q["csv_round_trip"] = _csv_round_trip
    q["table_guard"] = _guarded

    # columns and profiles
    q["column_types"] = lambda s, d: profile.column_classes(table(s, d, "lineitem"))
    q["column_types_bool"] = lambda s, d: profile.column_classes(
        labelled_documents(s, d).select("doc_id", "lang", (F.col("quality") == 1).alias("good")))
    q["missing_values"] = lambda s, d: profile.missing_values(labelled_documents(s, d))
    q["table_summary"] = lambda s, d: profile.table_summary(labelled_documents(s, d))
    q["column_info"] = lambda s, d: profile.column_info(labelled_documents(s, d))
    q["column_info_lineitem"] = lambda s, d: profile.column_info(table(s, d, "lineitem"))

    # quality
    q["quality_completeness"] = lambda s, d: rounded(quality.completeness(labelled_documents(s, d)))
    q["quality_consistency"] = lambda s, d: rounded(quality.consistency(labelled_documents(s, d)))
    q["quality_validity"] = lambda s, d: _joined_issues(quality.validity(table(s, d, "lineitem"), RULES))
    q["quality_check_fields"] = lambda s, d: rounded(_joined_issues(quality.check_fields(labelled_documents(s, d), FIELDS)), 4)
    q["quality_type_compliance"] = lambda s, d: quality.type_compliance(_typed_text(s, d), TEXT_TYPES)
    q["quality_data_summary"] = lambda s, d: quality.data_summary(labelled_documents(s, d)).withColumn(
        "column_types", F.array_join(F.array_sort(F.transform(
            F.map_entries("column_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))
    q["quality_report_header"] = lambda s, d: quality.report(table(s, d, "lineitem"), "lineitem")["header"].drop("timestamp")
    q["quality_allowed_values"] = lambda s, d: quality.allowed_values(
        table(s, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    q["quality_allowed_values_lookup"] = lambda s, d: quality.allowed_values(
        table(s, d, "orders"), "o_custkey",
        table(s, d, "customer").where("c_acctbal >= 0").select("c_custkey"))
    q["quality_duplicate_records"] = lambda s, d: quality.duplicate_records(table(s, d, "documents"), ["text"]).select(
        F.md5("text").alias("text_md5"), "copies")
    q["quality_issue_records"] = lambda s, d: quality.issue_records(table(s, d, "lineitem"), LINE_KEY, RULES)
    q["quality_gates"] = lambda s, d: rounded(quality.gates(labelled_documents(s, d)))

    # distributions
    q["dist_numeric_summary"] = lambda s, d: rounded(distributions.numeric_summary(table(s, d, "lineitem"), LINE_NUMBERS), 4)
    q["dist_numeric_summary_missing"] = lambda s, d: rounded(distributions.numeric_summary(
        labelled_documents(s, d), ["n_chars", "quality", "toxic"]), 4)
    q["dist_frequencies"] = lambda s, d: rounded(distributions.frequencies(
        labelled_documents(s, d), ["lang", "source", "quality"]))
    q["dist_modes"] = lambda s, d: distributions.modes(labelled_documents(s, d), ["lang", "source", "quality"])
    q["dist_top_values"] = lambda s, d: rounded(distributions.top_values(table(s, d, "part"), ["p_brand", "p_name"], 10))
    q["dist_histogram"] = lambda s, d: rounded(distributions.histogram(table(s, d, "events"), ["value", "user_id"]))
    q["dist_density"] = lambda s, d: rounded(distributions.density(table(s, d, "events"), ["value"]), 6)
    q["dist_box_stats"] = lambda s, d: rounded(distributions.box_stats(table(s, d, "events"), ["value", "user_id"]), 4)
    q["dist_shape"] = lambda s, d: rounded(distributions.shape(table(s, d, "events"), ["value"]).drop("jarque_bera"), 6)
    q["dist_normality_jarque_bera"] = lambda s, d: rounded(
        distributions.shape(table(s, d, "supplier"), ["s_acctbal"]).select("column", "n", "jarque_bera", "jarque_bera_p"))
    q["dist_normality_ks"] = lambda s, d: rounded(distributions.normality_ks(table(s, d, "events"), ["value", "user_id"]))
    q["dist_normality_ks_small"] = lambda s, d: rounded(distributions.normality_ks(table(s, d, "supplier"), ["s_acctbal"]))
    q["dist_tails"] = lambda s, d: rounded(distributions.tails(table(s, d, "lineitem"), LINE_NUMBERS), 6)

    # outliers
    q["outliers_detect"] = lambda s, d: rounded(outliers.detect(table(s, d, "events")), 4)
    for method, keep in (("iqr", ["lower", "upper", "q1", "q3", "iqr"]), ("zscore", ["mean", "std"]), ("mad", ["median", "mad"])):
        q[f"outliers_{method}"] = lambda s, d, m=method, k=keep: rounded(outliers.detect(
            table(s, d, "lineitem"), LINE_NUMBERS, [m]).select("column", "n", "outlier_count", "outlier_percentage", *k), 4)
    q["outliers_column_statistics"] = lambda s, d: rounded(outliers.column_statistics(table(s, d, "events")), 4)
    q["outliers_rows"] = lambda s, d: outliers.flagged_rows(table(s, d, "events"), ["event_id"], ["value"])
    q["outliers_consensus"] = lambda s, d: outliers.consensus(table(s, d, "events"), ["event_id"], ["value", "user_id"])
    q["outliers_consensus_counts"] = lambda s, d: outliers.consensus_counts(table(s, d, "events"))
    q["outliers_summary"] = lambda s, d: outliers.summary(table(s, d, "events"), name="events")
    q["outliers_impact"] = lambda s, d: rounded(outliers.impact(table(s, d, "events"), ["value"]), 4)

    # hypothesis tests
    q["tests_group_sizes"] = lambda s, d: stattests.group_sizes(
        table(s, d, "events"), ["event_type"], ["value", "user_id"])
    q["tests_welch_t"] = lambda s, d: rounded(stattests.t_tests(
        table(s, d, "lineitem"), ["l_linestatus"], LINE_NUMBERS), 5)
    q["tests_mann_whitney"] = lambda s, d: rounded(stattests.mann_whitney(
        table(s, d, "lineitem"), ["l_linestatus"], LINE_NUMBERS), 5)
    q["tests_mann_whitney_named_groups"] = lambda s, d: rounded(stattests.mann_whitney(
        table(s, d, "customer"), ["c_mktsegment"], ["c_acctbal"], ["MACHINERY", "BUILDING"]), 5)
    q["tests_anova"] = lambda s, d: rounded(stattests.anova(
        table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], LINE_NUMBERS), 5)
    q["tests_chi_square"] = lambda s, d: rounded(stattests.chi_square(
        table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"]), 6)
    q["tests_chi_square_orders"] = lambda s, d: rounded(stattests.chi_square(
        table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]), 6)
    q["tests_chi_square_yates"] = lambda s, d: rounded(stattests.chi_square(
        labelled_documents(s, d), ["quality", "toxic"]), 6)
    q["tests_contingency"] = lambda s, d: stattests.contingency(
        table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    q["tests_run_all"] = lambda s, d: rounded(stattests.results_table(stattests.run_all(
        table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], LINE_NUMBERS)), 6)
    q["tests_all_statistics"] = lambda s, d: rounded(stattests.results_table(stattests.run_all(
        table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], LINE_NUMBERS)).select("test", "var1", "var2", "statistic"), 5)
    q["tests_significance_counts"] = lambda s, d: stattests.significance_counts(stattests.run_all(
        table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]))

    # time series
    q["series_index"] = lambda s, d: _event_rows(s, d)
    q["series_profile"] = lambda s, d: temporal.profile(table(s, d, "events"), "ts", ["value", "user_id"])
    q["series_trend"] = lambda s, d: rounded(temporal.trend(_event_rows(s, d)), 6)
    q["series_trend_monthly"] = lambda s, d: rounded(_to_cents(
        temporal.trend(_monthly_rows(s, d)), ["slope", "mean", "std", "min", "max"]), 6)
    q["series_changepoints"] = lambda s, d: rounded(temporal.changepoints(_event_rows(s, d)), 6)
    q["series_changepoint_rows"] = lambda s, d: rounded(temporal.changepoint_rows(_event_rows(s, d)), 6)
    q["series_first_changepoints"] = lambda s, d: rounded(temporal.first_changepoints(_event_rows(s, d)), 6)
    q["series_autocorrelation"] = lambda s, d: rounded(temporal.autocorrelation(_event_rows(s, d)), 8)
    q["series_significant_lags"] = lambda s, d: rounded(temporal.significant_lags(temporal.autocorrelation(_event_rows(s, d))), 8)
    q["series_partial_autocorrelation"] = lambda s, d: rounded(
        temporal.partial_autocorrelation(temporal.autocorrelation(_event_rows(s, d))), 8)
    q["series_stationarity"] = lambda s, d: rounded(temporal.stationarity(_event_rows(s, d)), 6)
    q["series_kpss"] = lambda s, d: rounded(temporal.kpss(_event_rows(s, d)), 8)
    q["series_decompose_additive"] = lambda s, d: rounded(temporal.decompose(_event_rows(s, d), 24), 6)
    q["series_decompose_multiplicative"] = lambda s, d: rounded(_to_cents(
        temporal.decompose(_monthly_rows(s, d), 12, "multiplicative"), ["value", "trend"]), 6)
    q["series_component_strengths"] = lambda s, d: rounded(temporal.component_strengths(
        temporal.decompose(_event_rows(s, d), 24)), 6)
    q["series_by_period"] = lambda s, d: rounded(temporal.by_period(table(s, d, "events"), "ts", "hour", ["value"]), 4)
    q["series_by_window"] = lambda s, d: rounded(temporal.by_window(
        table(s, d, "events"), "ts", "1 day", "6 hours", ["value"]), 6)
    q["series_missing_periods"] = lambda s, d: temporal.missing_periods(table(s, d, "orders"), "o_orderdate", "day")
    q["series_interval_stats"] = lambda s, d: rounded(temporal.interval_stats(table(s, d, "events"), "ts"), 4)
    q["series_analyze_overview"] = lambda s, d: temporal.overview(temporal.analyze(
        table(s, d, "events"), "ts", ["value"], 24, ["event_id"]))

    # segments
    q["segments_scaled"] = lambda s, d: rounded(_scaled_lines(s, d).select(
        *LINE_KEY, *[F.col("x")[i].alias(f"z{i}") for i in range(3)]), 5)
    q["segments_kmeans"] = lambda s, d: rounded(segments.kmeans(_scaled_lines(s, d)).select(*LINE_KEY, "cluster", "distance"))
    q["segments_elbow"] = lambda s, d: rounded(segments.elbow(_scaled_lines(s, d)), 3)
    q["segments_hierarchical"] = lambda s, d: segments.hierarchical(_scaled_lines(s, d)).select(*LINE_KEY, "cluster")
    q["segments_dbscan"] = lambda s, d: segments.density_clusters(
        _parts(s, d), ["p_partkey"], 0.1, 5).select("p_partkey", "cluster")
    q["segments_dbscan_six_axes"] = lambda s, d: segments.density_clusters(table(s, d, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 6).cast("array<double>").alias("x")), ["vec_id"], 0.12, 4).select("vec_id", "cluster")
    q["segments_cluster_summary"] = lambda s, d: rounded(segments.cluster_summary(
        table(s, d, "lineitem"), "l_returnflag", LINE_NUMBERS), 4)
    q["segments_silhouette"] = lambda s, d: rounded(segments.silhouette_points(_labelled_vectors(s, d), ["vec_id"]), 6)
    q["segments_silhouette_squared"] = lambda s, d: table(s, d, "embeddings").agg(F.count("*").alias("n")).withColumn(
        "silhouette", F.round(F.lit(segments.silhouette_squared(_labelled_vectors(s, d))), 6))
    q["segments_davies_bouldin"] = lambda s, d: rounded(segments.davies_bouldin(_labelled_vectors(s, d)))
    q["segments_quality"] = lambda s, d: rounded(segments.quality(_labelled_vectors(s, d), "label", ["vec_id"], measure="euclidean"))
    q["segments_pca"] = lambda s, d: rounded(segments.project(segments.scaled(
        table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], LINE_KEY)), 5)
    q["segments_pca_variance"] = lambda s, d: rounded(segments.explained_variance(segments.scaled(
        table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"])))
    q["segments_distant_points"] = lambda s, d: rounded(segments.distant_points(
        segments.kmeans(_scaled_lines(s, d)), LINE_KEY))
    # whole jobs, from what they published
    q["job_quality"] = lambda s, d: _written(s, lambda out: jobs.quality_job(s, labelled_documents(s, d), out), {"completeness": 6, "consistency": 6})
    q["job_distributions"] = lambda s, d: _written(s, lambda out: jobs.distributions_job(
        s, table(s, d, "lineitem").select(*LINE_NUMBERS, "l_returnflag", "l_linestatus"), out, "parquet"),
        {"numeric_summary": 4, "frequencies": 6, "modes": 6})
    q["job_outliers"] = lambda s, d: _written(s, lambda out: jobs.outliers_job(s, f"{d}/events.parquet", out), {
        "column_statistics": 4, "outliers": 4, "summary": 4, "consensus": 4})
    q["job_tests"] = lambda s, d: _written(s, lambda out: jobs.tests_job(
        s, table(s, d, "lineitem"), out, ["l_returnflag", "l_linestatus"], LINE_NUMBERS), {"ttest": 5, "mannwhitney": 5, "anova": 5, "chi2": 6, "significant": 6})
    q["job_series"] = lambda s, d: _written(s, lambda out: jobs.temporal_job(
        s, f"{d}/events.parquet", "ts", out, 24, ["value"], ["event_id"]),
        {"profile": 6, "autocorrelation": 8, "significant_acf": 8, "significant_pacf": 8, "trend": 6, "changepoints": 6, "first_changepoints": 6})
    q["job_segments"] = lambda s, d: _written(s, lambda out: jobs.segments_job(
        s, table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), out, ["p_partkey"], fmt="parquet"),
        {"labels_kmeans": 6, "labels_hierarchical": 6, "pca_variance": 6}, {"labels_kmeans": ["row_number", "cluster"], "labels_hierarchical": ["row_number", "cluster"]})
    q["series_decompose_table"] = lambda s, d: rounded(temporal.decompose_table(table(s, d, "events"), "ts", ["value"], 24, ["event_id"], models=["additive"]), 6)
    q["feature_importance"] = lambda s, d: rounded(importance.forest_importance(
        table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_partkey"]))
    return q
