"""Whole-report jobs: read a table, run every section of one analysis, write the report.

``source`` is a path or a DataFrame.  Each job returns its sections; with an
``output`` folder they are published there as a new run, and the sections
returned are those read back from it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import settings
from plumbline.functions.columns import categorical_columns, numeric_columns, ref, require_table
from plumbline.functions.ordering import stage_table
from plumbline.operators import distributions, outliers, quality, segments, stattests, temporal
from plumbline.sources.readers import read_table
from plumbline.sources.writers import header, read_report, write_report

Sections = dict[str, DataFrame]


def _open(spark: SparkSession, source: str | DataFrame) -> tuple[DataFrame, str]:
    if isinstance(source, DataFrame):
        df, name = source, "dataset"
    else:
        df, name = read_table(spark, source), source.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    require_table(df)
    return df, name


def _finish(sections: Sections, output: str | None, fmt: str) -> Sections:
    if not output or not sections:
        return sections
    spark = next(iter(sections.values())).sparkSession
    return read_report(spark, output, write_report(sections, output, fmt))


def quality_job(spark: SparkSession, source: str | DataFrame, output: str | None = None,
                rules: Mapping[str, Mapping[str, Any]] | None = None, fmt: str = "json") -> Sections:
    """Completeness, consistency, validity and summary."""
    df, name = _open(spark, source)
    return _finish(quality.report(df, name, rules), output, fmt)


def distributions_job(spark: SparkSession, source: str | DataFrame, output: str | None = None,
                      fmt: str = "json") -> Sections:
    """Summaries, frequencies, and the tables behind histogram, density, box and bar plots."""
    df, name = _open(spark, source)
    numeric = numeric_columns(df)
    categorical = categorical_columns(df)
    sections: Sections = {"header": header(spark, {"bins": "auto"}, dataset_name=name)}
    if numeric:
        sections |= {"numeric_summary": distributions.numeric_summary(df, numeric),
                     "histogram": distributions.histogram(df, numeric), "density": distributions.density(df, numeric),
                     "box": distributions.box_stats(df, numeric)}
    if categorical:
        sections |= {"frequencies": distributions.frequencies(df, categorical),
                     "modes": distributions.modes(df, categorical)}
    return _finish(sections, output, fmt)


def outliers_job(spark: SparkSession, source: str | DataFrame, output: str | None = None,
                 key_cols: Sequence[str] = (), methods: Sequence[str] | None = None, fmt: str = "json") -> Sections:
    """Counts per column and method, the flagged and the agreed rows, and the summary.

    The statistics are measured once and shared by all sections.
    """
    df, name = _open(spark, source)
    if not [c for c in numeric_columns(df) if c not in key_cols]:
        return _finish({}, output, fmt)  # a table of texts has no sections
    stats = outliers.measure(df, [c for c in numeric_columns(df) if c not in key_cols])
    return _finish({
        "column_statistics": outliers.column_statistics(df, stats=stats),
        "outliers": outliers.detect(df, methods=methods, stats=stats),
        "outlier_rows": outliers.flagged_rows(df, key_cols, methods=methods, stats=stats),
        "consensus": outliers.consensus(df, key_cols, methods=methods, stats=stats),
        "summary": outliers.summary(df, methods=methods, stats=stats, name=name),
    }, output, fmt)


def segments_job(spark: SparkSession, source: str | DataFrame, output: str | None = None,
                 key_cols: Sequence[str] = (), n_clusters: int = settings.CLUSTERS, fmt: str = "json") -> Sections:
    """Elbow table, three clusterings with their quality, k-means summary and projection.

    Rows get a number of their own (``row_number``, kept by a staged copy), so keys may repeat or be left out; the
    points carry keys and raw numbers along, so nothing is joined back.  The copy is dealt out by that number: every pass
    reads it, and a small file would give them one task.
    """
    df, name = _open(spark, source)
    cols = [c for c in numeric_columns(df) if c not in key_cols]
    carried = [ref(c) for c in dict.fromkeys([*key_cols, *cols])] or [F.lit(None).alias("none")]
    numbered = stage_table(df.select(F.monotonically_increasing_id().alias("row_number"), F.struct(*carried).alias("row"),
                                     *[ref(c) for c in cols]).repartition("row_number"))
    points = segments.scaled(numbered, cols, ["row_number", "row"])
    labels, quality_rows = segments.cluster(points, ["row_number"], n_clusters)
    labelled = labels["kmeans"].select("row.*", "cluster")
    shown = [F.col("row_number"), *[F.col("row")[k].alias(k) for k in key_cols]]
    sections = {
        "header": header(spark, {
            "default_n_clusters": settings.CLUSTERS, "pca_n_components": settings.PCA_COMPONENTS,
            "silhouette_min_score": settings.GOOD_SILHOUETTE, "random_state": settings.SEED},
            dataset_name=name, numeric_features=len(cols), n_clusters=n_clusters),
        "elbow": segments.elbow(points),
        "quality": quality_rows,
        "cluster_summary": segments.cluster_summary(labelled, "cluster", cols),
        "pca": segments.project(labels["kmeans"].select(*shown, "cluster", "x")),
        "pca_variance": segments.explained_variance(points),
    }
    for method, rows in labels.items():
        sections[f"labels_{method}"] = rows.select(*shown, "cluster")
    return _finish(sections, output, fmt)


def tests_job(spark: SparkSession, source: str | DataFrame, output: str | None = None,
              cats: Sequence[str] | None = None, nums: Sequence[str] | None = None, fmt: str = "json") -> Sections:
    """Every applicable hypothesis test and the count of significant ones."""
    df, name = _open(spark, source)
    results = {name: stage_table(table) for name, table in stattests.run_all(df, cats, nums).items()}  # one line per test
    return _finish({
        "header": header(spark, {"alpha": settings.ALPHA, "min_group_size": settings.GROUP_SIZE_SETTING},
                         dataset_name=name),
        **results, "group_sizes": stattests.group_sizes(df, cats, nums),
        "significant": stattests.significance_counts(results)}, output, fmt)


def temporal_job(spark: SparkSession, source: str | DataFrame, time_col: str, output: str | None = None,
                 period: int = settings.SEASONAL_PERIOD, value_cols: Sequence[str] | None = None,
                 key_cols: Sequence[str] = (), fmt: str = "json") -> Sections:
    """All time-series sections and one overview line per series."""
    df, name = _open(spark, source)
    sections = temporal.analyze(df, time_col, value_cols, period, key_cols)
    return _finish({
        "header": header(spark, {
            "default_seasonal_period": settings.SEASONAL_PERIOD, "acf_max_lags": settings.ACF_LAGS,
            "adf_autolag": "AIC", "kpss_regression": "c"}, dataset_name=name, period=period),
        **sections, "overview": temporal.overview(sections)}, output, fmt)
