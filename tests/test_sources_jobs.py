import json
import os
import random

import pytest

from conftest import DATA
from plumbline.plans import jobs
from plumbline.sources import readers
from plumbline.sources.csv_records import inside_after
from plumbline.sources.readers import read_csv, read_table
from plumbline.sources.writers import finished_runs, read_report, write_report


def test_csv_types_and_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('whole,gap,real,flag,text,date,empty\n1,1,1.5,True,"a ""q"", b",2024-01-01,\n'
                    "2,NA,nan,False,n/a,2024-01-02,\n-3,3,2e3,True,NULLS,2024-01-03,\n")
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"whole": "bigint", "gap": "double", "real": "double", "flag": "boolean",
                               "text": "string", "date": "string", "empty": "double"}
    rows = df.collect()
    assert [r.text for r in rows] == ['a "q", b', None, "NULLS"]
    assert [r.gap for r in rows] == [1.0, None, 3.0] and [r.real for r in rows] == [1.5, None, 2000.0]
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path / "none.csv"))


def test_reports_are_published(spark, tmp_path):
    out = str(tmp_path / "q")
    made = jobs.quality_job(spark, f"{DATA}/supplier.parquet", out, {"s_acctbal": {"min": 0}})
    read = read_report(spark, out)
    assert set(read) == set(made) and read["header"].first().dataset_name == "supplier"
    assert read["completeness"].count() == 4
    run = finished_runs(spark, out).first().run
    shown = [json.loads(line) for name in os.listdir(f"{out}/{run}/validity") if name.endswith(".json") for line in open(f"{out}/{run}/validity/{name}")]
    assert len(shown) == made["validity"].count() and "issues" in shown[0]  # fields without a value are there too
    out = str(tmp_path / "o")
    jobs.outliers_job(spark, f"{DATA}/events.parquet", out, ["event_id"], fmt="parquet")
    assert read_report(spark, out)["consensus"].columns == ["event_id", "column", "value"]
    out = str(tmp_path / "t")
    jobs.tests_job(spark, spark.read.parquet(f"{DATA}/customer.parquet"), out, ["c_mktsegment"], ["c_acctbal"])
    assert read_report(spark, out)["anova"].count() == 1
    out = str(tmp_path / "d")
    jobs.distributions_job(spark, f"{DATA}/supplier.parquet", out)
    assert read_report(spark, out)["numeric_summary"].count() == 3


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_readers_see_finished_runs_only(spark, tmp_path, fmt):
    out, rows = str(tmp_path), spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "k long, t string, x double")
    with pytest.raises(ValueError, match="no finished run"):
        read_report(spark, out)
    first = write_report({"one": rows, "none": rows.limit(0)}, out, fmt)

    def fail(batches):
        raise RuntimeError("an executor's task that fails for good")
        yield

    with pytest.raises(Exception, match="fails for good"):
        write_report({"one": rows.limit(1), "two": rows.mapInArrow(fail, rows.schema)}, out, fmt)
    assert [r.run for r in finished_runs(spark, out).select("run").distinct().collect()] == [first]
    read = read_report(spark, out)
    assert sorted(read["one"].collect()) == sorted(rows.collect()) and read["one"].schema == rows.schema and read["none"].count() == 0
    second = write_report({"one": rows.limit(1)}, out, fmt)
    assert read_report(spark, out)["one"].count() == 1 and read_report(spark, out, first)["one"].count() == 2 and first != second
    rows.limit(1).write.mode("append").format(fmt).save(f"{out}/{second}/one")
    with pytest.raises(ValueError, match="lost rows"):
        read_report(spark, out)
    with pytest.raises(ValueError, match="manifest"):
        write_report({"manifest": rows}, out, fmt)
    with pytest.raises(ValueError, match="format"):
        write_report({"one": rows}, out, "text")


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('id,note,n\n1,"a\nb",3\n2,plain,4\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).collect()] == [(1, "a\nb", 3), (2, "plain", 4)]


def wild_csv(rng, rows, end):
    """Fields with quotes, doubled quotes, commas, line breaks and stray quotes; empty lines between records."""
    def field():
        text = "".join(rng.choice(["a", "é", ",", "\n", '""', " ", "\n\n", "x" * 30]) for _ in range(rng.randint(0, 9)))
        kind = rng.random()
        if kind < 0.5:
            return f'"{text}"'
        return rng.choice(["plain", "7", "", 'in "the" middle', "it's", "end\""]) if kind < 0.9 else '"' + "long line\n" * rng.randint(5, 40) + '"'

    return end.join(["id,one,two", *(f"{i},{field()},{field()}" + (end if rng.random() < 0.1 else "") for i in range(rows))]) + rng.choice(["", end])


@pytest.mark.parametrize("seed,size", [(0, 40), (1, 64), (2, 200), (3, 1000), (4, 100_000)])
def test_csv_split_anywhere_equals_one_task(spark, tmp_path, seed, size):
    """Splits of any size, inside quotes and across whole records, give what Spark's reader gives in one task per file."""
    rng = random.Random(seed)
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.csv").write_bytes(wild_csv(rng, 60, "\r\n" if name == "c" and seed % 2 else "\n").encode())
    (tmp_path / "empty.csv").write_text("id,one,two\n")
    path = str(tmp_path)
    want = spark.read.csv(path, header=True, multiLine=True, escape='"').collect()
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    shared = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        raw = readers._raw_csv(spark, path)
        tasks = raw.rdd.getNumPartitions()
        got = raw.collect()
    finally:
        for k, v in shared.items():
            spark.conf.set(k, v)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) >= 170
    assert size > 1000 or tasks > 10


def test_open_field_at_the_end_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x\n1,"never closed\n2,b\n')
    (tmp_path / "b.csv").write_text('id,x\n3,c\n')
    got = sorted(r.id for r in readers._raw_csv(spark, str(tmp_path)).collect())
    assert got == ["1", "3"]


@pytest.mark.parametrize("line,outside,inside", [
    ('a,b', False, True), ('"a', True, False), ('a,"b', True, False), ('"a""', True, False), ('"a"",b"', False, True), ('a"b', False, False), ('', False, True),
    ('"a",b,"c', True, False), ('","', False, True), ('""', False, True), ('"""', True, True), (',"', True, False)])
def test_quote_states(line, outside, inside):
    def plain(open_):
        field_start, i = True, 0
        while i < len(line):
            c = line[i]
            if open_:
                if c == '"' and line[i + 1: i + 2] == '"':
                    i += 1
                elif c == '"':
                    open_, field_start = False, False
            elif c == '"' and field_start:
                open_ = True
            else:
                field_start = c == ","
            i += 1
        return open_

    assert inside_after(line, False) == plain(False) and inside_after(line, True) == plain(True)
    assert plain(False) == outside


def test_jobs_without_keys_or_numbers(spark):
    table = spark.read.parquet(f"{DATA}/supplier.parquet")
    found = jobs.segments_job(spark, table.unionByName(table))
    assert found["labels_kmeans"].count() == 2 * table.count()
    assert found["labels_kmeans"].columns == ["row_number", "cluster"]
    assert jobs.outliers_job(spark, table.select("s_name")) == {}


def test_series_without_values_keep_their_line(spark):
    df = spark.createDataFrame([(f"2024-01-{i:02d}", float(i % 7), None) for i in range(1, 29)], "t string, v double, none double")
    found = jobs.temporal_job(spark, df, "t", None, 7)
    for section in ("trend", "changepoints", "stationarity", "overview"):
        assert {r.series for r in found[section].collect()} == {"v", "none"}
    row = found["trend"].where("series = 'none'").first()
    assert row.n_obs == 0 and row.status == "insufficient_data" and row.slope is None


def test_temporal_and_segment_jobs(spark, tmp_path):
    out = str(tmp_path / "s")
    jobs.temporal_job(spark, f"{DATA}/events.parquet", "ts", out, 24, ["value"], ["event_id"])
    read = read_report(spark, out)
    assert read["overview"].first().series == "value"
    assert json.loads(read["header"].first().configuration)["acf_max_lags"] == 40
    out = str(tmp_path / "g")
    table = spark.read.parquet(f"{DATA}/supplier.parquet").drop("s_name")
    jobs.segments_job(spark, table, out, ["s_suppkey"])
    assert sum(r["size"] for r in read_report(spark, out)["cluster_summary"].collect()) == 2 * table.count()


def test_segments_job_deals_a_small_file_to_many_tasks(spark, monkeypatch):
    class Seen(Exception):
        pass

    def look(numbered, cols, keys):
        assert len(numbered.inputFiles()) > 1 and numbered.select("row_number").distinct().count() == 300_000
        assert numbered.select("row.*").columns == ["k", "a", "b"] and cols == ["a", "b"]
        raise Seen

    monkeypatch.setattr(jobs.segments, "scaled", look)
    source = spark.range(300_000).coalesce(1).selectExpr("id as k", "rand(1) as a", "'long' as text", "rand(2) as b")
    with pytest.raises(Seen):
        jobs.segments_job(spark, source, key_cols=["k"])
