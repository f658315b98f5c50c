import json
import math

import pytest

from fareline.operators.reporting import (
    backend_medians,
    model_scores,
    operation_by_backend,
    recorded_status,
    run_status,
    timing_statistics,
)
from fareline.sources.records import load_results, write_csv, write_records


def record(backend, operation, seconds, **more):
    base = {
        "backend": backend,
        "mode": "standard",
        "operation": operation,
        "dataset": "small",
        "input_rows": 100,
        "repeat": 0,
        "status": "ok",
        "seconds": seconds,
        "reason": "",
        "warnings": [],
        "validated": True,
    }
    return {**base, **more}


SKIPPED = {
    "backend": "spark",
    "mode": "standard",
    "operation": "complex",
    "dataset": "small",
    "input_rows": 100,
    "status": "skipped",
    "reason": "source lacks coordinates",
}


@pytest.fixture
def results(spark, tmp_path):
    spark_run = {
        "metadata": {"backend": "spark", "dataset": "small.parquet", "backend_status": "completed"},
        "measurements": [
            record("spark", "mean", 1.0, warnings=["b", "a"]),
            record("spark", "mean", 2.0, repeat=1),
            record("spark", "mean", 4.0, repeat=2),
            record("spark", "mean", 10.0, repeat=3),
            record("spark", "read_construct", 0.1, validated=False),
            SKIPPED,
        ],
    }
    pandas_run = {
        "metadata": {
            "backend": "pandas",
            "dataset": "small.parquet",
            "backend_status": "completed_with_errors",
            "reason": "MemoryError: x",
        },
        "measurements": [
            record("pandas", "std", 3.0),
            record("pandas", "mean", None, status="error", reason="boom"),
        ],
    }
    model = {
        "dataset": "small.parquet",
        "stage": "pickup",
        "regression": {"rmse": 7.7, "mae": 5.0, "best_params": {"max_depth": 3}},
        "classification": {"macro_f1": 0.45},
    }
    documents = {"a.json": spark_run, "b.json": pandas_run, "m.json": model}
    for name, document in documents.items():
        (tmp_path / name).write_text(json.dumps(document, indent=2) + "\n")
    (tmp_path / "notes.txt").write_text("not a document")
    return load_results(spark, str(tmp_path))


def test_documents_are_told_apart(results):
    assert results.runs.count() == 2
    assert results.models.count() == 1
    assert results.measurements.count() == 8
    files = {row.source_file for row in results.measurements.collect()}
    assert files == {"a.json", "b.json"}
    skipped = results.measurements.where("status = 'skipped'").first()
    assert (skipped.seconds, skipped.repeat, skipped.warnings) == (None, None, None)


def test_timing_statistics(results):
    rows = {(r.backend, r.operation): r for r in timing_statistics(results.measurements).collect()}
    assert set(rows) == {("spark", "mean"), ("pandas", "std")}
    mean = rows["spark", "mean"]
    assert (mean.median_seconds, mean.min_seconds, mean.max_seconds, mean.repeats) == (3, 1, 10, 4)


def test_pivot_keeps_missing_cells_missing(results):
    table = operation_by_backend(results.measurements, ["pandas", "spark"])
    assert table.columns == ["dataset", "mode", "operation", "pandas", "spark"]
    cells = {row.operation: (row.pandas, row.spark) for row in table.collect()}
    assert cells == {"mean": (None, 3.0), "std": (3.0, None)}


def test_backend_medians_are_sorted(results):
    rows = backend_medians(timing_statistics(results.measurements)).collect()
    assert [row.backend for row in rows] == ["pandas", "spark"]


def test_status_tables(results):
    derived = {row.backend: row.status for row in run_status(results.measurements).collect()}
    assert derived == {"spark": "completed", "pandas": "completed_with_errors"}
    rows = recorded_status(results.runs).collect()
    stated = {row.backend: (row.status, row.reason) for row in rows}
    assert stated == {
        "spark": ("completed", ""),
        "pandas": ("completed_with_errors", "MemoryError: x"),
    }


def test_model_scores(results):
    row = model_scores(results.models).first()
    assert (row.file, row.stage, row.rmse, row.mae, row.macro_f1) == (
        "m.json",
        "pickup",
        7.7,
        5.0,
        0.45,
    )


def test_json_lines_round_trip(spark, results, tmp_path):
    path = str(tmp_path / "lines")
    write_records(results.runs.select("metadata", "measurements"), path)
    again = load_results(spark, path, multi_line=False)
    before = sorted(map(str, results.measurements.drop("source_file").collect()))
    assert sorted(map(str, again.measurements.drop("source_file").collect())) == before
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_records(results.runs.select("metadata"), path)


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
@pytest.mark.parametrize(
    "schema", ["v double", "v struct<x: double>", "v array<double>", "v map<string, double>"]
)
def test_unwritable_numbers_are_refused(spark, tmp_path, bad, schema):
    value = {"d": bad, "s": (bad,), "a": [1.0, bad], "m": {"k": bad}}[schema[2]]
    df = spark.createDataFrame([(value,)], schema)
    with pytest.raises(Exception, match="NaN and infinity"):
        write_records(df, str(tmp_path / "bad"))


def test_missing_numbers_are_written_as_null(spark, tmp_path):
    path = tmp_path / "nulls"
    write_records(spark.createDataFrame([(1, None)], "a int, b double").coalesce(1), str(path))
    text = "".join(part.read_text() for part in path.glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": None}


def test_csv_flattens_lists(spark, results, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(results.measurements.coalesce(1), path)
    rows = spark.read.option("header", True).csv(path)
    assert rows.columns == results.measurements.columns
    assert rows.where("repeat = 0 AND seconds = 1.0").first().warnings == "b; a"
