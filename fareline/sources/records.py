"""Result documents (JSON) and result tables (CSV)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASUREMENT = (
    "struct<backend:string, mode:string, operation:string, dataset:string, input_rows:bigint,"
    " repeat:int, status:string, seconds:double, reason:string, warnings:array<string>,"
    " validated:boolean>"
)
METADATA = (
    "struct<backend:string, workers:int, dataset:string, dataset_sha256:string, rows:bigint,"
    " repeats:int, protocol:string, startup_seconds:double, cache_setup_seconds:double,"
    " backend_status:string, reason:string>"
)
REGRESSION = (
    "struct<rmse:double, mae:double, r2:double, baseline_mae:double,"
    " best_params:map<string,double>, cv_rmse:double>"
)
CLASSIFICATION = (
    "struct<accuracy:double, macro_precision:double, macro_recall:double, macro_f1:double,"
    " baseline_accuracy:double, best_params:map<string,double>>"
)
# Field names and types of result documents (above and below).
# Run documents fill the first two columns, model documents the others.
DOCUMENT = (
    f"metadata {METADATA}, measurements array<{MEASUREMENT}>, dataset string, sha256 string,"
    " stage string, raw_rows bigint, train_rows bigint, test_rows bigint, features array<string>,"
    " train_end string, test_start string, timings map<string,double>,"
    f" regression {REGRESSION}, classification {CLASSIFICATION}, validation string"
)


@dataclass(frozen=True)
class Results:
    """Documents told apart, and the measurement records of all run documents."""

    runs: DataFrame
    measurements: DataFrame
    models: DataFrame


def load_results(spark: SparkSession, path: str, multi_line: bool = True) -> Results:
    """Read result documents: one per file, or one per line with ``multi_line=False``."""
    reader = spark.read.schema(DOCUMENT).option("multiLine", multi_line)
    documents = reader.option("pathGlobFilter", "*.json").json(path)
    documents = documents.withColumn("source_file", F.col("_metadata.file_name"))
    runs = documents.where(F.col("measurements").isNotNull())
    models = documents.where(F.col("measurements").isNull() & F.col("regression").isNotNull())
    records = runs.select("source_file", F.inline("measurements"))
    return Results(
        runs.select("source_file", "metadata", "measurements"),
        records,
        models.drop("metadata", "measurements"),
    )


def unwritable(value: Column, kind: T.DataType) -> Column | None:
    """Condition under which ``value`` holds a number JSON cannot express."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number = value.cast("double")
        return F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    if isinstance(kind, T.StructType):
        inner = [unwritable(value[f.name], f.dataType) for f in kind.fields]
        found = [condition for condition in inner if condition is not None]
        return F.greatest(*found, F.lit(False)) if found else None
    if isinstance(kind, T.ArrayType):
        if unwritable(F.lit(None), kind.elementType) is None:
            return None
        return F.exists(value, lambda item: F.coalesce(
            unwritable(item, kind.elementType), F.lit(False)
        ))
    if isinstance(kind, T.MapType):
        return unwritable(F.map_values(value), T.ArrayType(kind.valueType))
    return None


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines. NaN and infinity are refused while writing; an existing target is refused."""
    checks = [unwritable(F.col(field.name), field.dataType) for field in df.schema.fields]
    for condition in [check for check in checks if check is not None]:
        message = F.lit("NaN and infinity cannot be written as JSON")
        df = df.where(F.when(condition, F.raise_error(message).cast("boolean")).otherwise(True))
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def flat_text(df: DataFrame) -> DataFrame:
    """Lists of plain values become text joined by '; ', other nested values JSON text: CSV has
    flat columns only."""

    def flat(field: T.StructField) -> Column:
        kind = field.dataType
        nested = (T.ArrayType, T.MapType, T.StructType)
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, nested):
            return F.concat_ws("; ", field.name).alias(field.name)
        if isinstance(kind, nested):
            return F.to_json(field.name).alias(field.name)
        return F.col(field.name)

    return df.select(*[flat(field) for field in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    flat_text(df).write.mode("errorifexists").option("header", True).csv(path)
