"""Trip tables: scan, canonical names and types, availability of operations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareline.functions.trips import without_nan

# Raw column name -> canonical column name.
ALIASES = {
    "tpep_pickup_datetime": "pickup_datetime",
    "fare_amount": "fare_amt",
    "tip_amount": "tip_amt",
    "trip_distance": "trip_distance",
    "passenger_count": "passenger_count",
    "pickup_longitude": "start_lon",
    "pickup_latitude": "start_lat",
    "dropoff_longitude": "end_lon",
    "dropoff_latitude": "end_lat",
    "PULocationID": "pickup_zone",
    "DOLocationID": "dropoff_zone",
}
# Columns every trip table must have, and the optional coordinate columns.
REQUIRED = ("fare_amt", "tip_amt", "passenger_count", "trip_distance", "pickup_datetime")
COORDINATES = ("start_lon", "start_lat", "end_lon", "end_lat")

MOMENT = "pickup_datetime"

#: File footers that are asked for at the same time.
FOOTER_THREADS = 8


def load_trips(
    spark: SparkSession, *paths: str, schema: T.StructType | None = None
) -> DataFrame:
    """Scan one or more Parquet paths as one table.

    Spark splits the files by ``spark.sql.files.maxPartitionBytes`` and reads only the columns and
    row groups the query needs, so nothing is selected here. With a known ``schema`` no file footer
    is read to plan the query, which otherwise costs a job per load.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def row_identity(roots: Sequence[str] = ()) -> Column:
    """Identity of a row in a file source without a key: file and position in the file.

    The file counts by its path below one of ``roots`` (the paths that were read), with the number
    of the root, so equal file names in several folders differ, and moving a whole root changes
    nothing. Without roots the full path counts. Usable directly on a file scan only.
    """
    path = F.col("_metadata.file_path")
    file = path
    for number, root in enumerate(roots):
        name = root.rstrip("/")
        at = F.locate(quote(name, safe="/:"), path)
        found = F.substring(path, at + len(quote(name, safe="/:")), F.length(path))
        file = F.when(at > 0, F.concat(F.lit(f"{number}"), found)).otherwise(file)
    return F.concat_ws("|", file, F.col("_metadata.row_index"))


def missing_required(columns: Iterable[str]) -> list[str]:
    return sorted(set(REQUIRED) - set(columns))


def has_coordinates(columns: Iterable[str]) -> bool:
    return set(COORDINATES) <= set(columns)


def renamed_trips(
    df: DataFrame, aliases: Mapping[str, str] = ALIASES, keep: Iterable[str] = ()
) -> DataFrame:
    """Columns with a canonical name, plus ``keep``; every other column is dropped from the scan."""
    known = [F.col(raw).alias(aliases[raw]) for raw in df.columns if raw in aliases]
    absent = missing_required(aliases[raw] for raw in df.columns if raw in aliases)
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df.select(*keep, *known)


def as_moment(column: str, kind: T.DataType) -> Column:
    """Timestamp of ``column``; what cannot be read as one becomes NULL."""
    value = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return value
    if isinstance(kind, T.NumericType):
        # Plain numbers count nanoseconds since 1970, in 64 bits; what does not fit is missing.
        whole = value.try_cast("bigint")
        span = F.make_dt_interval(secs=(whole / F.lit(1_000_000_000)).cast("decimal(18,6)"))
        return F.when(whole.isNotNull(), F.lit("1970-01-01").cast("timestamp_ntz") + span)
    return value.try_cast("timestamp_ntz")


def as_number(column: str, kind: T.DataType) -> Column:
    """Double of ``column``; malformed text and NaN become NULL."""
    value = F.col(column)
    if isinstance(kind, T.StringType):
        # The JVM also reads a trailing type letter as part of a number ("1d"); that is no number.
        value = F.when(~value.rlike(r"[0-9.][dDfF]\s*$"), value)
    return without_nan(value.try_cast("double"))


def coerced_trips(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """One timestamp column, every other column as double; ``keep`` columns stay as they are."""
    untouched = set(keep)

    def coerced(field: T.StructField) -> Column:
        if field.name in untouched:
            return F.col(field.name)
        convert = as_moment if field.name == MOMENT else as_number
        return convert(field.name, field.dataType).alias(field.name)

    return df.select(*[coerced(field) for field in df.schema.fields])


def canonical_trips(
    df: DataFrame, aliases: Mapping[str, str] = ALIASES, keep: Iterable[str] = ()
) -> DataFrame:
    """Raw trip table to canonical names and types in one projection."""
    keep = tuple(keep)
    return coerced_trips(renamed_trips(df, aliases, keep), keep)


def data_files(spark: SparkSession, *paths: str) -> list[str]:
    """The Parquet files below the paths, by a listing alone."""
    # With a schema given, no footer is read.
    listed = spark.read.schema("listed int").parquet(*paths).inputFiles()
    return sorted(unquote(file) for file in listed)


def literal_path(file: str) -> str:
    """A path whose special characters are not taken for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", file)


def files_by_schema(spark: SparkSession, *paths: str) -> list[tuple[T.StructType, list[str]]]:
    """Files grouped by the names and types of their columns, whatever the order of these.

    One footer job for each file, several at a time: only schemas come to the driver.
    """

    def footer(file: str) -> T.StructType:
        return spark.read.parquet(literal_path(file)).schema

    files = data_files(spark, *paths)
    with ThreadPoolExecutor(FOOTER_THREADS) as pool:
        schemas = list(pool.map(footer, files))
    groups: dict[tuple, tuple[T.StructType, list[str]]] = {}
    for file, schema in zip(files, schemas, strict=True):
        key = tuple(sorted((field.name, field.dataType.json()) for field in schema.fields))
        groups.setdefault(key, (schema, []))[1].append(file)
    return [groups[key] for key in sorted(groups)]


def canonical_files(
    spark: SparkSession,
    *paths: str,
    aliases: Mapping[str, str] = ALIASES,
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Raw trip files of varying columns and types as one canonical table.

    Each group of equal schemas is one scan that reads its own known columns, with its own types, and
    is brought to canonical names and types before the groups are united. A column that some files
    lack is NULL for their rows; a file without a required column is an error. ``keep`` names further
    columns, as expressions over the scan. Mixed kinds of pickup times become ``timestamp_ntz``.
    """
    keep = dict(keep or {})
    frames = []
    for schema, files in files_by_schema(spark, *paths):
        absent = missing_required(aliases[name] for name in schema.names if name in aliases)
        if absent:
            raise ValueError(f"missing required columns: {absent} in {files[0]}")
        raw = spark.read.schema(schema).parquet(*[literal_path(file) for file in files])
        frames.append(canonical_trips(raw.withColumns(keep), aliases, keep))
    if not frames:
        raise ValueError(f"no files below {', '.join(paths)}")
    if len({frame.schema[MOMENT].dataType for frame in frames}) > 1:
        moment = F.col(MOMENT).cast("timestamp_ntz")
        frames = [frame.withColumn(MOMENT, moment) for frame in frames]
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    order = dict.fromkeys([*keep, *aliases.values()])
    return united.select(*[name for name in order if name in united.columns])
