"""Sample files and their manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareline.operators.profile import file_fingerprint, table_digest
from fareline.operators.sampling import SAMPLE_LABELS, checked_sizes, nested_samples
from fareline.sources.records import write_records
from fareline.sources.synthetic import synthetic_trips
from fareline.sources.trips import canonical_files, has_coordinates, row_identity

# Files of a sample hold at most this many rows.
FILE_ROWS = 5_000_000


def write_parquet(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """New Parquet table; an existing target is refused, an empty folder included."""
    writer = df.write.mode("errorifexists").option("maxRecordsPerFile", file_rows)
    writer.parquet(path)


def write_samples(
    samples: DataFrame, sizes: Sequence[int], path: str, file_rows: int = FILE_ROWS
) -> None:
    """Write the nested samples below ``path``, one folder per label, ordered by ``row_id``.

    Row numbers are dense, so equal runs of them make equal files without a sampling pass. The
    largest sample is computed once; the smaller ones are prefixes read back from it, where the
    ``row_id`` bound skips files and row groups.
    """
    spark = samples.sparkSession
    sizes = checked_sizes(sizes)
    largest = f"{path}/{SAMPLE_LABELS[-1]}"
    rows = samples.drop("sample")
    runs = -(-sizes[-1] // file_rows)
    run = F.floor(F.col("row_id") / file_rows)
    ordered = rows.repartition(runs, run).sortWithinPartitions("row_id")
    write_parquet(ordered, largest, file_rows)
    kept = spark.read.schema(rows.schema).parquet(largest)
    for label, size in zip(SAMPLE_LABELS[:-1], sizes[:-1], strict=True):
        write_parquet(kept.where(F.col("row_id") < size), f"{path}/{label}", file_rows)


def sample_rows(samples: DataFrame) -> DataFrame:
    """Rows of each nested sample: every row counts for its own label and the larger ones."""
    held = [
        F.count_if(F.col("sample").isin(*SAMPLE_LABELS[: number + 1])).alias(label)
        for number, label in enumerate(SAMPLE_LABELS)
    ]
    entries = [
        F.struct(F.lit(label).alias("label"), F.col(label).alias("rows")) for label in SAMPLE_LABELS
    ]
    coordinates = F.lit(has_coordinates(samples.columns)).alias("coordinates_available")
    return samples.agg(*held).select(F.inline(F.array(*entries))).select("*", coordinates)


# How the samples of a source, and those of synthetic trips, were drawn.
SAMPLING = {
    "files": "nested random-priority samples",
    "synthetic": "nested synthetic prefixes",
}


def sample_manifest(
    spark: SparkSession, path: str, origin: Column, seed: int, kind: str = "files"
) -> DataFrame:
    """One row that describes written samples: origin, seed, and per label rows, bytes, digest.

    One scan over the files of all labels counts rows by file, one pass digests the files; both are
    grouped by the label in the file's path.
    """
    folders = [f"{path}/{label}" for label in SAMPLE_LABELS]

    def label_of(file: str) -> Column:
        return F.element_at(F.split(file, "/"), -2)

    stored = spark.read.parquet(*folders)
    rows = stored.groupBy(label_of("_metadata.file_path").alias("label")).agg(F.count("*").alias("rows"))
    files = file_fingerprint(spark, *[f"{folder}/*.parquet" for folder in folders])
    parts = table_digest(files, label_of("path").alias("label"))
    # One row for each label. A sample without rows has files all the same.
    described = parts.join(rows, "label", "left").select(
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "label",
        F.col("label").alias("path"),
        "sha256",
        "bytes",
    )
    entries = F.array_sort(F.collect_list(F.struct("rows", "label", "path", "sha256", "bytes")))
    return described.agg(
        F.first(origin).alias("origin"),
        F.lit(SAMPLING[kind]).alias("sampling"),
        F.lit(seed).alias("seed"),
        F.lit(has_coordinates(stored.columns)).alias("coordinates_available"),
        entries.alias("datasets"),
    )


def prepare(
    spark: SparkSession,
    output: str,
    sources: Sequence[str] = (),
    sizes: Sequence[int] = (2_000, 8_000, 20_000),
    seed: int = 42,
) -> DataFrame:
    """Nested samples of raw trip files (or of synthetic trips) as Parquet, with a manifest."""
    sizes = checked_sizes(sizes)
    if sources:
        trips = canonical_files(spark, *sources, keep={"row_key": row_identity(sources)})
        available = trips.count()
        if available < sizes[-1]:
            raise ValueError(f"the source has {available} rows, fewer than {sizes[-1]}")
        samples = nested_samples(trips, sizes, seed, "row_key").drop("row_key")
        kind = "files"
        digest = table_digest(file_fingerprint(spark, *sources)).first()["sha256"]
    else:
        available = sizes[-1]
        samples = synthetic_trips(spark, available, seed)
        kind = "synthetic"
        digest = None
    write_samples(samples, sizes, output)
    origin = F.struct(
        F.lit(kind).alias("kind"),
        F.lit(",".join(source.rsplit("/", 1)[-1] for source in sources)).alias("source_file"),
        F.lit(digest).cast("string").alias("source_sha256"),
        F.lit(available).cast("bigint").alias("source_rows"),
    )
    manifest = sample_manifest(spark, output, origin, seed, kind)
    write_records(manifest, f"{output}/manifest")
    return manifest
