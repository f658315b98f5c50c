"""Helpers around the caller's session: shared folder, written tables, small tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.java_gateway import JavaObject, JavaPackage
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table is only shipped to every executor after it was seen to hold at most this many rows and
# bytes.
SMALL_TABLE_ROWS = 50_000
SMALL_TABLE_BYTES = 32 * 1024**2


#: Temporary folders of local sessions, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used in local mode only: on a cluster a
    machine-local folder would lose data with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if spark.sparkContext.applicationId not in _local_folders:
        _local_folders[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="fareline-")
    return _local_folders[spark.sparkContext.applicationId]


#: Paths named since each open ``scratch`` block began, the innermost last.
_scratch: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/fareline-{label}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named."""
    if not path.startswith(f"{shared_folder(spark)}/fareline-"):
        raise ValueError(f"not a table of this session: {path}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within the block are deleted at its end. No later job may need them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result must be computed exactly once (a sampled range partitioning, for example)
    and must survive the loss of executors.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> pa.Table | None:
    """All rows of ``df`` if there are at most ``limit``, in a bounded size, else ``None``."""
    rows = df.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit and rows.nbytes <= SMALL_TABLE_BYTES else None


def local_table(spark: SparkSession, rows: pa.Table, schema: T.StructType) -> DataFrame:
    """Rows that are part of the plan: no job computes them, and Spark knows their size."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def localised(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is proven small, else ``df`` itself.

    A larger table keeps its plan, so the join falls back to a shuffle join under AQE.
    """
    rows = small_table(df, limit)
    return df if rows is None else local_table(df.sparkSession, rows, df.schema)


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once: written, and kept in the plan as well if it proves small."""
    kept = written(df, label)
    rows = small_table(kept)
    if rows is None:
        return kept
    discard(kept)
    return local_table(df.sparkSession, rows, df.schema)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no later job reads."""
    spark = df.sparkSession
    root = shared_folder(spark).rstrip("/")
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        # Only tables that this module wrote are ever deleted.
        if "/fareline-" not in folder or root.split(":")[-1].lstrip("/") not in folder:
            continue
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.delete(place, True)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Hold ``df`` in executor memory (spilling to disk) for the length of a ``with`` block."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept.count()
        yield kept
    finally:
        kept.unpersist()


#: The loaded classes, by application and name: the executors have them.
_classes: dict[tuple[str, str], JavaObject] = {}
_compiling = threading.Lock()


def has_compiler(spark: SparkSession) -> bool:
    """Whether Spark came with the Janino compiler, which it uses for its own plans."""
    return not isinstance(spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler, JavaPackage)


def compiled_class(spark: SparkSession, name: str, source: str) -> JavaObject:
    """A Java class, compiled once for an application by the compiler that Spark brings for its own
    plans, and added as a jar, which is deleted when the driver ends."""
    context = spark.sparkContext
    with _compiling:
        if (context.applicationId, name) not in _classes:
            compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(source)
            folder = tempfile.mkdtemp(prefix="fareline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            jar = f"{folder}/{name.lower().replace('.', '-')}.jar"
            with zipfile.ZipFile(jar, "w") as out:
                for part, code in compiler.getBytecodes().items():
                    out.writestr(f"{part.replace('.', '/')}.class", bytes(code))
            context._jsc.addJar(jar)
            _classes[context.applicationId, name] = compiler.getClassLoader().loadClass(name)
        return _classes[context.applicationId, name]


def new_object(spark: SparkSession, kind: JavaObject, *values: object) -> JavaObject:
    """An object of a class from :func:`compiled_class`, by its only constructor."""
    given = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, len(values))
    for place, value in enumerate(values):
        given[place] = value
    return kind.getDeclaredConstructors()[0].newInstance(given)
