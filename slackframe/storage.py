"""Tables written to a folder that all executors share, and this package on the executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from spark.checkpoint.dir; a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="slackframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_made: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{shared_dir(spark)}/slackframe/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete what this session has written to the shared folder; results that still read it are void."""
    jvm = spark.sparkContext._jvm
    for path in _made:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.clear()


#: Whether the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    The shuffle files that the writing took go with its end.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, tag: str) -> DataFrame:
    """df written in buckets by key in the shared folder: joins on key need no shuffle of it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    name = f"slackframe_{path.rsplit('/', 1)[1].replace('-', '_')}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def local_path(uri: str) -> str | None:
    """The path of a file: URI, or None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import slackframe

    top = os.path.dirname(os.path.abspath(slackframe.__file__))
    if os.path.isdir(top):
        own = tempfile.mkdtemp(prefix="slackframe-code-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        with zipfile.ZipFile(f"{own}/slackframe_code.zip", "w") as z:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(f"{own}/slackframe_code.zip")
    _shipped.add(sc.applicationId)


#: Bytes of an Arrow batch that Python gets, unless the session has fewer; a longer row is a batch of its own.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit.rstrip("b")[:1]]


def give_back() -> None:
    """Return what this process has freed, but its allocators keep, to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with this package on the executors.

    Batches are of BATCH_BYTES at most, and at its end a task returns what it has freed: Python
    workers stay for the tasks of later stages, beside an executor's heap that no longer shrinks.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if _bytes(conf.get(_BATCH, "1g")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)
