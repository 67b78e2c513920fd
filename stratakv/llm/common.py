"""Shared plumbing of the subpackage: tables, scratch space in the shared folder, worker imports."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_scratch: list[tuple[SparkSession, str]] = []
#: Words are runs of bytes other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts are long, so batches of Spark's default length would fill a worker's memory.
BATCH_ROWS = 1000
_held: dict = {}


def held(key, build):
    """The one large object (a model, a store of ids) that a worker keeps between tasks; another key drops the last."""
    if key not in _held:
        drop_held()
        _held[key] = build()
    return _held[key]


def drop_held() -> None:
    """Give back the memory of what an earlier operator kept in this worker."""
    if _held:
        import ctypes
        import gc

        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its freed pages
            pass


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, however the driver found it, keep their batches small, and drop shuffle files when a query ends."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows, "10000")) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, path) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="stratakv-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{os.path.abspath(at)}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    if not _scratch:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/stratakv-{tag}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def tasks(spark: SparkSession, rows: int, per: int = 10_000) -> int:
    """Tasks worth having for so many rows: one for each core, and beyond that none of fewer than ``per`` rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per))


def materialize(df: DataFrame, tag: str, most: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and survives lost executors.

    most: tasks to write with at most, where the rows are known to be few for the partitions that they are in.
    """
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, tag)
    if most:
        df = df.coalesce(most)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove materialised tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text holds about ``limit`` bytes; a longer text makes a slice alone.  Null texts become empty."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        text = batch.column(k).fill_null("").cast(pa.large_binary())
        batch = batch.set_column(k, column, text)
        if not batch.num_rows:
            continue
        offsets = large_offsets(text)
        start = 0
        while start < batch.num_rows:
            stop = int(offsets.searchsorted(offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def large_offsets(text: pa.LargeBinaryArray):
    import numpy as np

    return np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1 + text.offset)[text.offset :]


def text_buffer(text: pa.LargeBinaryArray):
    """(bytes as uint8, offsets from 0) of a large_binary array without copying."""
    import numpy as np

    offsets = large_offsets(text)
    data = text.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_count(column) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
