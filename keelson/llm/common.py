"""Helpers shared by the training-data operators: reading, the shared folder, and Arrow plumbing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data set in sf_dir, read by Spark (so any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders of local sessions for which none is set, by application.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one; a cluster's is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in LOCAL:
            LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='keelson-shared-')}"  # driver and executor are one process here
        path = LOCAL[app]
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    return f"{shared_dir(spark)}/keelson/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, fixes its rows."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*written: DataFrame) -> None:
    """Delete what materialise() wrote, once everything made from it has been written itself; and Spark's own files."""
    for df in written:
        if path := df.__dict__.get("written_at"):
            discard(df.sparkSession, path)
    if written:
        free_shuffles(written[0].sparkSession)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a shared path that is not needed any more (through Hadoop's file system, as it may be remote)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that have been written and are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_bytes(column: pa.Array) -> list[bytes]:
    """The cells of a string or binary column as bytes, null as empty; no decoding takes place."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """The cells of a string column, null as empty; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in as_bytes(column)]


#: Tables that an operator's tasks leave in their Python worker for the next task, by name: how to drop them.
HELD: dict[str, Callable[[], object]] = {}


def hold(name: str, drop: Callable[[], object] | None = None) -> None:
    """Tables outlive a task while the tasks that follow in its worker are of the same name; those of others go."""
    for other in [k for k in HELD if k != name]:
        HELD.pop(other)()
    if drop:
        HELD[name] = drop


def pieces_of(batches: Iterator[pa.RecordBatch], text: str, at_most: int = 8 << 20, held: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about at_most bytes of text, so that long documents don't pile up in Python. Tables
    that other tasks left in this worker go, but for those of the name `held`."""
    hold(held)
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = batch.column(batch.schema.get_field_index(text)).nbytes / batch.num_rows
        step = max(1, int(at_most / max(mean, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def quiet_collector() -> None:
    """Have Python's cycle collector run seldom: it would walk through large tables of bytes again and again."""
    gc.set_threshold(200_000, 50, 1000)


#: Rows with texts in an Arrow batch.
TEXTS = 2_000


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, `doc_id` and `text`, whatever else docs holds; clashing extra columns go. Rows that hold texts are large:
    the session's Arrow batches have TEXTS of them at most from here on, so that executors needn't hold more off the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(name)) <= TEXTS:
        docs.sparkSession.conf.set(name, str(TEXTS))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Arrow batches of fewer rows, for what runs within: rows that hold texts and arrays of them are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def opened(uri: str, mode: str):
    """A file at a Hadoop-style URI, for reading ("r") or for writing ("w"); whole writes appear at once or never."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        with store.open_input_file(path) as f:
            yield f
        return
    store.create_dir(path.rpartition("/")[0], recursive=True)
    begun = f"{path}.{uuid.uuid4().hex}.begun"
    with store.open_output_stream(begun) as f:
        yield f
    store.move(begun, path)
