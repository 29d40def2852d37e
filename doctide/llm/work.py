"""Shared working tables.

Intermediate tables are cut from their lineage by writing them as Parquet below
``spark.checkpoint.dir``, the folder that the cluster shares between the driver
and all executors.  A lost executor then costs a re-read, never a re-run.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (tests, one machine), a temporary folder.

    A cluster without the setting is refused: its machines share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="doctide-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def carried(keep) -> Column:
    """The columns that an operator hands on, as one struct: their names cannot clash with its own."""
    return F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep")


def with_carried(rows: DataFrame, more: str) -> T.StructType:
    """Schema of _keep and further columns."""
    return T.StructType([rows.schema["_keep"], *T.StructType.fromDDL(more)])


#: Rows of a few numbers each that a file of a working table holds at least, where their count is known.
ROWS_A_FILE = 1 << 18
#: Rows whose texts a task holds as Python objects at once.
ROWS_AT_ONCE = 512


def sliced(batches, rows: int = ROWS_AT_ONCE):
    """Arrow batches in slices of at most rows rows, without copies; at the end the worker gives back what it has freed."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        del batch
    release()


def release() -> None:
    """Return freed memory to the system: workers live on from task to task, beside others on their machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class _Recorders(threading.local):
    """Of each thread its own: pipelines that run at once do not see each other's folders."""

    def __init__(self):
        self.lists: list[list[Work]] = []


_recorders = _Recorders()
_left: list[Work] = []


@atexit.register
def _delete_left() -> None:
    """At the driver's end, the folders of all runs: until then their lazy results may read them."""
    for work in _left:
        with contextlib.suppress(Exception):  # the session may have gone
            if not work.kept and work.spark.sparkContext._jsc is not None:
                work.drop()


@contextlib.contextmanager
def recorded(made: list[Work]):
    """Folders that operators make meanwhile are added to made."""
    _recorders.lists.append(made)
    try:
        yield
    finally:
        _recorders.lists.remove(made)


def sweep(made: list[Work], reads: DataFrame) -> None:
    """Delete the folders in made that the table reads does not read from: their results were written elsewhere."""
    files = reads.inputFiles()
    for work in list(made):
        if work.spark is not reads.sparkSession:  # of a session that may have ended
            made.remove(work)
        elif not any(work.path.rsplit("/", 1)[1] in f for f in files):
            work.drop()
            made.remove(work)


class Work:
    """A folder of working tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        """path: a folder of the caller's, which is not deleted at the driver's end."""
        self.spark, self.kept = spark, path is not None
        self.path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if not self.kept:
            _left.append(self)
            for made in _recorders.lists:
                made.append(self)

    def put(self, df: DataFrame, name: str, *, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
        """Write df as a table and return it as read from there.

        partition_by: a column by whose values the rows are put into folders, which can be dropped one by one.
        rows: about how many df has; they are written in no more files than these ask for.
        """
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))
        writer = df.write.mode("overwrite").options(**{"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"})
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.get(name, df.schema)

    def get(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without names the whole folder."""
        jvm, jsc = self.spark._jvm, self.spark._jsc
        for target in [f"{self.path}/{name}" for name in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs."""
        gc.collect()
        self.spark._jvm.System.gc()
