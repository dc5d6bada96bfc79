"""Where intermediate results live, and how lineage is cut."""

import tempfile
import uuid
import weakref
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may leave it unset; it then gets its own
    temporary folder, remembered in the session. A cluster must name one that
    every executor can reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="mendlist-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of settled results, as long as their DataFrames are in use.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

#: Folders settled since ``scratch`` was entered; None outside of it.
_SCRATCH: ContextVar = ContextVar("scratch", default=None)


def settle(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``df`` once and read it from there afterwards.

    Cuts the lineage of results that several later steps read; the copy
    survives the loss of executors. Without ``path`` it lies in the shared
    folder, under a name no other run uses, and may be deleted after the run; ``release``
    does so as soon as everything made from it is stored itself. ``options`` are those of the Parquet files.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "settled")
    df.write.mode("overwrite").options(**options).parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[settled] = path
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    return settled


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """All that is settled inside is deleted at the end, so what was made from it must be stored by then."""
    folders = []
    token = _SCRATCH.set(folders)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in folders:
            _delete(spark, path)


def release(*settled: DataFrame) -> None:
    """Delete the folders of settled results that no one reads any more.

    What was made from them must be stored: a lost task could not be repeated otherwise.
    Other DataFrames are left alone.
    """
    for df in settled:
        path = _FOLDERS.pop(df, None)
        if path:
            _delete(df.sparkSession, path)
