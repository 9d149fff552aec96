"""Write an intermediate result to the shared scratch folder and read it back.

Used where several branches of one plan must see identical rows (for example
range-bucket ids, which depend on sampled bounds), and to cut long lineages:
after the write, a lost executor only re-reads files.

Shuffle files of a write are deleted as soon as it has ended: nothing reads them
again, but else they stay until the driver happens to collect its garbage.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import scratch_dir

_STAGED: dict[str, list[str]] = {}  # application -> folders written by stage()

#: Makes writers that start while it is true delete their shuffle files at their end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCK = threading.Lock()
_WRITERS: dict[str, tuple[int, str | None]] = {}  # session -> (writes that are running, the setting before them)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside it leave no shuffle files; the session's setting is put back after the last of them."""
    session = spark._jsparkSession.sessionUUID()
    with _LOCK:
        running, before = _WRITERS.get(session, (0, spark.conf.get(SHUFFLE_CLEANUP, None)))
        _WRITERS[session] = running + 1, before
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            running, before = _WRITERS.pop(session)
            if running > 1:
                _WRITERS[session] = running - 1, before
            elif before is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Eagerly write ``df`` as Parquet under the scratch folder, with the writer's ``options``; return the re-read frame."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    with shuffles_freed(spark):
        df.write.mode("error").options(**options).parquet(path)
    return spark.read.parquet(path)


def still_there(*frames: DataFrame) -> bool:
    """Whether every file that ``frames`` read is still in its folder (listed, not opened).

    What is kept for later queries reads files of the scratch folder, which
    others may empty; a frame whose files are gone fails whatever reads it.
    """
    files = {file for df in frames for file in df.inputFiles()}
    folders = sorted({unquote(file.rpartition("/")[0]) for file in files})
    if not folders:
        return True
    try:
        listed = frames[0].sparkSession.read.schema("nothing int").parquet(*folders).inputFiles()
    except AnalysisException:  # a folder is gone
        return False
    return files.issubset(listed)


def drop_staged(df: DataFrame) -> list[str]:
    """Delete the staged tables that ``df`` reads, once nothing does so any more; returns what is left."""
    folders = {unquote(file.rpartition("/")[0]).removeprefix("file:").lstrip("/") for file in df.inputFiles()}
    written = _STAGED.get(df.sparkSession.sparkContext.applicationId, [])
    return _deleted([path for path in written if path.removeprefix("file:").lstrip("/") in folders], written)


def clear_staged(spark: SparkSession) -> list[str]:
    """Delete what :func:`stage` wrote in this application; returns what is left.

    Call it when no result is read any more that was built on staged tables.
    Folders in a store that pyarrow cannot open are left and returned.
    """
    return _deleted(_STAGED.pop(spark.sparkContext.applicationId, []))


def _deleted(paths: list[str], written: list[str] | None = None) -> list[str]:
    """Delete folders, and their names from ``written``; returns those that are left."""
    left = []
    for path in paths:
        try:
            if "://" in path or path.startswith("file:"):
                fs, inner = pyarrow.fs.FileSystem.from_uri(path)
            else:
                fs, inner = pyarrow.fs.LocalFileSystem(), path
            if fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound:
                fs.delete_dir(inner)
            if written is not None:
                written.remove(path)
        except (OSError, pyarrow.ArrowInvalid, ValueError):
            left.append(path)
    return left
