"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Largest slice of a column's text (bytes) that one vectorised step works on.
SLICE_BYTES = 1 << 20

_SENT: set[str] = set()  # applications that have got the package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (so any store Spark can open will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, chosen by position.

    Extra columns, also ones that differ from a wanted name only in case, can
    neither clash nor become ambiguous.
    """
    where = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(where, names)])


def unclash(df: DataFrame, needed: tuple[str, ...] = (), reserved: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with every column name unambiguous.

    Dropped are columns named (in any case) like an operator's own output in
    ``reserved``, and columns that differ only in case from a ``needed`` one or
    from an earlier one.
    """
    seen = {n.lower() for n in reserved}
    first = [df.columns.index(n) for n in needed]
    keep = []
    for i in first + [i for i in range(len(df.columns)) if i not in first]:
        name = df.columns[i].lower()
        if name not in seen:
            seen.add(name)
            keep.append(i)
    keep.sort()
    if len(keep) == len(df.columns):
        return df
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(df.columns[i]) for i in keep])


def on_workers(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Where PYTHONPATH (inherited by workers) already names the repository there
    is nothing to do; otherwise the package travels as a zip, once per session.
    """
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if ROOT in known or sc.applicationId in _SENT:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerline-"), "ledgerline_llm.zip")
    package = os.path.join(ROOT, "ledgerline")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)


def release_memory() -> None:
    """Hand memory that a task has freed back to the system: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the C library that has it


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a string array holding about ``limit`` bytes each.

    A longer single text is a range of its own, so no text is ever cut.
    """
    start, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(text):
        yield start, len(text)


def add_columns(
    df: DataFrame,
    column: str,
    schema: T.StructType,
    fn: Callable[[pa.Array], dict[str, pa.Array]],
) -> DataFrame:
    """``df`` with the columns of ``schema`` computed from one string column.

    Runs ``fn`` over Arrow batches inside each partition: no shuffle, other
    columns pass through untouched, and columns of ``df`` named like a new one
    are replaced.
    """
    on_workers(df.sparkSession)
    df = unclash(df, (column,), tuple(f.name for f in schema))
    at = df.columns.index(column)
    new = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                made = fn(part.column(at))
                yield pa.RecordBatch.from_arrays(part.columns + [made[n] for n in new], names=names)
        release_memory()

    names = df.columns + new
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
    return df.mapInArrow(run, T.StructType(fields + list(schema.fields)))
