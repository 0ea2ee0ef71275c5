"""Shared pieces of the training-data operators: durable intermediate tables, word rules, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share, as ``spark.checkpoint.dir`` names it.

    Only on one machine (a local master, as in tests) may the session name none: a temporary folder is set then. On a
    cluster that is an error, for executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'lodestar-shared')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table, on whatever file system it lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a path once the driver ends; until then results may be read from it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The written table ends the lineage: a lost executor costs a re-read, never the recomputation of what came before.
    The path is in ``cut_path`` of the result, for :func:`drop_cut`; what a result is still read from goes when the
    driver ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    delete_at_exit(spark, path)
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Delete a table of :func:`cut` that nothing reads any more."""
    path = getattr(df, "cut_path", None)
    if path:
        delete(df.sparkSession, path)


def n_words(text: Column) -> Column:
    """The number of words of a text; of null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key of a source that keeps null apart from every string and sorts it last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


#: Parts that the rows of one key are dealt to where the key may hold a third of all rows; one bit of a long for each.
PARTS = 32


def part_of(*columns: str | Column) -> Column:
    """The part, from 0, of a row among the rows of its key; the columns tell rows of a key apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int")


def parts_seen(part: str | Column) -> Column:
    """An aggregate: the parts of a key that have rows, as bits. It combines before the shuffle."""
    return F.bit_or(F.expr(f"shiftleft(1L, {part})") if isinstance(part, str) else F.call_function("shiftleft", F.lit(1).cast("long"), part))


def each_part(seen: str) -> Column:
    """A row for each part that :func:`parts_seen` found."""
    return F.explode(F.expr(f"filter(sequence(0, {PARTS - 1}), i -> (shiftright({seen}, i) & 1L) = 1L)"))


_OWNER: list = [None, None]


def release_memory() -> None:
    """Give freed memory of a Python worker back to the machine; idle workers stand beside the JVM's own growth."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def take_process(name: str, drop: Callable[[], None] | None = None) -> None:
    """Say that this Python worker now works for ``name``; what another operator remembered in it is dropped.

    Workers outlive tasks, so words and tables learnt in one are of use in the next, but only to the same operator.
    """
    if _OWNER[0] != name:
        if _OWNER[1]:
            _OWNER[1]()
            release_memory()
        _OWNER[:] = [name, drop]


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most so many rows at a time to Python while a job runs: long texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_rows(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 2_000) -> DataFrame:
    """``mapInArrow`` for functions from a batch to a dict of columns.

    ``make`` runs once in each task, so that tokenizers, compressors and caches are set up once for all its batches,
    which it gets ``rows`` rows at a time.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        take_process(f"{make.__module__}.{make.__qualname__}")
        for batch in batches:
            step = step or make()
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)
        release_memory()

    return df.mapInArrow(run, schema)


def _system(url: str):
    """``(file system or None for this machine's, path)`` of a shared folder's URL."""
    parts = urlparse(url)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path) if parts.scheme else url
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def write_shared(url: str, data: bytes) -> None:
    system, path = _system(url)
    if system is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.tmp", "wb") as out:
            out.write(data)
        os.replace(f"{path}.tmp", path)
    else:
        with system.open_output_stream(path) as out:
            out.write(data)


def read_shared(url: str) -> bytes:
    system, path = _system(url)
    if system is None:
        with open(path, "rb") as source:
            return source.read()
    with system.open_input_stream(path) as source:
        return source.read()


def open_shared(url: str):
    """A stream over a file that Spark or this package named by its URL."""
    system, path = _system(url)
    return open(path, "rb") if system is None else system.open_input_stream(path)


def read_range(url: str, at: int, size: int) -> bytes:
    """``size`` bytes of a file from ``at``."""
    system, path = _system(url)
    with open(path, "rb") if system is None else system.open_input_file(path) as source:
        source.seek(at)
        return source.read(size)
