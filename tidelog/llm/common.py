"""Shared helpers: scratch tables in the cluster's shared folder, file access, text cleaning."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one batch that goes to a worker (a longer row makes a batch of its own).
BATCH_BYTES = 8 << 20

#: Words of the shingle and quality operators are runs of anything but these bytes.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local_dir()
    return found.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidelog-")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Open scopes, innermost last: the folders that each removes when it ends.
_scopes: list[list[str]] = []


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders registered inside are removed at the end; those that are kept pass to the scope around it, if there is one."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        remove(spark, held)


def register(path: str, keep: bool = False) -> str:
    """Have a folder removed with the innermost scope, or with the one around that (keep) as a result still reads it."""
    depth = 2 if keep else 1
    if len(_scopes) >= depth:
        _scopes[-depth].append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = register(fresh_path(df.sparkSession, name), keep)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, usable on any executor; without a scheme it is a local path."""
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write the chunks of bytes to one new file; return its size."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    size = 0
    with fs.open_output_stream(path, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    return size


@functools.cache
def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give a worker's freed memory back: workers live on between stages, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


#: How to drop what an operator keeps in a worker between tasks, by its name.
_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, drop: Callable[[], None]) -> None:
    _kept[name] = drop


def alone(name: str = "") -> None:
    """Drop what operators other than this one keep in this worker: workers live on, and all of it together is too much."""
    for other, drop in _kept.items():
        if other != name:
            drop()


def prepare(spark: SparkSession) -> None:
    """Bound the batches, and send this package to the workers, once a context, unless their path has it anyway."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.master.startswith("local[") or context.master == "local":
        known.append(os.getcwd())
    if str(package.parent) in known or getattr(context, "_tidelog_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidelog-"), "tidelog.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    context._tidelog_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns that an operator reads, under its own names: others never clash."""
    prepare(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def spread(units: DataFrame, *keys: str, most: int = 20_000) -> DataFrame:
    """Small rows that each stand for much work, over as many tasks as there are rows (or most)."""
    return units.repartition(max(1, min(most, units.count())), *keys)


def keep_rows(docs: DataFrame, wanted, name: str = "") -> DataFrame:
    """The rows of docs for which wanted(batch), an array of booleans, is true; all columns as they are."""

    def run(batches):
        alone(name)
        for batch in batches:
            yield batch.filter(wanted(batch))
            release()

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
