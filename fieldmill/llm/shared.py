"""Folders, files and tables that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from fieldmill.session import scratch_path


_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, which on a cluster do not see
    the driver's import path (once per application), and keep Arrow batches of
    whole texts small: ``BATCH_ROWS`` rows unless the session asks for fewer."""
    rows = int(spark.conf.get(_BATCH, "10000"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_fieldmill_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="fieldmill-"), "fieldmill_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._fieldmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables below the shared checkpoint folder.

    ``write`` stores a table as Parquet and returns a DataFrame that reads
    it, so later steps read files and a lost executor costs no
    recomputation.  ``drop`` deletes tables whose readers have all run.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, scratch_path(spark, name)
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a bare path is local."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> None:
    """Write a file under a private name and move it to ``uri`` when whole, so
    a retried or doubled task leaves one complete file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(part, path)


def open_input(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def n_parts(total_bytes: int, each: int = 8 << 20, least: int = 64) -> int:
    """Number of work parts so that one holds about ``each`` bytes."""
    return max(least, -(-int(total_bytes or 0) // each))
