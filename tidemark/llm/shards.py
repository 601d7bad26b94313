"""Files that tasks write side by side: temporary names, renames, and manifests that say which files count."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


@contextmanager
def committed(fs: pafs.FileSystem, final: str):
    """A stream to a temporary name, which takes the final name only when all is written.

    An attempt that dies leaves a temporary file that no manifest names; attempts that run
    side by side write the same bytes, so it doesn't matter whose rename is last.
    """
    temporary = f"{final}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, compression=None) as out:
        yield out
    fs.move(temporary, final)


def make_folder(path: str) -> None:
    fs, place = filesystem(path)
    fs.create_dir(place, recursive=True)


def save_manifest(rows: DataFrame, folder: str) -> DataFrame:
    """Runs the writing job and commits the list of its files; readers go by this list alone."""
    path = posixpath.join(folder, "manifest")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def file_rows(manifest: DataFrame, partitions: int) -> DataFrame:
    """The manifest's rows, dealt out so that files are read side by side."""
    return manifest.repartition(partitions, F.col("path")) if partitions > 1 else manifest
