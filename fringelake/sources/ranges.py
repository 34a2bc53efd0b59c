"""Byte ranges of files wherever they are: tasks and the driver open the same path or URI."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def _place(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_ranges(path: str):
    """A seekable binary file of a local path or of a URI of a shared store."""
    system, inner = _place(path)
    return system.open_input_file(inner)


def open_output(path: str):
    system, inner = _place(path)
    system.create_dir(inner.rpartition("/")[0] or "/", recursive=True)
    return system.open_output_stream(inner)


def files_in(path: str) -> list[str]:
    """The file, or the files of a folder in order of their names."""
    from pyarrow import fs

    system, inner = _place(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = sorted(x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File)
    head = path.rstrip("/")
    return [f"{head}/{x.rpartition('/')[2]}" for x in found]


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: under ``spark.checkpoint.dir``, or private where all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fringelake-")
    return f"{folder}/{uuid.uuid4().hex}"
