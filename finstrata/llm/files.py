"""Files that tasks write and read themselves, in a folder named by a URI that pyarrow's file systems know (file, hdfs, s3, gs, ...)."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the folder's path in it; the folder exists afterwards."""
    found, root = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    found.create_dir(root, recursive=True)
    return found, root


def task_name() -> str:
    """A name of this attempt of this task. What an attempt that failed has written is never named in a table, so nobody reads it."""
    ctx = TaskContext.get()
    return f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"


def open_mapped(found: fs.FileSystem, path: str) -> pa.NativeFile:
    """A memory map where the file is local, so that batches are not copied; else an ordinary random-access file."""
    return pa.memory_map(path) if isinstance(found, fs.LocalFileSystem) else found.open_input_file(path)
