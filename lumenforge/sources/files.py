"""Byte files in any folder that all executors share: part files written by tasks, ranges read by tasks.

Paths are those of Spark. Local and mounted folders are opened directly; others go through the file systems of pyarrow,
which know s3, gs, abfs and hdfs; the s3a and s3n names of Hadoop are taken as s3.
"""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark import TaskContext
from pyspark.sql import DataFrame


def local(path: str) -> str | None:
    """The path on this machine's (or a mounted) file system; None if it is elsewhere."""
    u = urlparse(path)
    return unquote(u.path) if u.scheme == "file" else path if not u.scheme else None


def filesystem(path: str):
    """The file system of a path and the path's name in it."""
    import pyarrow.fs

    here = local(path)
    if here is not None:
        return pyarrow.fs.LocalFileSystem(), here

    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def open_range(path: str):
    """A file open for reading at any place."""
    here = local(path)
    if here is not None:
        return open(here, "rb")
    fs, name = filesystem(path)
    return fs.open_input_file(name)


def put(path: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so that nobody sees half of it."""
    here = local(path)
    if here is not None:
        os.makedirs(os.path.dirname(here) or ".", exist_ok=True)
        part = f"{here}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, here)
        return
    fs, name = filesystem(path)
    with fs.open_output_stream(name) as f:
        f.write(data)


def write_parts(rows: DataFrame, path: str, suffix: str) -> None:
    """Writes the binary column of rows, each partition's in its order, as part-<number>.<suffix> below path. A task that
    runs again writes the same file anew."""
    import pyarrow as pa

    def write(batches):
        import os

        here, at = local(path), TaskContext.get().partitionId()
        name, n = f"part-{at:06d}.{suffix}", 0
        if here is not None:
            os.makedirs(here, exist_ok=True)
            part = f"{here}/.{name}.{uuid.uuid4().hex}"
            out = open(part, "wb")
        else:
            fs, folder = filesystem(path)
            out = fs.open_output_stream(f"{folder}/{name}")
        try:
            with out:
                for b in batches:
                    for x in b.column(0):
                        raw = x.as_py()
                        out.write(raw)
                        n += len(raw)
            if here is not None:
                os.replace(part, f"{here}/{name}")
        except BaseException:
            if here is not None and os.path.exists(part):
                os.remove(part)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "size"])

    rows.mapInArrow(write, "name string, size long").collect()
