"""Raw files in the shared folder, written and read inside tasks through pyarrow's file systems (file, hdfs, s3, gs).

A task writes files under names of its own attempt and reports them in its rows; only rows that Spark commits count,
so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyarrow import fs


@lru_cache(16)
def _root(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def create(folder: str, stem: str):
    """An open output stream below folder, and its name."""
    system, path = _root(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    return system.open_output_stream(f"{path}/{name}", buffer_size=1 << 20), name


def open_input(folder: str, name: str):
    """A random-access input file."""
    system, path = _root(folder)
    return system.open_input_file(f"{path}/{name}")
