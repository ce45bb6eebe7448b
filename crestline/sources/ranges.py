"""Parts of files inside tasks: byte ranges read, and pieces written at offsets.

Tasks reach files through Arrow.  Its file systems know the schemes of ``SCHEMES``; files
of other schemes are read whole by Spark (``reachable`` tells), whatever their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import SparkSession

Read = Callable[[int, int], bytes]
"""(offset, length) to bytes; fewer at the end of the file."""

#: Spark's schemes and what Arrow calls them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def held(raw: bytes) -> Read:
    return lambda at, n: raw[at : at + n]


def scheme(path: str) -> str:
    return path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file"


def reachable(path: str) -> bool:
    return scheme(path) in SCHEMES


def system(path: str):
    """(file system, place in it) of a path as Spark names it."""
    from pyarrow import fs

    if scheme(path) == "file":
        bare = path[5:] if path.startswith("file:") else path
        return fs.LocalFileSystem(), "/" + bare.lstrip("/") if path.startswith(("file:", "/")) else bare
    return fs.FileSystem.from_uri(SCHEMES[scheme(path)] + path[len(scheme(path)) :])


@contextmanager
def opened(path: str) -> Iterator[Read]:
    files, place = system(path)
    with files.open_input_file(place) as f:
        size = f.size()
        yield lambda at, n: f.read_at(max(0, min(n, size - at)), at) if at < size else b""


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files at a path, folder or glob, as Spark finds them."""
    found = spark.read.format("binaryFile").load(path).inputFiles()
    return sorted("file:/" + p[8:] if p.startswith("file:///") else p for p in map(unquote, found))


def named(folder: str, name: str) -> str:
    return folder.rstrip("/") + "/" + name


def leaf(path: str) -> str:
    return PurePosixPath(path).name
