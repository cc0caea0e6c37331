"""Listing and reading a folder tree in tasks, one level of folders after the other.

Spark's own file sources leave out names that start with ``.`` or ``_`` and files
without a byte, and list all names in the driver. Here a level's folders are rows:
tasks list them, files are kept, folders make the next level. The driver only
learns whether there is a next level.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragframe.session import checkpointed
from ragframe.settings import TREE_BATCH_BYTES, TREE_FILES_PER_TASK

_LISTED = "rel_path string, is_folder boolean, bytes long"
_READ = "rel_path string, content binary"


def _absolute(base: str) -> str:
    """The folder as an address that means the same in every task."""
    if base.startswith("file:"):
        # Spark writes file:/a as well as file:///a
        return "/" + base.removeprefix("file:").strip("/")
    return base.rstrip("/") if "://" in base else os.path.abspath(base)


def _resolved(base: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of an absolute folder, with or without a scheme."""
    if "://" not in base:
        # taken as it stands: names may hold characters that an address would escape
        return fs.LocalFileSystem(), base.rstrip("/")
    scheme, rest = base.split("://", 1)
    system, path = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")
    return system, path.rstrip("/")


def _is_link(system: fs.FileSystem, path: str) -> bool:
    return isinstance(system, fs.LocalFileSystem) and os.path.islink(path)


def list_files(spark: SparkSession, base: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(rel_path, bytes) of the files below ``base`` whose name ends with one of ``suffixes`` in any case.

    All names count, whatever they begin with; a name that is nothing but the
    suffix does not. Links to folders are not followed. A missing folder raises.
    """
    base = _absolute(base)
    system, root = _resolved(base)
    if system.get_file_info(root or "/").type != fs.FileType.Directory:
        raise FileNotFoundError(base)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _resolved(base)
        for batch in batches:
            for folder in batch.column("rel_path").to_pylist():
                infos = system.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root or "/"))
                rows = []
                for info in infos:
                    is_folder = info.type == fs.FileType.Directory
                    if is_folder and _is_link(system, info.path):
                        continue
                    name = info.base_name.lower()
                    wanted = name.endswith(suffixes) and name not in suffixes
                    if is_folder or (wanted and info.type == fs.FileType.File):
                        rel_path = f"{folder}/{info.base_name}" if folder else info.base_name
                        rows.append((rel_path, is_folder, info.size or 0))
                if rows:
                    names, folders, sizes = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64())],
                        names=["rel_path", "is_folder", "bytes"],
                    )

    level = spark.createDataFrame([("",)], "rel_path string")
    found = []
    while True:
        below = checkpointed(level.mapInArrow(listed, _LISTED))
        found.append(below.filter("not is_folder").select("rel_path", "bytes"))
        folders = below.filter("is_folder").select("rel_path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found)
        # A folder with many folders was listed by one task; its folders are dealt to all.
        level = folders.repartition("rel_path")


def read_files(spark: SparkSession, base: str, files: DataFrame) -> DataFrame:
    """(rel_path, content) of listed files, dealt to tasks by their number, not by folder."""
    base = _absolute(base)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _resolved(base)

        def batch_of(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array(names, pa.string()), pa.array(contents, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["rel_path", "content"])

        names: list[str] = []
        contents: list[bytes] = []
        held = 0
        for batch in batches:
            for name in batch.column("rel_path").to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    contents.append(stream.read())
                names.append(name)
                held += len(contents[-1])
                if held >= TREE_BATCH_BYTES:
                    yield batch_of(names, contents)
                    names, contents, held = [], [], 0
        if names:
            yield batch_of(names, contents)

    total = files.count()
    parts = max(1, min(total, max(spark.sparkContext.defaultParallelism, -(-total // TREE_FILES_PER_TASK))))
    dealt = files.repartition(parts, F.xxhash64("rel_path")).select("rel_path")
    return dealt.mapInArrow(read, _READ)
