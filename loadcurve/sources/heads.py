"""The first lines of files, read from their first block alone: a Python data source with a few files in each partition.

Spark's own text reader goes over whole files. This one opens each file, reads one block of at most HEAD_BYTES and gives its
lines, so that a pass for headers costs the same whatever the files hold. Files are found by Spark's file systems, and opened through
`pyarrow.fs`; for stores that it cannot open, `first_lines` says so by giving None, and callers scan the text instead.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loadcurve.session import let_workers_import

HEAD_BYTES = 1 << 16
FILES_A_TASK = 16
_SCHEMA = "file string, line int, value string, bytes_read bigint"


def files_of(spark: SparkSession, pattern: str) -> list[str]:
    """Addresses of the files of a glob, those of its folders included; hidden files are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, waiting = [], list(system.globStatus(path) or [])
    while waiting:
        status = waiting.pop()
        name = status.getPath().getName()
        if status.isDirectory():
            waiting += [s for s in system.listStatus(status.getPath()) if s.getPath().getName()[:1] not in "._"]
        elif name[:1] not in "._":
            out.append(status.getPath().toUri().toString())
    return sorted(out)


def _opened(address: str):
    """File system and path of an address as Spark writes it (file:/a%20b)."""
    scheme, colon, rest = address.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), unquote("/" + (rest if colon else address).lstrip("/"))
    return fs.FileSystem.from_uri(unquote(address))


class FirstLines(DataSource):
    """Lines, blank ones left out and counted from 0, of the first block of each of the files (option `files`, a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "first_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), int(self.options.get("bytes", HEAD_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], size: int):
        self.files, self.size = files, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.files[i : i + FILES_A_TASK]) for i in range(0, len(self.files), FILES_A_TASK)]

    def read(self, partition: InputPartition):
        for address in partition.value:
            system, path = _opened(address)
            with system.open_input_file(path) as f:
                block = f.read(self.size)
                lines = re.split("\r\n|\r|\n", block.decode("utf-8-sig", "replace"))
                if len(block) == self.size and f.size() > self.size:
                    lines = lines[:-1]  # it may go on in the next block
            for i, line in enumerate(x for x in lines if x.strip(" ")):
                yield address, i, line, len(block)


def first_lines(spark: SparkSession, files: list[str], size: int = HEAD_BYTES) -> DataFrame | None:
    """file, line, value and bytes_read of the first block of each file, or None where files cannot be opened this way."""
    try:
        for address in files[:1]:
            system, path = _opened(address)
            system.get_file_info(path)
    except (OSError, ValueError):  # no driver for this store
        return None
    let_workers_import(spark)
    spark.dataSource.register(FirstLines)
    return spark.read.format("first_lines").option("files", json.dumps(files)).option("bytes", str(size)).load()
