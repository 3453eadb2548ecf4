"""Source archives: the files of tar balls that were fetched, as rows."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "archive string, path string, content binary"


def read_archives(spark: SparkSession, root: str, pattern: str = "*.tar.gz") -> DataFrame:
    """(archive, content) of the archives below a folder, one row each."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def unpacked(archives: DataFrame, wanted: str = "") -> DataFrame:
    """(archive, path, content) of the regular files in (archive, content) rows, below the folder that a fetched tag is packed in.

    wanted: regular expression that a path must contain. An archive is unpacked in one task, file by
    file; names that climb out of it and links are left out. What is no archive is an error.
    """
    import re

    test = re.compile(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py() or b""), mode="r:*") as tar:
                    for member in tar:
                        path = member.name.partition("/")[2]
                        if not member.isfile() or not path or ".." in path.split("/") or member.name.startswith("/") or not test.search(path):
                            continue
                        yield pa.record_batch([pa.array([name], pa.string()), pa.array([path], pa.string()), pa.array([tar.extractfile(member).read()], pa.binary())], ["archive", "path", "content"])

    return archives.select("archive", "content").mapInArrow(run, FILE)


def texts(files: DataFrame) -> DataFrame:
    """(archive, path, text) of unpacked files."""
    return files.select("archive", "path", F.decode("content", "UTF-8").alias("text"))
