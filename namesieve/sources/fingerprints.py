"""SHA-256 of files of any size.

A digest needs a file's bytes in order. Spark reads a file in splits, as lines
of raw bytes; the lines of a file go to one task, sorted by their place, and
stream through a digest there. No task holds more than a batch of lines, and a
sort that does not fit memory goes to disk. Compressed files, which the line
reader would unpack, are read as one value each (up to Spark's 2 GB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that the line reader unpacks.
PACKED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


class _Digest:
    """The digest of one file from its lines in order.

    The line reader drops a byte order mark at the start of a file and the line
    feed at its end; the file's size tells at the end whether they were there.
    """

    def __init__(self, file: str, size: int):
        self.file, self.left, self.begun = file, size, False
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)

    def add(self, line: bytes) -> None:
        parts = (b"\n", line) if self.begun else (line,)
        for part in parts:
            self.plain.update(part)
            self.marked.update(part)
            self.left -= len(part)
        self.begun = True

    def row(self) -> pa.RecordBatch:
        found = self.marked if self.left >= len(BYTE_ORDER_MARK) else self.plain
        if self.left in (1, 1 + len(BYTE_ORDER_MARK)):
            found.update(b"\n")
        return pa.RecordBatch.from_pydict({"file": [self.file], "file_sha256": [found.hexdigest()]})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by file and place."""
    current: _Digest | None = None
    for batch in batches:
        for file, size, line in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "line"))):
            if current is None or file != current.file:
                if current is not None:
                    yield current.row()
                current = _Digest(file, size)
            current.add(line)
    if current is not None:
        yield current.row()


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, file_sha256) of every file under a path that is not empty, one file per row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    file = F.col("_metadata.file_path")
    packed = file.rlike(PACKED)
    listed = files.filter(~packed).select("path", "length", file.alias("file"))
    lines = spark.read.options(recursiveFileLookup=True, lineSep="\n").text(path).filter(~packed)
    placed = lines.select(
        file.alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        F.col("value").cast("binary").alias("line"),
    )
    in_order = placed.repartition("file").sortWithinPartitions("file", "block", "row")
    digests = in_order.select("file", "size", "line").mapInArrow(_digests, "file string, file_sha256 string")
    plain = listed.join(digests, "file").select("path", "length", "file_sha256")
    whole = files.filter(packed).select("path", "length", F.sha2("content", 256).alias("file_sha256"))
    return plain.unionByName(whole)


def list_fingerprint(spark: SparkSession, path: str) -> str | None:
    """One digest of a list: its file's, or that of the sorted digests of all its files."""
    files = file_fingerprints(spark, path)
    single = F.when(F.count("*") == 1, F.max("file_sha256"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("file_sha256")), "\n"), 256)
    return files.agg(F.coalesce(single, F.when(F.count("*") > 0, joined))).first()[0]
