"""Entries of an XML list, cut out of its text by many tasks.

Spark's XML reader takes a file whole in one task. Here a file is read in
splits, as pieces that end at ``>``, so no tag is torn. A split does not know
whether it begins inside an entry, a comment or a CDATA section: every split is
scanned from each of these and says where it ends - three rows a split - and in
the order of a file's splits that tells where each of them begins. Then every
split is cut into its entries; only entries that lie in several splits are put
together by their place.

A row tag closed at once (``<TAG/>``) must have no raw ``>`` in its attributes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namesieve.workspace import work_folder, written

TEXT, COMMENT, CDATA = 0, 1, 2
OPENS = {"<!--": COMMENT, "<![CDATA[": CDATA}
CLOSES = {COMMENT: "-->", CDATA: "]]>"}
SPLIT_ENDS = pa.schema([
    ("file_key", pa.int64()), ("block", pa.int64()), ("state", pa.int32()), ("after", pa.int32()),
    ("delta", pa.int64()), ("low", pa.int64()),
])
PARTS = pa.schema([
    ("file_key", pa.int64()), ("block", pa.int64()), ("number", pa.int64()), ("starts", pa.bool_()),
    ("ends", pa.bool_()), ("entry", pa.string()),
])


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "int32": "int", "bool": "boolean"}
    return ", ".join(f"{f.name} {kinds.get(str(f.type), str(f.type))}" for f in schema)


class _Lexer:
    """Where a row tag opens and closes in a text that comes in pieces."""

    def __init__(self, tag: str, state: int):
        name, self.state = re.escape(tag), state
        self.marks = re.compile(rf"<!--|<!\[CDATA\[|<{name}(?:\s[^>]*)?/?>|</{name}\s*>")

    def events(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(first, after, change of depth) of every row tag; 0 for one that is closed at once."""
        at = 0
        while True:
            if self.state != TEXT:
                close = CLOSES[self.state]
                found = text.find(close, at)
                if found < 0:
                    return
                at, self.state = found + len(close), TEXT
            mark = self.marks.search(text, at)
            if mark is None:
                return
            token, at = mark[0], mark.end()
            if token in OPENS:
                self.state = OPENS[token]
            else:
                yield mark.start(), at, -1 if token.startswith("</") else 0 if token.endswith("/>") else 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[dict, str]]:
    """Consecutive pieces of one split: the values of the other columns, and their text."""
    key, block = batch.column("file_key"), batch.column("block")
    n = len(block)
    other = pc.or_(pc.not_equal(key[1:], key[: n - 1]), pc.not_equal(block[1:], block[: n - 1]))
    bounds = [0, *(i + 1 for i in pc.indices_nonzero(other).to_pylist()), n]
    for first, after in zip(bounds, bounds[1:]):
        if first < after:
            fixed = {c: batch.column(c)[first].as_py() for c in batch.schema.names if c != "value"}
            yield fixed, ">".join(batch.column("value")[first:after].to_pylist()) + ">"


def _split_ends(tag: str) -> Callable:
    """Per split and state before it: the state after it, the change of depth and its lowest point."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, walks = None, []

        def rows() -> pa.RecordBatch:
            found = [(*place, state, lexer.state, depth, low) for state, (lexer, depth, low) in enumerate(walks)]
            return pa.RecordBatch.from_pylist([dict(zip(SPLIT_ENDS.names, row)) for row in found], SPLIT_ENDS)

        for batch in batches:
            for fixed, text in _runs(batch):
                if place != (fixed["file_key"], fixed["block"]):
                    if place is not None:
                        yield rows()
                    place = (fixed["file_key"], fixed["block"])
                    walks = [[_Lexer(tag, state), 0, 0] for state in (TEXT, COMMENT, CDATA)]
                for walk in walks:
                    for _, _, change in walk[0].events(text):
                        walk[1] += change
                        walk[2] = min(walk[2], walk[1])
        if place is not None:
            yield rows()

    return scan


def _split_starts(ends: pd.DataFrame) -> pd.DataFrame:
    """State and depth at the start of every split of one file."""
    state, depth, rows = TEXT, 0, []
    for (key, block), of_split in ends.groupby(["file_key", "block"], sort=True):
        rows.append((key, block, state, depth))
        end = of_split[of_split["state"] == state].iloc[0]
        # A closing tag without an open one changes nothing.
        ignored = max(0, -(depth + int(end["low"])))
        state, depth = int(end["after"]), depth + int(end["delta"]) + ignored
    return pd.DataFrame(rows, columns=["file_key", "block", "state", "depth"])


def _parts(tag: str) -> Callable:
    """Entries of every split, and the parts of those that begin or end in another one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lexer, depth, number, starts, held, out = None, None, 0, 0, False, [], []

        def emit(ends: bool) -> None:
            nonlocal number
            out.append(dict(zip(PARTS.names, (*place, number, starts, ends, "".join(held)))))
            held.clear()
            number += 1

        for batch in batches:
            for fixed, text in _runs(batch):
                if place != (fixed["file_key"], fixed["block"]):
                    if depth:
                        emit(False)
                    place, number, starts = (fixed["file_key"], fixed["block"]), 0, False
                    lexer, depth = _Lexer(tag, fixed["state"]), fixed["depth"]
                first = 0
                for at, after, change in lexer.events(text):
                    if depth == 0 and change >= 0:
                        starts, first = True, at
                    elif depth == 0:
                        continue
                    depth += change
                    if depth == 0:
                        held.append(text[first:after])
                        emit(True)
                if depth:
                    held.append(text[first:])
            yield pa.RecordBatch.from_pylist(out, PARTS)
            out.clear()
        if depth:
            emit(False)
            yield pa.RecordBatch.from_pylist(out, PARTS)

    return cut


def xml_entries(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(position, entry): the text of every element ``tag`` that is in no other one; position is (file, block, number).

    The text is written once; files are read twice.
    """
    file = F.col("_metadata.file_path")
    # Beside every piece only a number stands for its file.
    key = F.xxhash64(file).alias("file_key")
    files = spark.read.format("binaryFile").load(path).select(file.alias("file"), key)
    pieces = spark.read.option("lineSep", ">").text(path)
    pieces = pieces.select(key, F.col("_metadata.file_block_start").alias("block"), "value")
    ends = pieces.mapInArrow(_split_ends(tag), _ddl(SPLIT_ENDS))
    begun = ends.groupBy("file_key").applyInPandas(_split_starts, "file_key long, block long, state int, depth long")
    # One row a split: safe to broadcast, and the pieces keep their order.
    parts = pieces.join(F.broadcast(begun), ["file_key", "block"]).mapInArrow(_parts(tag), _ddl(PARTS))
    parts = parts.join(F.broadcast(files), "file_key").drop("file_key")
    parts = written(parts, f"{work_folder(spark)}/parts")
    place = F.struct("file", "block", "number")
    alone = parts.filter("starts and ends").select(place.alias("position"), "entry")
    # At most two parts a split.
    in_order = Window.partitionBy("file").orderBy("block", "number")
    first = F.last(F.when(F.col("starts"), place), ignorenulls=True).over(in_order)
    torn = parts.filter("not (starts and ends)").withColumn("position", first)
    joined = torn.groupBy("position").agg(
        F.array_sort(F.collect_list(F.struct("block", "number", "entry", "ends"))).alias("parts")
    )
    joined = joined.filter(F.element_at("parts", -1)["ends"])  # one that is never closed is none
    several = joined.select("position", F.array_join(F.transform("parts", lambda p: p["entry"]), "").alias("entry"))
    return alone.unionByName(several)
