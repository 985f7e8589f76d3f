"""Tables that grow by segments: a base, and after it what was added and what it replaces.

Every change writes a folder of its own and then one log row; nothing that was
written is changed, so a version once read can be read again. A version is a
base and the segments after it up to its number.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from namesieve.sources.store import read_or_none
from namesieve.workspace import exists


#: Tables written at a time.
WRITERS = 4


@dataclass(frozen=True)
class Segment:
    """One log row: where a version's own rows lie, and the base it builds upon."""

    version: int
    base: int
    folder: str
    schemas: dict[str, StructType]


@dataclass(frozen=True)
class SegmentStore:
    """Segments under ``root``.

    ``tables``: per table the column that names its rows, and the table of the
    names that a segment replaces or takes away.
    """

    spark: SparkSession
    root: str
    tables: dict[str, tuple[str, str]]

    def log(self) -> dict[int, Segment]:
        """All versions; one small row each."""
        found = read_or_none(self.spark, f"{self.root}/log")
        rows = [] if found is None else found.collect()
        out = {}
        for r in rows:
            schemas = {t: StructType.fromJson(s) for t, s in json.loads(r["schemas"]).items()}
            out[r["version"]] = Segment(r["version"], r["base"], r["folder"], schemas)
        return out

    def current(self) -> int | None:
        return max(self.log(), default=None)

    def write(self, version: int, base: int, segment: dict[str, DataFrame]) -> None:
        """The tables first; only then the log names the version.

        What a failed attempt left behind is never read. Of two writers that
        meet at one number, the later one fails.
        """
        folder = f"{version}-{uuid.uuid4().hex}"

        def save(table: str) -> None:
            segment[table].write.mode("errorifexists").parquet(f"{self.root}/segments/{folder}/{table}")

        with ThreadPoolExecutor(WRITERS) as pool:  # small tables: jobs side by side
            list(pool.map(save, segment))
        schemas = json.dumps({table: rows.schema.jsonValue() for table, rows in segment.items()})
        entry = f"{self.root}/log/version={version}"
        if exists(self.spark, f"{entry}/_SUCCESS"):
            raise RuntimeError(f"version {version} of {self.root} was written meanwhile")
        row = self.spark.createDataFrame([(base, folder, schemas)], "base int, folder string, schemas string")
        row.coalesce(1).write.mode("overwrite").parquet(entry)

    def segment(self, entry: Segment, table: str) -> DataFrame:
        """What one segment holds of a table."""
        path = f"{self.root}/segments/{entry.folder}/{table}"
        return self.spark.read.schema(entry.schemas[table]).parquet(path)

    def read(self, table: str, version: int, log: dict[int, Segment] | None = None) -> DataFrame:
        """Rows of a version: those that no later segment replaced."""
        log = self.log() if log is None else log
        base = log[version].base
        key, replaced = self.tables[table]
        rows, last = self.segment(log[base], table), None
        if version == base:
            return rows
        rows = rows.withColumn("_segment", F.lit(base))
        for number in range(base + 1, version + 1):
            part = self.segment(log[number], table).withColumn("_segment", F.lit(number))
            names = self.segment(log[number], replaced).withColumn("_last", F.lit(number))
            rows = rows.unionByName(part)
            last = names if last is None else last.unionByName(names)
        last = last.groupBy(key).agg(F.max("_last").alias("_last"))
        kept = rows.join(last, key, "left").filter("_last is null or _segment >= _last")
        return kept.drop("_segment", "_last")

    def merge(self, tables: list[str]) -> int:
        """Write the current version as a new base; its number. Earlier versions stay readable."""
        log = self.log()
        old = max(log)
        self.write(old + 1, old + 1, {table: self.read(table, old, log) for table in tables})
        return old + 1
