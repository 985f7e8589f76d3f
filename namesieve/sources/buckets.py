"""Stored tables in hash buckets of a key, changed bucket by bucket.

A bucket of a table is a folder that is written once. A version says which
folder each bucket has; it is logged after its folders are complete, so readers
never see half of one, and a version once read can be read again. Tables are
read as bucketed ones: a join or an aggregation on the whole key shuffles the
other side only.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from namesieve.sources.store import RunLogs
from namesieve.workspace import exists

#: Buckets of a new store: tasks of its joins, and the share of a table that one changed row rewrites.
BUCKETS = 64

BUCKET_LOG = "table string, bucket int, folder string, schema string, buckets int"


@dataclass(frozen=True)
class BucketStore(RunLogs):
    """Tables that share the columns ``keys``, and the run logs, under one folder.

    ``buckets`` is fixed by the first version. Reading names a table in the
    session's catalog, by folder and version; ``forget`` takes the names back.
    """

    keys: tuple[str, ...] = ("source_list", "reference_number")
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        """The bucket of a row, as Spark's own bucketed tables number them."""
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows shuffled as the stored ones lie."""
        return rows.repartition(self.buckets, *self.keys)

    def _log(self) -> DataFrame:
        kinds = f"{BUCKET_LOG}, version int"
        try:
            return self.spark.read.schema(kinds).parquet(f"{self.root}/bucket_log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], kinds)

    def version(self) -> int:
        return self._log().agg(F.max("version")).first()[0] or 0

    def manifest(self, table: str, version: int | None = None) -> tuple[dict[int, str], str, int]:
        """(folder of each bucket, schema, version that last changed it); one small row for each bucket."""
        log = self._log().filter(F.col("table") == table)
        if version is not None:
            log = log.filter(F.col("version") <= version)
        newest = F.max_by(F.struct("version", "folder", "schema", "buckets"), F.col("version"))
        rows = log.groupBy("bucket").agg(newest.alias("at")).collect()
        if any(r.at["buckets"] != self.buckets for r in rows):
            raise ValueError(f"{self.root} has {rows[0].at['buckets']} buckets")
        last, schema = max(((r.at["version"], r.at["schema"]) for r in rows), default=(0, ""))
        return {r["bucket"]: r.at["folder"] for r in rows}, schema, last

    def _prefix(self) -> str:
        return f"namesieve_{uuid.uuid5(uuid.NAMESPACE_URL, self.root).hex}"

    def read(self, table: str, lists: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """A table's rows, of all lists or of some; with the column ``bucket``, whose filters prune folders."""
        folders, schema, last = self.manifest(table, version)
        if not folders:
            return None
        name, keys = f"{self._prefix()}_{table}_{last}", ", ".join(self.keys)
        if not self.spark.catalog.tableExists(name):
            fields = StructType.fromDDL(schema).fields
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            self.spark.sql(
                f"create table {name} ({columns}, bucket int) using parquet partitioned by (bucket)"
                f" clustered by ({keys}) sorted by ({keys}) into {self.buckets} buckets"
                f" location '{self.root}/tables/{table}'"
            )
            parts = (f"partition (bucket={b}) location '{folder}'" for b, folder in sorted(folders.items()))
            self.spark.sql(f"alter table {name} add {' '.join(parts)}")
        rows = self.spark.table(name)
        return rows if lists is None else rows.filter(F.col("source_list").isin(lists))

    def commit(self, tables: dict[str, DataFrame], touched: Sequence[int], since: int) -> int:
        """Make ``tables`` the contents of the ``touched`` buckets; the new version.

        ``since`` is the version that they were made from. Of two writers that
        meet, the later one fails. Where a touched bucket of a table is empty,
        its folder is, too.
        """
        if not touched:
            return since
        number, entries = since + 1, []
        for table, rows in tables.items():
            folder = f"{self.root}/tables/{table}/{number}-{uuid.uuid4().hex}"
            name = f"namesieve_{uuid.uuid4().hex}"
            writer = rows.select([c for c in rows.columns if c != "bucket"] + [self.bucket()]).write
            writer = writer.partitionBy("bucket").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
            writer.option("path", folder).saveAsTable(name)
            self.spark.sql(f"drop table {name}")  # the files stay
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "bucket")
            entries += [(table, b, f"{folder}/bucket={b}", schema, self.buckets) for b in touched]
        entry = f"{self.root}/bucket_log/version={number}"
        if exists(self.spark, f"{entry}/_SUCCESS"):
            raise RuntimeError(f"version {number} of {self.root} was written meanwhile")
        self.spark.createDataFrame(entries, BUCKET_LOG).coalesce(1).write.mode("overwrite").parquet(entry)
        return number

    def forget(self) -> None:
        """Drop the catalog's names of all versions but the current one; no file is removed."""
        last = self._log().groupBy("table").agg(F.max("version")).collect()
        current = {f"{self._prefix()}_{table}_{version}".lower() for table, version in last}
        for (name,) in self.spark.sql(f"show tables like '{self._prefix()}*'").select("tableName").collect():
            if name not in current:
                self.spark.sql(f"drop table {name}")
