"""Stored tables: versioned list snapshots and append-only logs, as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.sources.fingerprints import file_fingerprints, list_fingerprint
from namesieve.workspace import create_file

__all__ = [
    "LOG_SCHEMA", "ListStore", "file_fingerprints", "list_fingerprint", "read_cases", "read_or_none", "read_vectors",
    "write_cases", "write_vectors",
]

LOG_SCHEMA = """log_id bigint, run_at timestamp, source_list string, status string, source_url string,
file_sha256 string, entities_inserted bigint, entities_updated bigint, names_total bigint,
duration_ms bigint, message string"""


@dataclass(frozen=True)
class RunLogs:
    """Append-only logs under a store's folder."""

    spark: SparkSession
    root: str

    def append_log(self, rows: DataFrame, log: str = "ingestion_log") -> None:
        rows.write.mode("append").parquet(f"{self.root}/{log}")

    def append_run(self, rows: DataFrame) -> int:
        """Append the log rows of one run under the next ``log_id``.

        The number is claimed by creating a file of that name, so runs that meet
        take different ones.
        """
        number = (self.read_log().agg(F.max("log_id")).first()[0] or 0) + 1
        while not create_file(self.spark, f"{self.root}/run_numbers/{number}"):
            number += 1
        self.append_log(rows.withColumn("log_id", F.lit(number).cast("bigint")))
        return number

    def read_log(self, log: str = "ingestion_log", schema: str = LOG_SCHEMA) -> DataFrame:
        found = read_or_none(self.spark, f"{self.root}/{log}")
        return self.spark.createDataFrame([], schema) if found is None else found


@dataclass(frozen=True)
class ListStore(RunLogs):
    """A folder with numbered versions of tables, and a log of the current one of every list.

    A list is a value of ``partition_by``. A version holds some lists and is
    written to its own folder first; only then its number is logged for each of
    them, so other lists are neither read nor rewritten. Readers never see a
    half-written version, and a version being read is never overwritten. Two
    writers that meet take the same number, and the later one fails.
    """

    partition_by: str = "source_list"

    def versions(self) -> dict[str, int]:
        """The current version of each list; there are as many rows as lists."""
        log = read_or_none(self.spark, f"{self.root}/version_log")
        if log is None:
            return {}
        return dict(log.groupBy("list").agg(F.max("version")).collect())

    def commit(self, tables: dict[str, DataFrame], lists: list[str]) -> int:
        """Make ``tables`` the current version of ``lists``; its number."""
        version = max(self.versions().values(), default=0) + 1
        for name, df in tables.items():
            writer = df.write.mode("errorifexists").partitionBy(self.partition_by)
            writer.parquet(f"{self.root}/versions/{version}/{name}")
        entries = [(name, version) for name in lists]
        rows = self.spark.createDataFrame(entries, "list string, version bigint")
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/version_log")
        return version

    def read(self, table: str, lists: list[str] | None = None) -> DataFrame | None:
        """The current rows of all lists, or of some. Each scan prunes to its lists' folders."""
        by_version: dict[int, list[str]] = {}
        for name, version in self.versions().items():
            if lists is None or name in lists:
                by_version.setdefault(version, []).append(name)
        found = None
        for version, names in sorted(by_version.items()):
            path = f"{self.root}/versions/{version}/{table}"
            part = read_or_none(self.spark, path)
            if part is not None:  # a list's name is text, also if it looks like a number
                kinds = {self.partition_by: "string"}
                schema = ", ".join(f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in part.schema)
                part = self.spark.read.schema(schema).parquet(path)
                part = part.filter(F.col(self.partition_by).isin(names))
                found = part if found is None else found.unionByName(part)
        return found


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where there is none or it was written without rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(vector_key, model, vector); one folder per model."""
    vectors.write.mode("append").partitionBy("model").parquet(path)


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Vectors of one model, in key order. The filter prunes to the model's folder."""
    stored = spark.read.parquet(path).filter(F.col("model") == model)
    return stored.orderBy("vector_key")


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("errorifexists").json(path)


CASE_SCHEMA = (
    "case_id string, query string, perturbation string, original_name string,"
    " truth struct<source_list: string, reference_number: string>"
)
DOCUMENT_SCHEMA = (
    "seed bigint, cases array<struct<case_id: string, query: string, perturbation: string,"
    " original_name: string, truth: struct<source_list: string, reference_number: string>>>"
)


def read_cases(spark: SparkSession, path: str, single_document: bool = False) -> DataFrame:
    """Evaluation cases, one JSON object per line or one ``{seed, cases: [...]}`` document."""
    if not single_document:
        return spark.read.schema(CASE_SCHEMA).json(path)
    document = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
    return document.select(F.inline("cases"))
