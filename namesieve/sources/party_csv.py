"""Headerless party files in CSV: parties, aliases, addresses, remark overflow.

Files are read as lines, so they split across tasks. The encoding is decided
per file: a file that is not valid UTF-8 as a whole is taken as Latin-1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the four files, in file order.
PARTY_COLUMNS = (
    "ent_num", "sdn_name", "sdn_type", "program", "title", "call_sign",
    "vess_type", "tonnage", "grt", "vess_flag", "vess_owner", "remarks",
)
ALIAS_COLUMNS = ("ent_num", "alt_num", "alt_type", "alt_name")
ADDRESS_COLUMNS = ("ent_num", "add_num", "address", "city_state_zip", "country")
OVERFLOW_COLUMNS = ("ent_num", "comment")
SENTINEL = "-0-"

# Possessive, so that a field of any length needs no stack.
_FIELD = r'(?:^|,)(?:"[^"]*+(?:""[^"]*+)*+"|[^,]*+)'
BLANKS = " \t\r\n\f\v"


def stripped(value: Column) -> Column:
    """Trim all blanks; an empty text becomes null."""
    return F.nullif(F.trim(value, F.lit(BLANKS)), F.lit(""))


def cleaned(value: Column) -> Column:
    """Trim; an empty text or the file's null sentinel becomes null."""
    return F.nullif(stripped(value), F.lit(SENTINEL))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, position, line) with the encoding settled per file."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("position"),
    )
    by_file = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("valid"))
        .groupBy("path")
        .agg(F.bool_and("valid").alias("utf8"))
    )
    line = F.when(F.col("utf8"), F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    )
    # One row a file: safe to broadcast, and lines of one file stay in many tasks.
    return raw.join(F.broadcast(by_file), "path").select("path", "position", line.alias("line"))


def parse_lines(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One column per field, plus the number of fields the line has.

    Further fields of an over-long line are dropped.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    fields = F.from_csv("line", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"'})
    count = F.size(F.regexp_extract_all("line", F.lit(_FIELD), F.lit(0)))
    # Inline, so that a line is not parsed anew for each of its fields.
    return lines.select("position", "line", count.alias("n_fields"), F.inline(F.array(fields)))


@dataclass(frozen=True)
class Scan:
    rows: DataFrame
    rejected: DataFrame


def _scan(lines: DataFrame, columns: tuple[str, ...], required: tuple[str, ...]) -> Scan:
    parsed = parse_lines(lines, columns)
    tidy = parsed.select(
        "position",
        "line",
        "n_fields",
        stripped(F.col("ent_num")).alias("ent_num"),
        *(cleaned(F.col(c)).alias(c) for c in columns if c != "ent_num"),
    )
    reason = F.when(F.col("n_fields") < len(columns), "short_row")
    for column in required:
        reason = reason.when(F.col(column).isNull(), f"missing_{column}")
    judged = tidy.withColumn("reason", reason)
    return Scan(
        judged.filter("reason is null").drop("line", "n_fields", "reason"),
        judged.filter("reason is not null").select("position", "line", "reason"),
    )


def scan_parties(lines: DataFrame) -> Scan:
    return _scan(lines, PARTY_COLUMNS, ("ent_num", "sdn_name"))


def scan_aliases(lines: DataFrame) -> Scan:
    return _scan(lines, ALIAS_COLUMNS, ())


def scan_addresses(lines: DataFrame) -> Scan:
    return _scan(lines, ADDRESS_COLUMNS, ())


def scan_overflow(lines: DataFrame) -> Scan:
    return _scan(lines, OVERFLOW_COLUMNS, ("comment",))


def read_optional_lines(spark: SparkSession, path: str | None) -> DataFrame:
    """Lines of a file that may be missing; then an empty table."""
    if path is not None:
        try:
            return read_lines(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    schema = "path string, position struct<block: bigint, row: bigint>, line string"
    return spark.createDataFrame([], schema)
