"""Rows of an exported sheet: header names in any case, with alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.sources.party_csv import stripped
from namesieve.sources.quoted_csv import read_csv

# Output column and the header names it may have, best first.
SHEET_COLUMNS = {
    "reference": ("reference",),
    "name": ("name of individual or entity", "name"),
    "type": ("type",),
    "name_type": ("name type",),
    "alias_strength": ("alias strength",),
    "date_of_birth": ("date of birth",),
    "place_of_birth": ("place of birth",),
    "citizenship": ("citizenship",),
    "address": ("address",),
    "additional_information": ("additional information",),
    "listing_information": ("listing information",),
    "committees": ("committees",),
    "control_date": ("control date",),
    "instrument": ("instrument of designation",),
}

_TIMESTAMP = r"^(\d{4}-\d{2}-\d{2})[ T]\d{2}:.*$"


def cell_text(cell: Column) -> Column:
    """Trimmed text; a timestamp loses its time of day, other text stays as it is."""
    text = stripped(cell.cast("string"))
    # The fifth character tells most other text without the pattern.
    dated = F.substring(text, 5, 1) == "-"
    return F.when(dated, F.regexp_replace(text, _TIMESTAMP, "$1")).otherwise(text)


def sheet_rows(raw: DataFrame, position: str = "position") -> DataFrame:
    """The known columns of each row that has a reference and a name."""
    header = {c.strip().lower(): c for c in raw.columns}

    def pick(names: tuple[str, ...]) -> Column:
        present = [header[n] for n in names if n in header]
        return cell_text(F.col(f"`{present[0]}`")) if present else F.lit(None).cast("string")

    rows = raw.select(position, *(pick(names).alias(c) for c, names in SHEET_COLUMNS.items()))
    return rows.filter(F.col("reference").isNotNull() & F.col("name").isNotNull())


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An exported sheet: Parquet, or CSV with a header row.

    Cells of a CSV file may hold line breaks; see ``quoted_csv``.
    """
    if not path.rstrip("/").endswith(".parquet"):
        return sheet_rows(read_csv(spark, path))
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return sheet_rows(spark.read.parquet(path).withColumn("position", place))
