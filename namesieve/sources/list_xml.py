"""Consolidated list in XML: individuals and entities at any depth.

Declared tags have fixed types. Every other tag of the file is found in a first
pass and read as a list, so the record of an entry holds all of it and does not
depend on what other entries hold. A file is read by many tasks: its entries are
cut out and written as text, the first pass takes those with the same tags once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from namesieve.sources.xml_entries import xml_entries

# Declared, so that text stays text and repeated tags are arrays.
INDIVIDUAL_SCHEMA = """
DATAID string, VERSIONNUM string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string,
FOURTH_NAME string, UN_LIST_TYPE string, REFERENCE_NUMBER string, LISTED_ON string,
COMMENTS1 string, NATIONALITY array<struct<VALUE: array<string>>>,
INDIVIDUAL_ALIAS array<struct<QUALITY: string, ALIAS_NAME: string>>,
INDIVIDUAL_DATE_OF_BIRTH array<struct<TYPE_OF_DATE: string, DATE: string, YEAR: string,
  FROM_YEAR: string, TO_YEAR: string>>,
INDIVIDUAL_ADDRESS array<struct<COUNTRY: string>>"""

ENTITY_SCHEMA = """
DATAID string, VERSIONNUM string, FIRST_NAME string, UN_LIST_TYPE string,
REFERENCE_NUMBER string, LISTED_ON string, COMMENTS1 string,
ENTITY_ALIAS array<struct<QUALITY: string, ALIAS_NAME: string>>,
ENTITY_ADDRESS array<struct<CITY: string, COUNTRY: string>>"""


def _struct(fields: dict[str, DataType]) -> StructType:
    """Tags by name, as records are compared as text."""
    out = StructType()
    for name in sorted(fields):
        out.add(name, fields[name])
    return out


def _one(found: DataType) -> DataType:
    return _one(found.elementType) if isinstance(found, ArrayType) else found


def listed(found: DataType) -> DataType:
    """The type of an undeclared tag: a list, of texts or of entries whose tags are lists."""
    one = _one(found)
    if isinstance(one, StructType):
        return ArrayType(_struct({f.name: listed(f.dataType) for f in one}))
    return ArrayType(StringType())


def merged(declared: DataType, found: DataType) -> DataType:
    """``declared`` with the undeclared tags of ``found``."""
    if isinstance(declared, ArrayType):
        return ArrayType(merged(declared.elementType, found))
    one = _one(found)
    if not (isinstance(declared, StructType) and isinstance(one, StructType)):
        return declared
    fields = {f.name: listed(f.dataType) for f in one}
    for f in declared:
        fields[f.name] = merged(f.dataType, one[f.name].dataType) if f.name in fields else f.dataType
    return _struct(fields)


def _skeletons(entries: DataFrame) -> DataFrame:
    """Entries with the same tags once: every text is one letter. Sections of raw text stay as they are."""
    short = F.regexp_replace(F.regexp_replace("entry", r">\s+<", "><"), r">[^<>]*[^<>\s][^<>]*<", ">x<")
    return entries.select(F.when(F.col("entry").contains("<!"), F.col("entry")).otherwise(short)).distinct()


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    entries = xml_entries(spark, path, tag)
    reader = spark.read.options(rowTag=tag, inferSchema=False)
    found = reader.xml(_skeletons(entries).rdd.map(lambda row: row[0])).schema
    known = merged(StructType.fromDDL(schema), found)
    # Inline, so that an entry is not parsed anew for each of its fields.
    rows = entries.select("position", F.inline(F.array(F.from_xml("entry", known))))
    return rows.select(*known.names, "position")


def read_individuals(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "INDIVIDUAL", INDIVIDUAL_SCHEMA)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "ENTITY", ENTITY_SCHEMA)
