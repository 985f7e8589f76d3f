"""How the test tables stand in for watchlist data, in Spark and in SQL.

Every clause of every document is one listed name of that document's entity;
every clause of every benchmark item or conversation turn is one screened name.
Product names serve where the comparison in SQL is quadratic: the table is read
whole, and the work is done on its distinct names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.operators.candidates import spread_scan
from namesieve.functions.text import honorific_pattern
from namesieve.params import HONORIFICS

CLAUSE = r"[.,\n]+"
STRIDE = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def clauses(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, name_id, position, name): every clause of every text."""
    parts = spread_scan(df).select(
        "*", F.posexplode(F.split(F.col(text), CLAUSE)).alias("position", "name")
    )
    return (
        parts.withColumn("name", F.trim("name"))
        .filter(F.col("name") != "")
        .withColumn("name_id", F.col(key) * STRIDE + F.col("position"))
        .drop(text)
    )


def clauses_sql(table: str, key: str, columns: str = "") -> str:
    extra = f", {columns}" if columns else ""
    return f"""
      select {key}, name_id, position, name{extra} from (
        select {key}{extra}, i as position, {key} * {STRIDE} + i as name_id,
               trim(parts[i + 1]) as name
        from (select *, regexp_split_to_array(text, '{CLAUSE}') as parts from {table}),
             lateral unnest(range(len(parts))) as r(i))
      where name <> ''"""


def norm_sql(column: str) -> str:
    return (
        f"trim(regexp_replace(replace(lower(strip_accents({column})), 'ß', 'ss'),"
        r" '[^\pL\pN]+', ' ', 'g'))"
    )


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '{honorific_pattern(HONORIFICS)}', '')"


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names: clause 0 is the primary name, the others are aliases."""
    rows = clauses(read(spark, sf_dir, "documents"), "doc_id")
    return rows.select(
        "name_id",
        F.col("doc_id").alias("entity_id"),
        F.col("name").alias("name_original"),
        F.when(F.col("position") == 0, "primary").otherwise("alias").alias("name_type"),
        F.lit(None).cast("string").alias("alias_quality"),
    )


ENTITY_TYPE_OF_LANG = {"en": "individual", "fr": "entity", "de": "vessel"}


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kind = F.lit("aircraft")
    for lang, name in ENTITY_TYPE_OF_LANG.items():
        kind = F.when(F.col("lang") == lang, name).otherwise(kind)
    return docs.select(
        F.col("doc_id").alias("entity_id"),
        F.col("source").alias("source_list"),
        F.col("doc_id").cast("string").alias("reference_number"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("primary_name"),
        kind.alias("entity_type"),
        F.col("lang").alias("nationality"),
        F.lit(None).cast("string").alias("date_of_birth"),
        F.col("n_chars").cast("string").alias("listed_date"),
    )


def benchmark_requests(spark: SparkSession, sf_dir: str, table: str = "benchmark") -> DataFrame:
    """Requests with defaults: every clause of every benchmark item."""
    rows = clauses(read(spark, sf_dir, table), "item_id")
    return rows.select(
        F.col("name_id").alias("query_id"),
        "name",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(None).cast("int").alias("max_results"),
        F.lit(None).cast("string").alias("entity_type"),
    )


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("name_id"),
        F.col("p_partkey").alias("entity_id"),
        F.col("p_name").alias("name_original"),
        F.lit("primary").alias("name_type"),
        F.col("p_brand").alias("alias_quality"),
    )


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("entity_id"),
        F.col("p_brand").alias("source_list"),
        F.col("p_partkey").cast("string").alias("reference_number"),
        F.col("p_name").alias("primary_name"),
        F.when(F.col("p_type") == "SMALL", "individual")
        .when(F.col("p_type") == "LARGE", "vessel")
        .otherwise("entity")
        .alias("entity_type"),
        F.lit(None).cast("string").alias("nationality"),
        F.lit(None).cast("string").alias("date_of_birth"),
        F.col("p_size").cast("string").alias("listed_date"),
    )


PART_TYPE_SQL = (
    "case p_type when 'SMALL' then 'individual' when 'LARGE' then 'vessel' else 'entity' end"
)

# Primary phonetic codes of the sixteen words in part.p_name.
PART_CODES = {
    "anvil": "ANFL", "blue": "PL", "bolt": "PLT", "cold": "KLT", "gear": "JR",
    "gizmo": "JSM", "hot": "HT", "large": "LRJ", "new": "N", "old": "ALT",
    "plate": "PLT", "red": "RT", "ring": "RNK", "rod": "RT", "small": "SML",
    "widget": "AJT",
}
PART_CODES_SQL = "(values " + ", ".join(f"('{t}', '{c}')" for t, c in PART_CODES.items()) + ")"

# Longest common subsequence of two strings as one list fold: the running row of
# lengths for the characters of a seen so far.
def lcs_sql(a: str, b: str) -> str:
    cells = f"range(1, length({b}) + 1)"
    row = (
        "list_reduce({cells}, lambda r, j: list_append(r, case when substr({b}, j, 1) = ch"
        " then prev[j] + 1 else greatest(prev[j + 1], r[j]) end), [0])"
    )
    row = row.replace("{cells}", cells).replace("{b}", b).replace("[0]", "[0::bigint]")
    chars = f"string_split({a}, '')"
    return (
        f"list_reduce({chars}, lambda prev, ch: {row},"
        f" list_transform(range(length({b}) + 1), lambda z: 0::bigint))[length({b}) + 1]"
    )
