"""From scanned rows to the common entity and name tables.

Every list yields two tables. Entities: (source_list, reference_number,
primary_name, entity_type, nationality, date_of_birth, listed_date, raw_record,
position). Names: (source_list, reference_number, name_type, name_original,
alias_quality, position, entry). ``entry`` is the position of the entity row the name
came with, null if it belongs to every row of that key. Names are rows throughout and
are never collected.
Party files also yield raw rows: (source_list, reference_number, kind, position,
record), the aliases and addresses of each party as read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.params import ENTITY_TYPES, NAME_TYPES
from namesieve.sources.party_csv import BLANKS, PARTY_COLUMNS, stripped
from namesieve.sources.sheet_rows import SHEET_COLUMNS
from namesieve.workspace import written

ENTITY_COLUMNS = (
    "source_list", "reference_number", "primary_name", "entity_type", "nationality",
    "date_of_birth", "listed_date", "raw_record", "position",
)


@dataclass(frozen=True)
class ParsedList:
    entities: DataFrame
    names: DataFrame
    raw_rows: DataFrame | None = None


def side_summary(rows: DataFrame, key: str, fields: list[str], output: str) -> DataFrame:
    """(key, <output>_count, <output>_digest): how many rows a key has, and a digest
    of them that does not depend on their order. Both combine before the shuffle.

    Each row is hashed as JSON: ``xxhash64`` of columns skips nulls, so a value moved
    to a neighbouring null column would leave it as it was."""
    return rows.groupBy(key).agg(*side_totals(fields, output))


def side_totals(fields: list[str], output: str) -> tuple[Column, Column]:
    """The two aggregates of ``side_summary``."""
    return hash_totals(F.xxhash64(raw_json({f: F.col(f) for f in fields})), output)


def hash_totals(row: Column, output: str) -> tuple[Column, Column]:
    """Count and digest of rows by the hash of each."""
    digest = F.sum(row.cast("decimal(38,0)")).cast("string")
    return F.count("*").alias(f"{output}_count"), digest.alias(f"{output}_digest")


def side_rows(rows: DataFrame, key: str, fields: list[str], kind: str, source_list: str) -> DataFrame:
    """Each side row of a party as a raw row of its own, whole."""
    return rows.select(
        F.lit(source_list).alias("source_list"), F.col(key).alias("reference_number"),
        F.lit(kind).alias("kind"), F.col("position").cast("string").alias("position"),
        raw_json({f: F.col(f) for f in fields}).alias("record"),
    )


def raw_json(fields: dict[str, Column]) -> Column:
    """Key-sorted JSON of a record."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def mapped_type(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """Lower-cased value if it is one of the allowed ones, else the default."""
    return F.when(F.lower(value).isin(*allowed), F.lower(value)).otherwise(default)


# ------------------------------------------------------------ party files


def birth_dates(remarks: Column) -> Column:
    """Every date-of-birth mention, joined by '; '."""
    found = F.regexp_extract_all(remarks, F.lit(r"(?i)DOB[:\s]+([^;]+)"), F.lit(1))
    return F.nullif(F.array_join(F.transform(found, lambda d: F.trim(d, F.lit(BLANKS))), "; "), F.lit(""))


def first_nationality(remarks: Column) -> Column:
    found = F.regexp_extract(remarks, r"(?i)nationality[:\s]+([^;]+)", 1)
    return stripped(found)


def merged_remarks(parties: DataFrame, overflow: DataFrame) -> DataFrame:
    """Remarks with the last overflow row of the party appended."""
    last = overflow.groupBy("ent_num").agg(F.max_by("comment", "position").alias("comment"))
    remarks = F.nullif(F.concat_ws(" ", "remarks", "comment"), F.lit(""))
    return parties.join(last, "ent_num", "left").withColumn("remarks", remarks).drop("comment")


def shape_parties(
    parties: DataFrame,
    aliases: DataFrame,
    addresses: DataFrame,
    overflow: DataFrame,
    source_list: str = "OFAC",
) -> ParsedList:
    full = merged_remarks(parties, overflow)
    kinds = {
        "aliases": (aliases, ["alt_type", "alt_name"]),
        "addresses": (addresses, ["address", "city_state_zip", "country"]),
    }
    side, record = full, {c: F.col(c) for c in PARTY_COLUMNS}
    raw_rows = None
    for kind, (rows, fields) in kinds.items():
        side = side.join(side_summary(rows, "ent_num", fields, kind), "ent_num", "left")
        record[f"{kind}_count"] = F.coalesce(f"{kind}_count", F.lit(0))
        record[f"{kind}_digest"] = F.coalesce(f"{kind}_digest", F.lit("0"))
        known = rows.join(parties.select("ent_num"), "ent_num", "left_semi")
        found = side_rows(known, "ent_num", fields, kind, source_list)
        raw_rows = found if raw_rows is None else raw_rows.unionByName(found)
    entities = side.select(
        F.lit(source_list).alias("source_list"),
        F.col("ent_num").alias("reference_number"),
        F.col("sdn_name").alias("primary_name"),
        mapped_type(F.col("sdn_type"), ("individual", "vessel", "aircraft"), "entity").alias(
            "entity_type"
        ),
        first_nationality(F.col("remarks")).alias("nationality"),
        birth_dates(F.col("remarks")).alias("date_of_birth"),
        F.lit(None).cast("string").alias("listed_date"),
        raw_json(record).alias("raw_record"),
        "position",
    )

    no_entry = F.lit(None).cast(parties.schema["position"].dataType)

    def names(rows: DataFrame, kind: Column, name: str, order: int, entry: Column) -> DataFrame:
        return rows.select(
            F.lit(source_list).alias("source_list"),
            F.col("ent_num").alias("reference_number"),
            kind.alias("name_type"),
            F.col(name).alias("name_original"),
            F.lit(None).cast("string").alias("alias_quality"),
            F.struct(F.lit(order).alias("section"), "position").alias("position"),
            entry.alias("entry"),
        )

    alias_kind = mapped_type(F.col("alt_type"), ("aka", "fka", "nka"), "aka")
    known = aliases.filter(F.col("alt_name").isNotNull()).join(
        parties.select("ent_num"), "ent_num", "left_semi"
    )
    return ParsedList(
        entities,
        names(parties, F.lit("primary"), "sdn_name", 0, F.col("position")).unionByName(
            names(known, alias_kind, "alt_name", 1, no_entry)
        ),
        raw_rows,
    )


# ------------------------------------------------------------ XML list


def full_name(*parts: Column) -> Column:
    """Name parts joined by a space, empty ones skipped."""
    return F.nullif(F.concat_ws(" ", *(stripped(p) for p in parts)), F.lit(""))


def formatted_birth_dates(dates: Column) -> Column:
    """Exact, approximate and between dates as text, joined by '; '."""

    def one(d: Column) -> Column:
        kind = F.upper(F.coalesce(stripped(d["TYPE_OF_DATE"]), F.lit("")))
        exact = F.coalesce(stripped(d["DATE"]), stripped(d["YEAR"]))
        start, end = stripped(d["FROM_YEAR"]), stripped(d["TO_YEAR"])
        span = F.concat(
            F.lit("between "), F.coalesce(start, F.lit("?")),
            F.lit(" and "), F.coalesce(end, F.lit("?")),
        )
        return (
            F.when(kind == "BETWEEN", F.when(start.isNotNull() | end.isNotNull(), span))
            .when(kind == "APPROXIMATELY", F.concat(F.lit("approximately "), exact))
            .otherwise(exact)
        )

    texts = F.array_compact(F.transform(dates, one))
    return F.nullif(F.array_join(texts, "; "), F.lit(""))


def joined_nationalities(nationality: Column) -> Column:
    values = F.flatten(F.transform(nationality, lambda n: F.coalesce(n["VALUE"], F.array())))
    return F.nullif(F.array_join(F.array_compact(F.transform(values, stripped)), "; "), F.lit(""))


def reference_or_id(reference: Column, data_id: Column) -> Column:
    fallback = F.concat(F.lit("DATAID-"), F.coalesce(stripped(data_id), F.lit("None")))
    return F.coalesce(stripped(reference), fallback)


def _xml_names(rows: DataFrame, aliases: str) -> DataFrame:
    key = ["source_list", "reference_number"]
    primary = rows.select(
        *key,
        F.lit("primary").alias("name_type"),
        F.col("primary_name").alias("name_original"),
        F.lit(None).cast("string").alias("alias_quality"),
        F.struct("position", F.lit(-1).alias("item")).alias("position"),
        F.col("position").alias("entry"),
    )
    exploded = rows.select(
        *key, "position", F.posexplode(aliases).alias("item", "alias")
    ).select(
        *key,
        F.lit("alias").alias("name_type"),
        stripped(F.col("alias.ALIAS_NAME")).alias("name_original"),
        stripped(F.col("alias.QUALITY")).alias("alias_quality"),
        F.struct("position", "item").alias("position"),
        F.col("position").alias("entry"),
    )
    return primary.unionByName(exploded.filter(F.col("name_original").isNotNull()))


def _shape_xml(rows: DataFrame, kind: str, source_list: str, columns: dict[str, Column]) -> ParsedList:
    aliases = "INDIVIDUAL_ALIAS" if kind == "individual" else "ENTITY_ALIAS"
    tags = [c for c in rows.columns if c != "position"]
    shaped = rows.select(
        F.lit(source_list).alias("source_list"),
        reference_or_id(F.col("REFERENCE_NUMBER"), F.col("DATAID")).alias("reference_number"),
        columns["primary_name"].alias("primary_name"),
        F.lit(kind).alias("entity_type"),
        columns["nationality"].alias("nationality"),
        columns["date_of_birth"].alias("date_of_birth"),
        stripped(F.col("LISTED_ON")).alias("listed_date"),
        F.to_json(F.struct(*(F.col(f"`{t}`") for t in sorted(tags)))).alias("raw_record"),
        "position",
        aliases,
    ).filter(F.col("primary_name").isNotNull())
    return ParsedList(shaped.select(*ENTITY_COLUMNS), _xml_names(shaped, aliases))


def shape_individuals(rows: DataFrame, source_list: str = "UN") -> ParsedList:
    parts = ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")
    return _shape_xml(
        rows,
        "individual",
        source_list,
        {
            "primary_name": full_name(*(F.col(p) for p in parts)),
            "nationality": joined_nationalities(F.col("NATIONALITY")),
            "date_of_birth": formatted_birth_dates(F.col("INDIVIDUAL_DATE_OF_BIRTH")),
        },
    )


def shape_entities(rows: DataFrame, source_list: str = "UN") -> ParsedList:
    nothing = F.lit(None).cast("string")
    return _shape_xml(
        rows,
        "entity",
        source_list,
        {
            "primary_name": stripped(F.col("FIRST_NAME")),
            "nationality": nothing,
            "date_of_birth": nothing,
        },
    )


# ------------------------------------------------------------ sheet rows

# Name types as the sheet spells them.
SHEET_NAME_TYPES = {
    "primary name": "primary",
    "alias": "alias",
    "aka": "aka",
    "original script": "original_script",
}


def group_key(reference: Column) -> Column:
    """Numeric prefix of references like '12b', else the whole reference."""
    number = F.regexp_extract(reference, r"(?i)^(\d+)\s*[a-z]*$", 1)
    return F.coalesce(F.nullif(number, F.lit("")), reference)


def sheet_name_type(value: Column) -> Column:
    kind = F.lit("alias")
    for text, name in SHEET_NAME_TYPES.items():
        kind = F.when(F.lower(value) == text, name).otherwise(kind)
    return kind


def shape_sheet(rows: DataFrame, source_list: str = "DFAT", path: str | None = None) -> ParsedList:
    """Entities, names and raw rows of a sheet. With ``path`` the shaped rows are written there once for all three."""
    is_primary = F.coalesce(F.lower("name_type") == "primary name", F.lit(False))
    head = ["name", "type", "citizenship", "date_of_birth", "control_date"]
    keyed = rows.select(
        group_key(F.col("reference")).alias("reference_number"), "position", *head, "alias_strength",
        sheet_name_type(F.col("name_type")).alias("name_type"), (~is_primary).alias("other"),
        raw_json({f: F.col(f) for f in sorted(SHEET_COLUMNS)}).alias("record"),
    ).withColumn("row_hash", F.xxhash64("record"))
    keyed = keyed if path is None else written(keyed, path)
    # The head and the summary of a key in one pass over the rows.
    grouped = keyed.filter(F.col("reference_number").isNotNull()).groupBy("reference_number").agg(
        F.min_by(F.struct(*head), F.struct("other", "position")).alias("head"),
        F.min("position").alias("position"),
        *hash_totals(F.col("row_hash"), "rows"),
    )
    entities = grouped.select(
        F.lit(source_list).alias("source_list"),
        "reference_number",
        F.col("head.name").alias("primary_name"),
        mapped_type(F.col("head.type"), ENTITY_TYPES, "entity").alias("entity_type"),
        F.col("head.citizenship").alias("nationality"),
        F.col("head.date_of_birth").alias("date_of_birth"),
        F.col("head.control_date").alias("listed_date"),
        # The head, because the digest of all rows does not tell which of them comes first.
        raw_json({c: F.col(c) for c in ("head", "rows_count", "rows_digest")}).alias("raw_record"),
        "position",
    )
    names = keyed.select(
        F.lit(source_list).alias("source_list"),
        "reference_number",
        "name_type",
        F.col("name").alias("name_original"),
        F.col("alias_strength").alias("alias_quality"),
        "position",
        F.lit(None).cast(keyed.schema["position"].dataType).alias("entry"),
    )
    raw_rows = keyed.select(
        F.lit(source_list).alias("source_list"), "reference_number", F.lit("rows").alias("kind"),
        F.col("position").cast("string").alias("position"), "record",
    )
    return ParsedList(entities, names, raw_rows)


# ------------------------------------------------------------ domain checks


def domain_violations(parsed: ParsedList) -> DataFrame:
    """Rows whose entity_type or name_type is outside the closed vocabularies."""
    key = ["source_list", "reference_number"]
    return (
        parsed.entities.filter(~F.col("entity_type").isin(*ENTITY_TYPES))
        .select(*key, F.lit("entity_type").alias("field"), F.col("entity_type").alias("value"))
        .unionByName(
            parsed.names.filter(~F.col("name_type").isin(*NAME_TYPES)).select(
                *key, F.lit("name_type").alias("field"), F.col("name_type").alias("value")
            )
        )
    )


def require_domain(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Fail the job on a value outside the vocabulary."""
    problem = F.concat(F.lit(f"invalid {column} "), F.coalesce(F.col(column), F.lit("null")))
    return df.withColumn(
        column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(problem))
    )
