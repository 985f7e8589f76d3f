"""Idempotent upsert of list snapshots, as joins on the list key.

An entity is known by (source_list, reference_number), a name by that key with
(name_type, name_original). Ids are hashes of those keys, so re-ingesting an
unchanged list keeps every id, and no id is ever given to another row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.functions.phonetics import phonetic_codes, phonetic_key
from namesieve.functions.text import normalise_name

ENTITY_KEY = ["source_list", "reference_number"]
NAME_KEY = [*ENTITY_KEY, "name_type", "name_original"]
ENTITY_FIELDS = [
    "primary_name", "entity_type", "nationality", "date_of_birth", "listed_date", "raw_record",
]


def entity_id() -> Column:
    return F.xxhash64(*ENTITY_KEY)


def name_id() -> Column:
    return F.xxhash64(*NAME_KEY)


def last_per_key(rows: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """A key repeated within a batch keeps its last occurrence."""
    others = [c for c in rows.columns if c not in (*keys, position)]
    last = F.max_by(F.struct(*others), F.col(position)).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def classify(old: DataFrame, new: DataFrame, keys: list[str] = ENTITY_KEY) -> DataFrame:
    """Per key: inserted, updated, unchanged, or absent from the new snapshot.

    Only ``raw_record`` decides whether an entity changed.
    """
    before = old.select(*keys, F.col("raw_record").alias("_old"))
    after = new.select(*keys, F.col("raw_record").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "inserted")
        .when(F.col("_new").isNull(), "absent")
        .when(F.col("_old") == F.col("_new"), "unchanged")
        .otherwise("updated")
    )
    return before.join(after, keys, "full").select(*keys, change.alias("change"))


def apply_upsert(
    old: DataFrame, new: DataFrame, now: Column, keys: list[str] = ENTITY_KEY,
    fields: list[str] = ENTITY_FIELDS,
) -> DataFrame:
    """The next version of the entity table.

    ``first_seen_at`` is kept, ``last_updated_at`` moves only on a change, and
    entities absent from the batch stay as they are.
    """
    before = old.select(*keys, F.struct(*fields, "first_seen_at", "last_updated_at").alias("_old"))
    after = new.select(*keys, F.struct(*fields).alias("_new"))
    joined = before.join(after, keys, "full")
    changed = F.col("_new").isNotNull() & (
        F.col("_old").isNull() | (F.col("_old.raw_record") != F.col("_new.raw_record"))
    )
    return joined.select(
        *keys,
        *(F.when(changed, F.col(f"_new.{f}")).otherwise(F.col(f"_old.{f}")).alias(f) for f in fields),
        F.coalesce("_old.first_seen_at", now).alias("first_seen_at"),
        F.when(changed, now).otherwise(F.col("_old.last_updated_at")).alias("last_updated_at"),
    )


def distinct_names(names: DataFrame, keys: list[str] = NAME_KEY) -> DataFrame:
    """One row per name key: the first quality wins, blank names are dropped."""
    quality = F.min_by(F.struct("alias_quality"), F.col("position"))["alias_quality"]
    present = F.length(F.trim(F.col("name_original"), F.lit(" \t\r\n\f\v"))) > 0
    return names.filter(present).groupBy(*keys).agg(quality.alias("alias_quality"))


def name_changes(old: DataFrame, new: DataFrame, keys: list[str] = NAME_KEY) -> DataFrame:
    """Per name of an entity in the batch: kept, added, removed or requalified."""
    entity = [k for k in keys if k not in ("name_type", "name_original")]
    current = old.join(new.select(*entity).distinct(), entity, "left_semi")
    before = current.select(*keys, F.struct("alias_quality").alias("_old"))
    after = new.select(*keys, F.struct("alias_quality").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "kept")
        .otherwise("requalified")
    )
    return before.join(after, keys, "full").select(*keys, change.alias("change"))


def name_digests(names: DataFrame, keys: list[str] = ENTITY_KEY) -> DataFrame:
    """(keys, name_count, name_digest): an entity's names as one value, whatever their order.

    It combines before a shuffle, and needs none where rows of a key lie together.
    """
    row = F.to_json(F.struct("name_type", "name_original", "alias_quality"), {"ignoreNullFields": "false"})
    digest = F.sum(F.xxhash64(row).cast("decimal(38,0)"))
    return names.groupBy(*keys).agg(F.count("*").alias("name_count"), digest.alias("name_digest"))


def batch_changes(
    old: DataFrame, old_names: DataFrame, new: DataFrame, new_names: DataFrame, keys: list[str] = ENTITY_KEY
) -> DataFrame:
    """Per key of the batch: inserted, updated or unchanged, and whether its names are others than before.

    Stored rows meet the batch by their key only, so buckets of it are joined as they lie.
    """
    before = old.select(*keys, F.col("raw_record").alias("_old"))
    after = new.select(*keys, F.col("raw_record").alias("_new"))
    named = [name_digests(rows, keys).select(*keys, F.struct("name_count", "name_digest").alias(side))
             for rows, side in ((old_names, "_had"), (new_names, "_has"))]
    joined = after.join(before, keys, "left")
    for side in named:
        joined = joined.join(side, keys, "left")
    change = (
        F.when(F.col("_old").isNull(), "inserted")
        .when(F.col("_old") == F.col("_new"), "unchanged")
        .otherwise("updated")
    )
    return joined.select(
        *keys, change.alias("change"), (~F.col("_had").eqNullSafe(F.col("_has"))).alias("names_changed")
    )


def next_names(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The next version of the name table.

    Entities in the batch get exactly the batch's matchable names; other
    entities keep theirs. ``new`` may hold ``name_normalised`` already.
    """
    known = "name_normalised" in new.columns
    form = F.col("name_normalised") if known else normalise_name(F.col("name_original"))
    rows = (
        new.withColumn("name_normalised", F.explode(F.filter(F.array(form), lambda f: f != "")))
        .withColumn("_codes", phonetic_codes(F.array("name_normalised"))[0])
        .select(
            name_id().alias("name_id"),
            entity_id().alias("entity_id"),
            *NAME_KEY,
            "alias_quality",
            "name_normalised",
            phonetic_key("_codes").alias("metaphone_key"),
        )
    )
    if old is None:
        return rows
    untouched = old.join(new.select(*ENTITY_KEY).distinct(), ENTITY_KEY, "left_anti")
    return untouched.select(*rows.columns).unionByName(rows)


def without_orphans(names: DataFrame, entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """Names of entities that exist."""
    return names.join(entities.select(key), key, "left_semi")


def run_statistics(changes: DataFrame, names: DataFrame) -> DataFrame:
    """Inserted, updated and unchanged entities and distinct names, per list."""

    def times(kind: str) -> Column:
        return F.count_if(F.col("change") == kind).alias(kind)

    counted = changes.groupBy("source_list").agg(
        times("inserted"), times("updated"), times("unchanged"), times("absent")
    )
    totals = names.groupBy("source_list").agg(F.count("*").alias("names_total"))
    return counted.join(totals, "source_list", "left").withColumn(
        "names_total", F.coalesce("names_total", F.lit(0))
    )


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when the key is unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def colliding_ids(rows: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """Ids that two different keys have; ``rows`` may repeat a key."""
    key = F.struct(*keys)
    ends = rows.groupBy(id_column).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    return ends.filter("first <> last")


@dataclass(frozen=True)
class RunOutcome:
    status: str
    source_url: str | None = None
    file_sha256: str | None = None
    duration_ms: int | None = None
    message: str | None = None


def log_rows(statistics: DataFrame, outcome: RunOutcome, run_at: Column) -> DataFrame:
    """Log rows of one successful run, one per list in the statistics."""
    return statistics.select(
        run_at.alias("run_at"),
        "source_list",
        F.lit(outcome.status).alias("status"),
        F.lit(outcome.source_url).cast("string").alias("source_url"),
        F.lit(outcome.file_sha256).cast("string").alias("file_sha256"),
        F.col("inserted").alias("entities_inserted"),
        F.col("updated").alias("entities_updated"),
        "names_total",
        F.lit(outcome.duration_ms).cast("bigint").alias("duration_ms"),
        F.lit(outcome.message).cast("string").alias("message"),
    )
