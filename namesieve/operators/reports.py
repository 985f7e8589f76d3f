"""Reporting queries over the stored tables and screening results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.params import LAYERS


def list_summary(entities: DataFrame, names: DataFrame, log: DataFrame) -> DataFrame:
    """Entities, names and latest usable refresh per list.

    ``log`` is the store's run log, of which log_id, source_list, status and
    run_at are read. Names are counted per entity before the join, so a large
    entity does not multiply rows.
    """
    per_entity = names.groupBy("entity_id").agg(F.count("*").alias("n"))
    counted = (
        entities.select("source_list", "entity_id")
        .join(per_entity, "entity_id", "left")
        .groupBy("source_list")
        .agg(
            F.count("*").alias("entity_count"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("name_count"),
        )
    )
    usable = log.filter(F.col("status").isin("success", "fallback_cache"))
    latest = usable.groupBy("source_list").agg(
        F.max_by("run_at", "log_id").alias("last_refreshed"),
        F.max_by("status", "log_id").alias("last_status"),
    )
    return counted.join(latest, "source_list", "left").orderBy("source_list")


def entity_detail(entities: DataFrame, names: DataFrame, keys: DataFrame) -> DataFrame:
    """Full records of the asked-for entities, one row per name, primary name first.

    ``keys`` has (source_list, reference_number), the list in any case. Rows are
    range-sorted rather than collected, so an entity may have any number of names.
    All columns of ``entities`` come along; a ``raw_record`` also parsed, as the
    variant ``raw`` (null if it is no JSON).
    """
    if "raw_record" in entities.columns:
        entities = entities.withColumn("raw", F.try_parse_json("raw_record"))
    wanted = keys.select(F.upper("source_list").alias("source_list"), "reference_number").distinct()
    return (
        entities.join(wanted, ["source_list", "reference_number"], "left_semi")
        .join(names.select("entity_id", "name_type", "alias_quality", "name_original"), "entity_id",
              "left")
        .orderBy("source_list", "reference_number", F.col("name_type") != "primary",
                 "name_original")
    )


def match_table(payload: DataFrame) -> DataFrame:
    """Flat table of matches; a missing listing date shows as a dash."""
    return payload.select(
        "query_id",
        "rank",
        "score",
        "matched_name",
        F.col("matched_name_type").alias("name_type"),
        F.col("entity.primary_name").alias("primary_name"),
        F.col("entity.source_list").alias("list"),
        F.col("entity.reference_number").alias("reference"),
        F.col("entity.entity_type").alias("type"),
        F.coalesce("entity.listed_date", F.lit("—")).alias("listed"),
    )


def layer_long(scored: DataFrame, ids: list[str]) -> DataFrame:
    """Sub-scores in long form: one row per layer."""
    return scored.unpivot(ids, list(LAYERS), "layer", "sub_score")


def source_counts(entities: DataFrame, lists: DataFrame) -> DataFrame:
    """Entities per list, zero for lists without any. ``lists`` has (source_list)."""
    counted = entities.groupBy("source_list").agg(F.count("*").alias("entity_count"))
    return lists.join(counted, "source_list", "left").select(
        "source_list", F.coalesce("entity_count", F.lit(0)).alias("entity_count")
    )
