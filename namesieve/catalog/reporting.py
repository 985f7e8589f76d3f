"""Registered queries: reports and continuous screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.catalog.matching import (
    SCREEN_EXACT_SQL,
    SCREEN_FULL_SQL,
    _LAYERS_SQL,
    _layer_rows,
    letter_frequencies,
    part_requests,
)
from namesieve.catalog.tables import (
    benchmark_requests,
    document_entities,
    document_names,
    part_entities,
    part_names,
    read,
)
from namesieve.operators.index import build_index
from namesieve.operators.index_store import IndexStore
from namesieve.operators.reports import (
    entity_detail,
    layer_long,
    list_summary,
    match_table,
    source_counts,
)
from namesieve.operators.vector_store import VectorStore
from namesieve.params import ScreeningParams
from namesieve.streaming.continuous import request_stream, start_pinned_screening, start_screening
from namesieve.workspace import work_folder, written


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """Customers per segment, their orders as names, their events as the log; suppliers are a list without either."""
    customer = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("source_list")
    )
    suppliers = read(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("entity_id"), F.lit("SUPPLIERS").alias("source_list")
    )
    names = read(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"))
    log = read(spark, sf, "events").join(customer, F.col("user_id") == F.col("entity_id")).select(
        F.col("event_id").alias("log_id"),
        "source_list",
        F.when(F.col("event_type") == "purchase", "success")
        .when(F.col("event_type") == "view", "fallback_cache").otherwise("failed").alias("status"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("run_at"),
    )
    return list_summary(customer.unionByName(suppliers), names, log)


SUMMARY_SQL = """
with n as (select c_mktsegment as source_list, count(distinct c_custkey) as entity_count,
                  count(o_orderkey) as name_count
           from customer left join orders on o_custkey = c_custkey group by 1
           union all select 'SUPPLIERS', count(*), 0 from supplier),
l as (select c_mktsegment as source_list, arg_max(strftime(ts, '%Y-%m-%d %H:%M:%S'), event_id) as last_refreshed,
             arg_max(case event_type when 'purchase' then 'success' else 'fallback_cache' end, event_id)
               as last_status
      from events join customer on user_id = c_custkey
      where event_type in ('purchase', 'view') group by 1)
select source_list, entity_count, name_count, last_refreshed, last_status
from n left join l using (source_list)"""


def detail(spark: SparkSession, sf: str) -> DataFrame:
    part, line = read(spark, sf, "part"), read(spark, sf, "lineitem")
    entities = part.select(
        F.col("p_partkey").alias("entity_id"), F.upper("p_brand").alias("source_list"),
        F.col("p_partkey").cast("string").alias("reference_number"),
        F.col("p_name").alias("primary_name"),
        F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("raw_record"),
    )
    stamps = line.groupBy(F.col("l_partkey").alias("entity_id")).agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_seen_at"),
        F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_updated_at"),
    )
    entities = entities.join(stamps, "entity_id", "left")
    names = line.select(
        F.col("l_partkey").alias("entity_id"),
        F.when(F.col("l_linenumber") == 1, "primary").otherwise("aka").alias("name_type"),
        F.col("l_returnflag").alias("alias_quality"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name_original"),
    )
    keys = part.select(
        F.lower("p_brand").alias("source_list"),
        F.col("p_partkey").cast("string").alias("reference_number"),
    )
    found = entity_detail(entities, names, keys)
    return found.withColumn("raw", F.variant_get("raw", "$.size", "int")).withColumnRenamed("raw", "raw_size")


DETAIL_SQL = """
with stamps as (select l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') as first_seen_at,
                       strftime(max(l_shipdate), '%Y-%m-%d') as last_updated_at from lineitem group by 1)
select p_partkey as entity_id, upper(p_brand) as source_list,
       p_partkey::varchar as reference_number, p_name as primary_name,
       '{"brand":"' || p_brand || '","size":' || p_size || '}' as raw_record, p_size::int as raw_size,
       first_seen_at, last_updated_at,
       case when l_linenumber = 1 then 'primary' when l_linenumber > 1 then 'aka' end as name_type,
       l_returnflag as alias_quality, 's' || l_suppkey as name_original
from part left join lineitem on l_partkey = p_partkey left join stamps using (l_partkey)"""


def matches_flat(spark: SparkSession, sf: str) -> DataFrame:
    part, line = read(spark, sf, "part"), read(spark, sf, "lineitem")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    payload = joined.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"),
        F.col("l_quantity").alias("score"), F.col("p_name").alias("matched_name"),
        F.col("l_returnflag").alias("matched_name_type"),
        F.struct(
            F.col("p_name").alias("primary_name"), F.col("p_brand").alias("source_list"),
            F.col("p_partkey").cast("string").alias("reference_number"),
            F.lower("p_type").alias("entity_type"),
            F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd"))
            .alias("listed_date"),
        ).alias("entity"),
    )
    return match_table(payload)


MATCH_TABLE_SQL = """
select l_orderkey as query_id, l_linenumber as rank, l_quantity as score, p_name as matched_name,
       l_returnflag as name_type, p_name as primary_name, p_brand as list,
       p_partkey::varchar as reference, lower(p_type) as type,
       case when l_linestatus = 'O' then strftime(l_shipdate, '%Y-%m-%d') else '—' end as listed
from lineitem join part on l_partkey = p_partkey"""


def layers(spark: SparkSession, sf: str) -> DataFrame:
    return layer_long(_layer_rows(spark, sf), ["l_orderkey", "l_linenumber"])


LAYERS_SQL = f"""
with {_LAYERS_SQL}
select l_orderkey, l_linenumber, layer, sub_score
from l unpivot include nulls (sub_score for layer in (exact, phonetic, fuzzy, embedding))"""


def counts(spark: SparkSession, sf: str) -> DataFrame:
    lists = read(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("source_list")
    )
    entities = read(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("source_list")
    )
    return source_counts(entities, lists)


COUNTS_SQL = """
select n_nationkey::varchar as source_list, count(s_suppkey) as entity_count
from nation left join supplier on s_nationkey = n_nationkey group by 1"""


def screen_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The exact screening job fed from a file stream; the answers are read back."""
    folder = work_folder(spark)
    params = ScreeningParams()
    names, entities = document_names(spark, sf), document_entities(spark, sf)
    index = build_index(names, entities, f"{folder}/index", params, fuzzy=False)
    written(benchmark_requests(spark, sf), f"{folder}/requests")
    query = start_screening(
        request_stream(spark, f"{folder}/requests"), index, names, entities,
        f"{folder}/answers", f"{folder}/checkpoint", params, fuzzy=False, phonetic=False,
    )
    query.awaitTermination()
    answers = spark.read.parquet(f"{folder}/answers/matches")
    return answers.select(
        "query_id", "rank", F.col("entity.reference_number").alias("reference_number"),
        "layers.exact",
    )


SCREEN_STREAM_SQL = f"""
select query_id, rank, entity_id::varchar as reference_number, exact from ({SCREEN_EXACT_SQL})"""


def screen_stream_full(spark: SparkSession, sf: str) -> DataFrame:
    """All four layers over a stream of reordered product names.

    The lists are refreshed twice before the stream starts, so the batches are
    answered by a base and a segment.
    """
    folder = work_folder(spark)
    store = IndexStore(spark, f"{folder}/lists", ScreeningParams(), vectors=True)
    names, entities = part_names(spark, sf), part_entities(spark, sf)
    store.refresh(names.filter("name_id % 4 <> 1"), entities)
    store.refresh(names, entities)
    written(part_requests(spark, sf).repartition(3), f"{folder}/requests")
    start_pinned_screening(
        request_stream(spark, f"{folder}/requests", files_per_batch=2), store,
        f"{folder}/answers", f"{folder}/checkpoint", letter_frequencies, VectorStore(spark, f"{folder}/vectors"),
    ).awaitTermination()
    answers = spark.read.parquet(f"{folder}/answers/matches")
    return answers.select(
        "query_id", "rank", F.col("entity.reference_number").cast("long").alias("entity_id"), "score",
        "layers.*", F.array_join("layers_fired", ",").alias("layers_fired"),
    )


SCREEN_STREAM_FULL_SQL = f"select * exclude (name_id) from ({SCREEN_FULL_SQL})"


QUERIES = {
    "list_summary": summary,
    "entity_detail": detail,
    "match_table": matches_flat,
    "layer_long": layers,
    "source_counts": counts,
    "screen_stream": screen_stream,
    "screen_stream_full": screen_stream_full,
}

ORACLES = {
    "list_summary": SUMMARY_SQL,
    "entity_detail": DETAIL_SQL,
    "match_table": MATCH_TABLE_SQL,
    "layer_long": LAYERS_SQL,
    "source_counts": COUNTS_SQL,
    "screen_stream": SCREEN_STREAM_SQL,
    "screen_stream_full": SCREEN_STREAM_FULL_SQL,
}
