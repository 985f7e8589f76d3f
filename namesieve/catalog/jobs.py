"""Registered queries: the ingest job and the vector job, each run twice over changing lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.catalog.lists import _quoted, _text, _write_lines
from namesieve.catalog.matching import _KEY_CTE, _sorted_sql, letter_frequencies
from namesieve.catalog.tables import (
    PART_TYPE_SQL,
    clauses,
    clauses_sql,
    norm_sql,
    part_entities,
    part_names,
    read,
)
from namesieve.functions.phonetics import phonetic_key
from namesieve.plans.ingest import ingest, party_list, sheet_list, xml_list
from namesieve.plans.screening import sync_vectors
from namesieve.operators.index_store import IndexStore
from namesieve.operators.reports import list_summary
from namesieve.operators.vector_store import VectorStore
from namesieve.sources.buckets import BucketStore
from namesieve.workspace import work_folder


def _list_files(spark: SparkSession, sf: str, folder: str, run: int) -> dict[str, str]:
    """Customers as a party file, suppliers as XML, line items as a sheet.

    Each run lacks the customers of one nation. Machinery customers come twice
    with another name first; building customers are renamed in the second run.
    Rich suppliers come twice under one reference; the tag of Germany's
    suppliers that no schema declares changes. Sheet addresses hold line breaks.
    """
    customer = read(spark, sf, "customer").filter(F.col("c_nationkey") != (3 if run == 1 else 5))
    none, key = _text("-0- "), F.col("c_custkey").cast("string")
    suffix = F.when((F.col("c_mktsegment") == "BUILDING") & F.lit(run == 2), " II").otherwise("")

    def line(name: Column) -> Column:
        return _quoted(key, name, _text("individual"), *([none] * 9))

    last = line(F.concat("c_name", suffix))
    first = line(F.concat(_text("Former "), "c_name"))
    lines = F.when(F.col("c_mktsegment") == "MACHINERY", F.array(first, last)).otherwise(F.array(last))
    parties = _write_lines(customer.select(F.explode(lines).alias("value")), f"{folder}/parties-{run}")

    supplier = read(spark, sf, "supplier")
    rich, number = F.col("s_acctbal") > 5000, F.col("s_suppkey").cast("string")
    entry = lambda name: F.struct(
        number.alias("DATAID"), name.alias("FIRST_NAME"),
        F.concat(_text("QDe."), number).alias("REFERENCE_NUMBER"),
        F.when(F.col("s_nationkey") == 7, F.lit(f"seen {run}")).otherwise("seen").alias("DESIGNATION"),
    )
    earlier, latest = entry(F.concat(_text("Earlier "), "s_name")), entry(F.col("s_name"))
    entries = F.when(rich, F.array(earlier, latest)).otherwise(F.array(latest))
    groups = f"{folder}/groups-{run}"
    rows = supplier.select(F.inline(entries))
    rows.write.format("xml").option("rootTag", "ENTITIES").option("rowTag", "ENTITY").save(groups)

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    item = read(spark, sf, "lineitem").orderBy(*order)
    cells = item.select(
        F.concat(F.col("l_orderkey").cast("string"), F.chr(F.lit(96) + F.col("l_linenumber"))).alias("Reference"),
        F.concat(_text("Part "), F.col("l_partkey").cast("string")).alias("Name"),
        F.when(F.col("l_linenumber") == 1, "Primary Name").otherwise("aka").alias("Name Type"),
        F.concat(_text("Door 7\nRow "), F.col("l_suppkey").cast("string")).alias("Address"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("Control Date"),
    )
    sheet = f"{folder}/sheet-{run}"
    cells.write.options(header=True, escape='"').csv(sheet)
    return {"OFAC": parties, "UN": groups, "DFAT": sheet}


def _two_runs(spark: SparkSession, sf: str) -> BucketStore:
    folder = work_folder(spark)
    store = BucketStore(spark, f"{folder}/store", buckets=8)
    for run in (1, 2):
        files = _list_files(spark, sf, folder, run)
        lists = {
            "OFAC": lambda: party_list(spark, files["OFAC"]),
            "UN": lambda: xml_list(spark, files["UN"]),
            "DFAT": lambda: sheet_list(spark, files["DFAT"]),
        }
        ingest(store, lists, from_cache=frozenset({"UN"} if run == 2 else ()))
    return store


def ingest_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Entities, names, log and summary after two runs, one kind of row under another."""
    store = _two_runs(spark, sf)
    entities, names, log = store.read("entities"), store.read("names"), store.read_log()
    changed = F.when(F.col("last_updated_at") > F.col("first_seen_at"), "updated").otherwise("as inserted")
    parts = [
        entities.select(
            F.lit("entity").alias("kind"), "source_list", "reference_number",
            F.concat_ws("|", "primary_name", "entity_type", "listed_date", changed).alias("value"),
        ),
        names.select(F.col("name_type").alias("kind"), "source_list", "reference_number",
                     F.col("name_original").alias("value")),
        log.select(
            F.lit("log").alias("kind"), "source_list", F.col("log_id").cast("string").alias("reference_number"),
            F.concat_ws("|", "status", F.coalesce("message", F.lit("")),
                        *(F.col(c).cast("string") for c in ("entities_inserted", "entities_updated", "names_total"))
                        ).alias("value"),
        ),
        list_summary(entities, names, log).select(
            F.lit("summary").alias("kind"), "source_list", F.lit("").alias("reference_number"),
            F.concat_ws("|", F.col("entity_count").cast("string"), F.col("name_count").cast("string"),
                        "last_status").alias("value"),
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


INGEST_SQL = """
with party as (
  select 'OFAC' as source_list, c_custkey::varchar as reference_number,
         c_name || case when c_mktsegment = 'BUILDING' and c_nationkey <> 5 then ' II' else '' end as primary_name,
         'individual' as entity_type, null as listed_date, c_nationkey <> 3 as in_first, c_nationkey <> 5 as in_second,
         c_nationkey not in (3, 5) and c_mktsegment = 'BUILDING' as changed
  from customer),
groups as (
  select 'UN', 'QDe.' || s_suppkey, s_name, 'entity', null, true, true, s_nationkey = 7 from supplier),
heads as (
  select l_orderkey, 'Part ' || l_partkey as primary_name, strftime(l_shipdate, '%Y-%m-%d') as listed_date,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as k
  from lineitem),
sheet as (
  select 'DFAT', l_orderkey::varchar, primary_name, 'entity', listed_date, true, true, false
  from heads where k = 1),
e as (select * from party union all select * from groups union all select * from sheet),
names as (
  select 'primary' as name_type, source_list, reference_number, primary_name as name_original,
         in_first, in_second
  from e where source_list <> 'DFAT'
  union all
  select distinct case when l_linenumber = 1 then 'primary' else 'aka' end, 'DFAT', l_orderkey::varchar,
         'Part ' || l_partkey, true, true
  from lineitem),
runs as (
  select source_list, count(*) filter (in_first) as new1, count(*) filter (in_second and not in_first) as new2,
         count(*) filter (changed) as changed from e group by 1),
totals as (
  select source_list, count(*) filter (in_first) as names1, count(*) filter (in_second) as names2,
         count(*) as names_now from names group by 1),
sizes as (select source_list, count(*) as entities_now from e group by 1),
place as (select * from (values ('OFAC', 1), ('UN', 2), ('DFAT', 3)) as p(source_list, n))
select 'entity' as kind, source_list, reference_number,
       concat_ws('|', primary_name, entity_type, listed_date,
                 case when changed then 'updated' else 'as inserted' end) as value from e
union all
select name_type, source_list, reference_number, name_original from names
union all
select 'log', source_list, n::varchar, concat_ws('|', 'success', '', new1::varchar, '0', names1::varchar)
from runs join totals using (source_list) join place using (source_list)
union all
select 'log', source_list, (n + 3)::varchar,
       concat_ws('|', case source_list when 'UN' then 'fallback_cache' else 'success' end,
                 case source_list when 'UN' then 'used cached copy' else '' end,
                 new2::varchar, changed::varchar, names2::varchar)
from runs join totals using (source_list) join place using (source_list)
union all
select 'summary', source_list, '', concat_ws('|', entities_now::varchar, names_now::varchar,
       case source_list when 'UN' then 'fallback_cache' else 'success' end)
from sizes join totals using (source_list)"""


def vector_sync_job(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark clauses as names: a first list of early clauses, a second without the first ones.

    One row per stored component, with what the second run kept, dropped and encoded.
    """
    store = VectorStore(spark, work_folder(spark))
    names = clauses(read(spark, sf, "benchmark"), "item_id").withColumnRenamed("name", "name_original")
    sync_vectors(names.filter("position <= 2"), store, "letters", letter_frequencies)
    second = sync_vectors(names.filter("position >= 1"), store, "letters", letter_frequencies)
    rows = store.read("letters").select("vector_key", F.posexplode("vector").alias("component", "value"))
    return rows.select(
        "vector_key", F.lit("letters").alias("model"), "component", F.round(F.col("value").cast("double"), 6).alias("value"),
        F.lit(second.kept).alias("kept"), F.lit(second.dropped).alias("dropped"),
        F.lit(second.encoded).alias("encoded"),
    )


VECTOR_JOB_SQL = f"""
with c as (select distinct {norm_sql("name")} as form, position from ({clauses_sql("benchmark", "item_id")})),
early as (select distinct form from c where position <= 2 and form <> ''),
late as (select distinct form from c where position >= 1 and form <> ''),
counted as (select form, i, length(form) - length(replace(form, chr((97 + i)::int), '')) as n
            from late, range(26) as r(i)),
normed as (select *, sqrt(sum(n * n) over (partition by form)) as norm from counted)
select sha256(form) as vector_key, 'letters' as model, i as component,
       round((case when norm = 0 then 0.0 else n / norm end)::float::double, 6) as value,
       (select count(*) from late where form in (select form from early)) as kept,
       (select count(*) from early where form not in (select form from late)) as dropped,
       (select count(*) from late where form not in (select form from early)) as encoded
from normed"""



def index_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Product names as a list in two versions: search rows after the second, read from base and segment.

    The first list lacks every third product and all gears; the second lacks every
    fifth, and the names of every seventh are marked as moved.
    """
    store = IndexStore(spark, work_folder(spark))
    names, entities = part_names(spark, sf), part_entities(spark, sf)
    store.refresh(names.filter("name_id % 3 <> 0 and name_original not like '%gear%'"), entities)
    brand = F.when(F.col("name_id") % 7 == 0, "moved").otherwise(F.col("alias_quality"))
    second = store.refresh(names.filter("name_id % 5 <> 0").withColumn("alias_quality", brand), entities)
    index = store.open().index
    members = index.forms.select(
        F.lit("member").alias("kind"), "form", phonetic_key(F.element_at("codes", 1)).alias("value"),
        F.inline("members"),
    )
    keys = index.keys.select(
        F.lit("key").alias("kind"), F.col("name_key").alias("form"), F.col("first_id").cast("string").alias("value"),
        F.inline("rows"),
    )
    rows = members.unionByName(keys.drop("name_form"))
    return rows.select(
        "kind", "form", "value", "name_id", "entity_id", "entity_type",
        F.lit(second.coded).alias("recoded"), F.lit(second.added).alias("added"), F.lit(second.gone).alias("gone"),
    )


INDEX_DELTA_SQL = f"""
with {_KEY_CTE},
now as (select *, {PART_TYPE_SQL} as entity_type, {_sorted_sql("p_name")} as s from part where p_partkey % 5 <> 0),
early as (select * from part where p_partkey % 3 <> 0 and p_name not like '%gear%'),
stats as (
  select (select count(distinct p_name) from now where p_name not in (select p_name from early)) as recoded,
    (select count(*) from now where p_partkey not in (select p_partkey from early)
       or p_partkey % 7 = 0 and p_brand is distinct from 'moved') as added,
    (select count(*) from early where p_partkey % 5 = 0 or p_partkey % 7 = 0 and p_brand is distinct from 'moved')
      as gone),
members as (
  select *, row_number() over (partition by p_name, entity_type order by p_partkey) as k from now),
keyed as (
  select *, row_number() over (partition by s order by p_partkey) as k, min(p_partkey) over (partition by s) as first
  from now)
select 'member' as kind, p_name as form, key as value, p_partkey as name_id, p_partkey as entity_id, entity_type,
       recoded, added, gone
from members join keys on form = p_name, stats where k <= 100
union all
select 'key', s, first::varchar, p_partkey, p_partkey, entity_type, recoded, added, gone
from keyed, stats where k <= 64"""

QUERIES = {"ingest_lists": ingest_lists, "vector_sync_job": vector_sync_job, "index_delta": index_delta}
ORACLES = {"ingest_lists": INGEST_SQL, "vector_sync_job": VECTOR_JOB_SQL, "index_delta": INDEX_DELTA_SQL}
