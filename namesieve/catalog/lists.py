"""Registered queries: list files, shaping, upsert and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.catalog.tables import clauses, clauses_sql, read
from namesieve.operators.candidates import spread_scan
from namesieve.operators.shaping import (
    ParsedList,
    birth_dates,
    domain_violations,
    first_nationality,
    formatted_birth_dates,
    mapped_type,
    merged_remarks,
    raw_json,
    shape_entities,
    shape_individuals,
    shape_sheet,
    shape_parties,
)
from namesieve.operators.sync import (
    ENTITY_KEY,
    RunOutcome,
    apply_upsert,
    classify,
    distinct_names,
    duplicate_keys,
    last_per_key,
    log_rows,
    name_changes,
    run_statistics,
    without_orphans,
)
from namesieve.sources.buckets import BucketStore
from namesieve.sources.list_xml import read_entities, read_individuals
from namesieve.sources.party_csv import (
    read_lines,
    read_optional_lines,
    scan_addresses,
    scan_aliases,
    scan_overflow,
    scan_parties,
)
from namesieve.sources.sheet_rows import sheet_rows
from namesieve.sources.store import (
    ListStore,
    file_fingerprints,
    read_cases,
    read_vectors,
    write_cases,
    write_vectors,
)
from namesieve.workspace import work_folder, written


def _quoted(*fields: Column) -> Column:
    """One CSV line with every field in quotes."""
    cells = [F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"')) for f in fields]
    return F.concat_ws(",", *cells)


def _write_lines(lines: DataFrame, path: str) -> str:
    lines.write.text(path)
    return path


def _text(value: str) -> Column:
    return F.lit(value)


def _remarks() -> Column:
    key = F.col("c_custkey").cast("string")
    return (
        F.when(
            F.col("c_acctbal") > 5000,
            F.concat(
                _text("DOB "), key, _text(" Feb 1965; POB X; nationality  NATION "),
                F.col("c_nationkey").cast("string"), _text(" ; alt. DOB: 1970 ;"),
            ),
        )
        .when(F.col("c_acctbal") > 2000, F.concat(_text("Reg. no. "), key))
        .otherwise(_text("-0- "))
    )


_REMARKS_SQL = """case when c_acctbal > 5000 then 'DOB ' || c_custkey || ' Feb 1965; POB X; nationality  NATION '
    || c_nationkey || ' ; alt. DOB: 1970 ;'
  when c_acctbal > 2000 then 'Reg. no. ' || c_custkey end"""


def _party_file(spark: SparkSession, sf: str, folder: str) -> str:
    """Customers as a party file: sentinels, quotes, short and over-long rows."""
    none = _text("-0- ")
    kind = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "vessel")
        .when(F.col("c_mktsegment") == "BUILDING", "aircraft")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", " Individual ")
        .otherwise("-0- ")
    )
    name = F.concat(F.col("c_mktsegment"), _text(' "Q", '), F.col("c_name"))
    key = F.col("c_custkey").cast("string")
    full = _quoted(key, name, kind, F.concat(_text(" P"), key), *([none] * 7), _remarks())
    line = (
        F.when(F.col("c_acctbal") < 0, _quoted(key, name, kind))
        .when(F.col("c_acctbal") > 9000, F.concat(full, _text(',"extra"')))
        .otherwise(full)
    )
    return _write_lines(read(spark, sf, "customer").select(line.alias("value")), f"{folder}/parties")


def csv_party_scan(spark: SparkSession, sf: str) -> DataFrame:
    scan = scan_parties(read_lines(spark, _party_file(spark, sf, work_folder(spark))))
    columns = ["ent_num", "sdn_name", "sdn_type", "program", "title", "remarks"]
    accepted = scan.rows.select(*columns, F.lit("ok").alias("reason"))
    rejected = scan.rejected.select(
        *(F.lit(None).cast("string").alias(c) for c in columns), "reason"
    )
    return accepted.unionByName(rejected)


_PARTY_KIND_SQL = """case c_mktsegment when 'AUTOMOBILE' then 'vessel' when 'BUILDING' then 'aircraft'
  when 'HOUSEHOLD' then 'Individual' end"""

CSV_PARTY_SQL = f"""
select case when ok then c_custkey::varchar end as ent_num,
       case when ok then c_mktsegment || ' "Q", ' || c_name end as sdn_name,
       case when ok then {_PARTY_KIND_SQL} end as sdn_type,
       case when ok then 'P' || c_custkey end as program,
       null::varchar as title,
       case when ok then {_REMARKS_SQL} end as remarks,
       case when ok then 'ok' else 'short_row' end as reason
from (select *, c_acctbal >= 0 as ok from customer)"""


def csv_side_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as aliases, customers as addresses and remark overflow."""
    folder = work_folder(spark)
    customer, orders = read(spark, sf, "customer"), read(spark, sf, "orders")
    key = F.col("c_custkey").cast("string")
    parties = scan_parties(read_lines(spark, _party_file(spark, sf, folder))).rows
    alias_kind = (
        F.when(F.col("o_orderstatus") == "O", "aka")
        .when(F.col("o_orderstatus") == "F", "FKA")
        .otherwise("other")
    )
    alias_name = F.when(
        F.col("o_orderpriority") == "4-NOT SPECIFIED", "-0- "
    ).otherwise(F.col("o_orderpriority"))
    alias_lines = orders.select(
        _quoted(
            F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"),
            alias_kind, alias_name, _text("-0- "),
        ).alias("value")
    )
    address_lines = customer.select(
        _quoted(key, _text("1"), _text("-0- "), F.col("c_mktsegment"),
                F.col("c_nationkey").cast("string"), _text("")).alias("value")
    )
    overflow_lines = customer.select(
        F.explode(
            F.array(
                _quoted(key, F.concat(_text("draft "), key)),
                _quoted(key, F.concat(_text("final "), key)),
                _quoted(key),
            )
        ).alias("value")
    )
    aliases = scan_aliases(read_lines(spark, _write_lines(alias_lines, f"{folder}/aliases"))).rows
    addresses = scan_addresses(
        read_lines(spark, _write_lines(address_lines, f"{folder}/addresses"))
    ).rows
    overflow = scan_overflow(
        read_optional_lines(spark, _write_lines(overflow_lines, f"{folder}/overflow"))
    ).rows
    missing = scan_overflow(read_optional_lines(spark, f"{folder}/no-such-file")).rows
    parsed = shape_parties(parties, aliases, addresses, overflow.unionByName(missing))
    remarks = merged_remarks(parties, overflow.unionByName(missing)).select("ent_num", "remarks")
    field = lambda name: F.get_json_object("record", f"$.{name}")
    alias, address = F.col("kind") == "aliases", F.col("kind") == "addresses"
    known = F.concat_ws(
        "/", mapped_type(field("alt_type"), ("aka", "fka", "nka"), "aka"), field("alt_name")
    )
    known = F.when(alias & field("alt_name").isNotNull(), known)
    rows = parsed.raw_rows.groupBy(F.col("reference_number").alias("ent_num")).agg(
        F.count_if(alias).alias("n_aliases"),
        F.array_join(F.array_sort(F.collect_list(known)), ",").alias("aliases"),
        F.array_join(F.collect_list(F.when(address, field("city_state_zip"))), ",").alias("addresses"),
    )
    return remarks.join(rows, "ent_num", "left").select(
        "ent_num", "remarks", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"),
        F.when(F.col("n_aliases") > 0, F.col("aliases")).alias("aliases"), "addresses",
    )


CSV_SIDE_SQL = f"""
with a as (select o_custkey, count(*) as n, string_agg(
             case o_orderstatus when 'F' then 'fka' else 'aka' end || '/' || o_orderpriority, ','
             order by case o_orderstatus when 'F' then 'fka' else 'aka' end || '/' || o_orderpriority)
             filter (where o_orderpriority <> '4-NOT SPECIFIED') as names
           from orders group by 1)
select c_custkey::varchar as ent_num,
       concat_ws(' ', {_REMARKS_SQL}, 'final ' || c_custkey) as remarks,
       coalesce(n, 0) as n_aliases, case when n > 0 then coalesce(names, '') end as aliases,
       c_mktsegment as addresses
from customer left join a on o_custkey = c_custkey where c_acctbal >= 0"""


def csv_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts in two files, one per encoding, read in one scan."""
    folder = work_folder(spark)
    flat = F.regexp_replace(
        F.regexp_replace("text", r"[\r\n\t]+", " "), r"[^\x{20}-\x{7E}\x{A1}-\x{FF}]", "?"
    )
    docs = read(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("a"), F.lit("1").alias("b"), F.lit("aka").alias("c"),
        flat.alias("d"), (F.col("lang") == "fr").alias("french"),
    )

    def save(rows: DataFrame, name: str, encoding: str) -> str:
        options = {"encoding": encoding, "quoteAll": True, "escape": '"'}
        rows.drop("french").write.options(**options).csv(f"{folder}/{name}")
        return f"{folder}/{name}"

    paths = [
        save(docs.filter("french"), "latin", "ISO-8859-1"),
        save(docs.filter("not french"), "utf8", "UTF-8"),
    ]
    rows = scan_aliases(read_lines(spark, paths)).rows
    return rows.select(F.col("ent_num").alias("doc_id"), "alt_name")


CSV_ENCODING_SQL = r"""
select doc_id::varchar as doc_id, nullif(trim(
  regexp_replace(regexp_replace(text, '[\r\n\t]+', ' ', 'g'), '[^\x{20}-\x{7E}\x{A1}-\x{FF}]', '?', 'g')), '')
  as alt_name
from documents"""


def xml_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as individuals and suppliers as entities of one XML list."""
    folder = work_folder(spark)
    nation = read(spark, sf, "nation").join(
        read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customer = read(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    key = F.col("c_custkey").cast("string")
    individuals = customer.select(
        key.alias("DATAID"),
        F.col("c_mktsegment").alias("FIRST_NAME"),
        F.when(F.col("c_acctbal") > 1000, F.lit(" ")).alias("SECOND_NAME"),
        F.col("c_name").alias("THIRD_NAME"),
        F.when(F.col("c_acctbal") > 0, F.concat(_text("QDi."), key)).alias("REFERENCE_NUMBER"),
        _text(" 2010-05-04 ").alias("LISTED_ON"),
        F.array(F.struct(F.array("n_name", "r_name").alias("VALUE"))).alias("NATIONALITY"),
        F.array(
            F.struct(_text("Good").alias("QUALITY"),
                     F.concat(_text("A"), key).alias("ALIAS_NAME")),
            F.struct(_text("").alias("QUALITY"), _text("").alias("ALIAS_NAME")),
        ).alias("INDIVIDUAL_ALIAS"),
        F.array(
            F.struct(_text("APPROXIMATELY").alias("TYPE_OF_DATE"), _text("1971").alias("YEAR")),
            F.struct(_text("EXACT").alias("TYPE_OF_DATE"),
                     F.lit(None).cast("string").alias("YEAR")),
        ).alias("INDIVIDUAL_DATE_OF_BIRTH"),
    )
    supplier = read(spark, sf, "supplier")
    entities = supplier.select(
        F.col("s_suppkey").cast("string").alias("DATAID"),
        F.col("s_name").alias("FIRST_NAME"),
        F.concat(_text("QDe."), F.col("s_suppkey").cast("string")).alias("REFERENCE_NUMBER"),
        F.array(
            F.struct(_text("Low").alias("QUALITY"),
                     F.concat(_text("B"), F.col("s_nationkey").cast("string")).alias("ALIAS_NAME"))
        ).alias("ENTITY_ALIAS"),
    )

    def save(rows: DataFrame, name: str, root: str, tag: str) -> str:
        path = f"{folder}/{name}"
        rows.write.format("xml").option("rootTag", root).option("rowTag", tag).save(path)
        return path

    people = shape_individuals(
        read_individuals(spark, save(individuals, "people", "INDIVIDUALS", "INDIVIDUAL"))
    )
    groups = shape_entities(read_entities(spark, save(entities, "groups", "ENTITIES", "ENTITY")))
    names = people.names.unionByName(groups.names.select(*people.names.columns))
    labels = names.groupBy("reference_number").agg(
        F.array_join(
            F.array_sort(
                F.collect_set(F.concat_ws("/", "name_type", "name_original", "alias_quality"))
            ),
            ",",
        ).alias("names")
    )
    columns = [
        "reference_number", "primary_name", "entity_type", "nationality", "date_of_birth",
        "listed_date",
    ]
    both = people.entities.select(*columns).unionByName(groups.entities.select(*columns))
    return both.join(labels, "reference_number")


XML_SQL = """
select case when c_acctbal > 0 then 'QDi.' || c_custkey else 'DATAID-' || c_custkey end
         as reference_number,
       c_mktsegment || ' ' || c_name as primary_name, 'individual' as entity_type,
       n_name || '; ' || r_name as nationality, 'approximately 1971' as date_of_birth,
       '2010-05-04' as listed_date,
       'alias/A' || c_custkey || '/Good,primary/' || c_mktsegment || ' ' || c_name as names
from customer left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey
union all
select 'QDe.' || s_suppkey, s_name, 'entity', null, null, null,
       'alias/B' || s_nationkey || '/Low,primary/' || s_name
from supplier"""


def sheet_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as sheet rows: references like '12b', grouped by their number."""
    line = spread_scan(read(spark, sf, "lineitem"))
    raw = line.select(
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("position"),
        F.concat(
            F.col("l_orderkey").cast("string"),
            F.when(F.col("l_linestatus") == "O", " ").otherwise(""),
            F.chr(F.lit(96) + F.col("l_linenumber")),
        ).alias("Reference"),
        F.when(F.col("l_quantity") > 3, F.concat(_text("Part "), F.col("l_partkey").cast("string")))
        .otherwise("  ").alias("Name of Individual or Entity"),
        F.when(F.col("l_returnflag") == "R", "Primary Name")
        .when(F.col("l_returnflag") == "A", "Original Script").alias("NAME TYPE"),
        F.when(F.col("l_discount") > 0.05, "Vessel").when(F.col("l_discount") > 0.02, "Firm")
        .alias("Type"),
        F.when(F.col("l_tax") > 0.04, "Strong").alias("Alias Strength"),
        F.col("l_suppkey").cast("string").alias("Citizenship"),
        _text("1971").alias("Date of Birth"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("Control Date"),
    )
    parsed = shape_sheet(sheet_rows(raw))
    names = parsed.names.groupBy("reference_number").agg(
        F.count("*").alias("n_names"),
        F.count_if(F.col("name_type") == "original_script").alias("n_script"),
        F.count("alias_quality").alias("n_strong"),
    )
    return parsed.entities.select(
        "reference_number", "primary_name", "entity_type", "nationality", "date_of_birth",
        "listed_date",
    ).join(names, "reference_number")


SHEET_SQL = """
with r as (
  select l_orderkey::varchar as reference_number, *,
         row_number() over (partition by l_orderkey order by l_returnflag <> 'R', l_linenumber,
                            l_partkey, l_suppkey, l_extendedprice) as k
  from lineitem where l_quantity > 3),
n as (select reference_number, count(*) as n_names, count(*) filter (l_returnflag = 'A') as n_script,
             count(*) filter (l_tax > 0.04) as n_strong from r group by 1)
select reference_number, 'Part ' || l_partkey as primary_name,
       case when l_discount > 0.05 then 'vessel' else 'entity' end as entity_type,
       l_suppkey::varchar as nationality, '1971' as date_of_birth,
       strftime(l_shipdate, '%Y-%m-%d') as listed_date, n_names, n_script, n_strong
from r join n using (reference_number) where k = 1"""


def remarks_extract(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    remarks = (
        F.when(
            F.col("o_orderstatus") == "O",
            F.concat(_text("dob: "), key, _text(" ; Nationality "), F.col("o_orderpriority"),
                     _text("; nationality Z; DOB 1 Jan 1970")),
        )
        .when(F.col("o_orderstatus") == "F", F.concat(_text("born "), key))
    )
    return read(spark, sf, "orders").select(
        "o_orderkey",
        birth_dates(remarks).alias("date_of_birth"),
        first_nationality(remarks).alias("nationality"),
    )


REMARKS_SQL = """
select o_orderkey,
       case when o_orderstatus = 'O' then o_orderkey || '; 1 Jan 1970' end as date_of_birth,
       case when o_orderstatus = 'O' then o_orderpriority end as nationality
from orders"""


def type_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Mapped types per line item, with the count of values outside the vocabulary."""
    line = read(spark, sf, "lineitem").select(
        F.concat(_text("L"), F.col("l_linestatus")).alias("source_list"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("reference_number"),
        F.when(F.col("l_returnflag") == "R", "Vessel").when(F.col("l_returnflag") == "A", "AIRCRAFT")
        .alias("raw_type"),
        F.when(F.col("l_linestatus") == "O", "NKA").otherwise("weak alias").alias("raw_name_type"),
    )
    mapped = line.select(
        "source_list",
        "reference_number",
        mapped_type(F.col("raw_type"), ("individual", "vessel", "aircraft"), "entity").alias(
            "entity_type"
        ),
        mapped_type(F.col("raw_name_type"), ("aka", "fka", "nka"), "aka").alias("name_type"),
    )
    raw = line.select(
        "source_list", "reference_number", F.coalesce("raw_type", F.lit("none")).alias("entity_type"),
        F.lower("raw_name_type").alias("name_type"),
    )
    good = domain_violations(ParsedList(mapped, mapped))
    bad = domain_violations(ParsedList(raw, raw))
    counted = mapped.groupBy("source_list", "entity_type", "name_type").agg(F.count("*").alias("n"))
    return counted.unionByName(
        good.unionByName(bad).groupBy("source_list").agg(
            F.lit("violation").alias("entity_type"), F.lit("violation").alias("name_type"),
            F.count("*").alias("n"),
        )
    )


TYPE_SQL = """
select 'L' || l_linestatus as source_list,
       case l_returnflag when 'R' then 'vessel' when 'A' then 'aircraft' else 'entity' end
         as entity_type,
       case l_linestatus when 'O' then 'nka' else 'aka' end as name_type, count(*) as n
from lineitem group by all
union all
select 'L' || l_linestatus, 'violation', 'violation',
       count(*) + count(*) filter (l_linestatus <> 'O')
from lineitem group by all"""


def dob_format(spark: SparkSession, sf: str) -> DataFrame:
    year = F.date_format("o_orderdate", "yyyy")
    none = F.lit(None).cast("string")
    kind = (
        F.when(F.col("o_orderstatus") == "O", "Between")
        .when(F.col("o_orderstatus") == "F", " approximately")
        .otherwise("EXACT")
    )
    first = F.struct(
        kind.alias("TYPE_OF_DATE"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("DATE"),
        year.alias("YEAR"),
        F.when(F.col("o_orderpriority") != "1-URGENT", year).alias("FROM_YEAR"),
        F.when(F.col("o_orderpriority") == "2-HIGH", year).alias("TO_YEAR"),
    )
    second = F.struct(
        none.alias("TYPE_OF_DATE"), _text("").alias("DATE"),
        F.when(F.col("o_totalprice") > 200000, "1960").alias("YEAR"),
        none.alias("FROM_YEAR"), none.alias("TO_YEAR"),
    )
    return read(spark, sf, "orders").select(
        "o_orderkey", formatted_birth_dates(F.array(first, second)).alias("date_of_birth")
    )


DOB_SQL = """
with t as (
  select o_orderkey, strftime(o_orderdate, '%Y') as y,
         case when o_orderpriority = '5-LOW' then strftime(o_orderdate, '%Y-%m-%d')
              else strftime(o_orderdate, '%Y') end as exact,
         o_orderstatus as s, o_orderpriority as p, o_totalprice as price from orders)
select o_orderkey, nullif(concat_ws('; ',
  case s when 'O' then case when p <> '1-URGENT' then 'between ' || y || ' and '
                         || case when p = '2-HIGH' then y else '?' end end
         when 'F' then 'approximately ' || exact else exact end,
  case when price > 200000 then '1960' end), '') as date_of_birth
from t"""


def raw_record_json(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    fields = {
        "props": F.col("props"),
        "event_type": F.nullif(F.col("event_type"), F.lit("view")),
        "user_id": F.col("user_id").cast("string"),
    }
    record = raw_json(fields)
    return events.select(
        "event_id", record.alias("raw_record"), F.sha2(record, 256).alias("raw_hash")
    )


RAW_JSON_SQL = """
with r as (select event_id, to_json({'event_type': nullif(event_type, 'view'), 'props': props,
                                     'user_id': user_id::varchar})::varchar as raw_record from events)
select event_id, raw_record, sha256(raw_record) as raw_hash from r"""


# ---------------------------------------------------------------- sync

_OLD_UNTIL, _NEW_FROM = "1999-01-01", "1996-01-01"


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the orders that overlap in time; prices of finished ones differ.

    The new one lists open orders twice, with a stale price first.
    """
    orders = read(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")

    def rows(source: DataFrame, price: Column, position: int) -> DataFrame:
        empty = F.lit(None).cast("string")
        return source.select(
            F.col("o_orderpriority").alias("source_list"),
            F.col("o_orderkey").cast("string").alias("reference_number"),
            F.concat(_text("Order "), F.col("o_orderkey").cast("string")).alias("primary_name"),
            _text("entity").alias("entity_type"),
            F.col("o_orderstatus").alias("nationality"),
            empty.alias("date_of_birth"),
            empty.alias("listed_date"),
            F.concat(_text('{"cents":'), price.cast("string"), _text("}")).alias("raw_record"),
            F.lit(position).alias("position"),
        )

    old = rows(orders.filter(F.col("o_orderdate") < _OLD_UNTIL), cents, 0)
    recent = orders.filter(F.col("o_orderdate") >= _NEW_FROM)
    changed = F.when(F.col("o_orderstatus") == "F", cents + 100).otherwise(cents)
    stale = rows(recent.filter("o_orderstatus = 'O'"), cents - 7, 0)
    return old.drop("position"), rows(recent, changed, 1).unionByName(stale)


_CHANGE_SQL = f"""
c as (select o_orderpriority as source_list, o_orderkey::varchar as reference_number, o_orderkey,
             o_orderstatus, round(o_totalprice * 100)::bigint as cents,
             case when o_orderdate < timestamp '{_NEW_FROM}' then 'absent'
                  when o_orderdate >= timestamp '{_OLD_UNTIL}' then 'inserted'
                  when o_orderstatus = 'F' then 'updated' else 'unchanged' end as change
      from orders)"""


def upsert_classify(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _snapshots(spark, sf)
    return classify(old, last_per_key(new, ENTITY_KEY))


UPSERT_CLASSIFY_SQL = f"with {_CHANGE_SQL} select source_list, reference_number, change from c"


def upsert_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a bucketed store; the second rewrites the buckets of changed rows and is read back."""
    old, new = _snapshots(spark, sf)
    folder = work_folder(spark)
    store = BucketStore(spark, f"{folder}/store", buckets=8)
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    second = F.lit("2025-01-01 00:00:00").cast("timestamp")
    before = old.withColumn("first_seen_at", first).withColumn("last_updated_at", first)
    store.commit({"entities": store.placed(before)}, range(store.buckets), 0)
    batch = written(last_per_key(new, ENTITY_KEY), f"{folder}/batch")
    current = store.read("entities")
    changed = classify(current, batch).filter("change in ('inserted', 'updated')")
    touched = [r[0] for r in changed.select(store.bucket()).distinct().collect()]
    held = F.col("bucket").isin(touched)
    following = apply_upsert(current.filter(held), batch.filter(store.bucket().isin(touched)), second)
    store.commit({"entities": following}, touched, 1)
    return store.read("entities").select(
        "source_list", "reference_number", "primary_name", "nationality", "raw_record",
        F.year("first_seen_at").alias("first_seen"), F.year("last_updated_at").alias("last_updated"),
    )


UPSERT_APPLY_SQL = f"""
with {_CHANGE_SQL}
select source_list, reference_number, 'Order ' || reference_number as primary_name,
       o_orderstatus as nationality,
       '{{"cents":' || case when change in ('inserted', 'updated') and o_orderstatus = 'F'
                            then cents + 100 else cents end || '}}' as raw_record,
       case when change = 'inserted' then 2025 else 2024 end as first_seen,
       case when change in ('inserted', 'updated') then 2025 else 2024 end as last_updated
from c"""


def _statistics(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _snapshots(spark, sf)
    latest = last_per_key(new, ENTITY_KEY)
    return run_statistics(classify(old, latest), latest)


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _statistics(spark, sf)


STATISTICS_SQL = f"""
with {_CHANGE_SQL}
select source_list, count(*) filter (change = 'inserted') as inserted,
       count(*) filter (change = 'updated') as updated,
       count(*) filter (change = 'unchanged') as unchanged,
       count(*) filter (change = 'absent') as absent,
       count(*) filter (change <> 'absent') as names_total
from c group by 1"""


def log_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs appended to the log; it is read back whole."""
    store = ListStore(spark, work_folder(spark))
    stats = _statistics(spark, sf)
    store.append_run(log_rows(stats, RunOutcome("success", "orders"), F.current_timestamp()))
    fallback = RunOutcome("fallback_cache", message="cached copy")
    store.append_run(log_rows(stats, fallback, F.current_timestamp()))
    return store.read_log().drop("run_at", "duration_ms", "file_sha256")


LOG_SQL = f"""
with s as ({STATISTICS_SQL}),
o(log_id, status, source_url, message) as (values (1, 'success', 'orders', null::varchar),
                                                  (2, 'fallback_cache', null, 'cached copy'))
select log_id, source_list, status, source_url, inserted as entities_inserted,
       updated as entities_updated, names_total, message from s, o"""


def name_set_diff(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem")

    def rows(source: DataFrame) -> DataFrame:
        return source.select(
            F.col("l_linestatus").alias("source_list"),
            F.col("l_orderkey").cast("string").alias("reference_number"),
            F.when(F.col("l_returnflag") == "R", "primary").otherwise("aka").alias("name_type"),
            F.when(F.col("l_quantity") > 2, F.concat(_text("s"), F.col("l_suppkey").cast("string")))
            .otherwise(" ").alias("name_original"),
            F.when(F.col("l_tax") > 0.03, "Good").alias("alias_quality"),
            F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("position"),
        )

    old = distinct_names(rows(line.filter(F.col("l_shipdate") < _OLD_UNTIL)))
    new = distinct_names(rows(line.filter(F.col("l_shipdate") >= _NEW_FROM)))
    return name_changes(old, new)


NAME_DIFF_SQL = f"""
with r as (select l_linestatus as source_list, l_orderkey::varchar as reference_number,
                  case l_returnflag when 'R' then 'primary' else 'aka' end as name_type,
                  's' || l_suppkey as name_original,
                  case when l_tax > 0.03 then 'Good' end as q,
                  row(l_linenumber, l_partkey, l_extendedprice) as pos, l_shipdate
           from lineitem where l_quantity > 2),
o as (select source_list, reference_number, name_type, name_original, (list(q order by pos))[1] as q
      from r where l_shipdate < timestamp '{_OLD_UNTIL}' group by 1, 2, 3, 4),
n as (select source_list, reference_number, name_type, name_original, (list(q order by pos))[1] as q
      from r where l_shipdate >= timestamp '{_NEW_FROM}' group by 1, 2, 3, 4),
ob as (select * from o semi join n using (source_list, reference_number))
select source_list, reference_number, name_type, name_original,
       case when ob.name_id is null then 'added' when nb.name_id is null then 'removed'
            when ob.q is not distinct from nb.q then 'kept' else 'requalified' end as change
from (select *, 1 as name_id from ob) ob
full join (select *, 1 as name_id from n) nb
using (source_list, reference_number, name_type, name_original)"""


def cascade_names(spark: SparkSession, sf: str) -> DataFrame:
    names = read(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), "o_orderkey")
    entities = read(spark, sf, "customer").filter("c_acctbal > 0")
    return without_orphans(names, entities.select(F.col("c_custkey").alias("entity_id")))


CASCADE_SQL = """
select o_custkey as entity_id, o_orderkey from orders
where o_custkey in (select c_custkey from customer where c_acctbal > 0)"""


def key_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem")
    return duplicate_keys(line, ["l_orderkey", "l_linenumber"]).unionByName(
        duplicate_keys(
            read(spark, sf, "orders").select(
                F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber")
            ),
            ["l_orderkey", "l_linenumber"],
        )
    )


UNIQUENESS_SQL = """
select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1"""


def vector_store(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_folder(spark)
    vectors = read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("vector_key"),
        F.when(F.col("label") < 5, "current").otherwise("previous").alias("model"),
        F.col("embedding").alias("vector"),
    )
    write_vectors(vectors, f"{folder}/vectors")
    stored = read_vectors(spark, f"{folder}/vectors", "current")
    rows = stored.select("vector_key", "model", F.posexplode("vector").alias("component", "value"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


VECTOR_STORE_SQL = """
select vec_id as vector_key, 'current' as model, i as component, round(embedding[i + 1]::double, 6) as value
from embeddings, unnest(range(len(embedding))) as r(i) where label < 5"""


def case_json(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark clauses as cases, written as JSON and read back."""
    folder = work_folder(spark)
    rows = clauses(read(spark, sf, "benchmark"), "item_id")
    truth = F.struct(
        F.lit("B").alias("source_list"), F.col("item_id").cast("string").alias("reference_number")
    )
    cases = rows.select(
        F.format_string("C%07d", "name_id").alias("case_id"),
        F.col("name").alias("query"),
        F.when(F.col("position") > 0, "alias").otherwise("negative").alias("perturbation"),
        F.when(F.col("position") > 0, F.col("name")).alias("original_name"),
        F.when(F.col("position") > 0, truth).alias("truth"),
    )
    write_cases(cases, f"{folder}/cases")
    return read_cases(spark, f"{folder}/cases").select(
        "case_id", "query", "perturbation", "original_name", "truth.source_list",
        "truth.reference_number",
    )


CASE_JSON_SQL = f"""
select printf('C%07d', name_id) as case_id, name as query,
       case when position > 0 then 'alias' else 'negative' end as perturbation,
       case when position > 0 then name end as original_name,
       case when position > 0 then 'B' end as source_list,
       case when position > 0 then item_id::varchar end as reference_number
from ({clauses_sql('benchmark', 'item_id')})"""


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of every table file in the folder."""
    found = file_fingerprints(spark, sf)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length", "file_sha256"
    )


def written_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as one text file per nation, with carriage returns, and the files' digests."""
    folder = work_folder(spark)
    lines = read(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation"), F.concat("c_name", F.lit("\r")).alias("value")
    )
    in_order = lines.repartition("nation").sortWithinPartitions("nation", "c_custkey").drop("c_custkey")
    in_order.write.partitionBy("nation").text(f"{folder}/files")
    nation = F.regexp_extract("path", r"nation=(\d+)/", 1).cast("int").alias("nation")
    return file_fingerprints(spark, f"{folder}/files").select(nation, "length", "file_sha256")


WRITTEN_FINGERPRINTS_SQL = """
select c_nationkey::int as nation, sum(length(c_name) + 2)::bigint as length,
       sha256(string_agg(c_name || chr(13) || chr(10), '' order by c_custkey)) as file_sha256
from customer group by 1"""


QUERIES = {
    "written_fingerprints": written_fingerprints,
    "csv_party_scan": csv_party_scan,
    "csv_side_tables": csv_side_tables,
    "csv_encoding": csv_encoding,
    "xml_scan": xml_scan,
    "sheet_rows": sheet_groups,
    "remarks_extract": remarks_extract,
    "type_mapping": type_mapping,
    "dob_format": dob_format,
    "raw_record_json": raw_record_json,
    "upsert_classify": upsert_classify,
    "upsert_apply": upsert_apply,
    "run_statistics": statistics,
    "log_append": log_append,
    "name_set_diff": name_set_diff,
    "cascade_names": cascade_names,
    "key_uniqueness": key_uniqueness,
    "vector_store": vector_store,
    "case_json": case_json,
    "file_fingerprint": fingerprints,
}

ORACLES = {
    "written_fingerprints": WRITTEN_FINGERPRINTS_SQL,
    "csv_party_scan": CSV_PARTY_SQL,
    "csv_side_tables": CSV_SIDE_SQL,
    "csv_encoding": CSV_ENCODING_SQL,
    "xml_scan": XML_SQL,
    "sheet_rows": SHEET_SQL,
    "remarks_extract": REMARKS_SQL,
    "type_mapping": TYPE_SQL,
    "dob_format": DOB_SQL,
    "raw_record_json": RAW_JSON_SQL,
    "upsert_classify": UPSERT_CLASSIFY_SQL,
    "upsert_apply": UPSERT_APPLY_SQL,
    "run_statistics": STATISTICS_SQL,
    "log_append": LOG_SQL,
    "name_set_diff": NAME_DIFF_SQL,
    "cascade_names": CASCADE_SQL,
    "key_uniqueness": UNIQUENESS_SQL,
    "vector_store": VECTOR_STORE_SQL,
    "case_json": CASE_JSON_SQL,
}
