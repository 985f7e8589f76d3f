"""Ingest job: list files -> current entity and name tables, with a run log."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.operators.shaping import (
    ENTITY_COLUMNS,
    ParsedList,
    require_domain,
    shape_entities,
    shape_individuals,
    shape_parties,
    shape_sheet,
)
from namesieve.operators.sync import (
    ENTITY_FIELDS,
    ENTITY_KEY,
    NAME_KEY,
    RunOutcome,
    apply_upsert,
    batch_changes,
    classify,
    colliding_ids,
    distinct_names,
    entity_id,
    last_per_key,
    log_rows,
    name_id,
    next_names,
    run_statistics,
    without_orphans,
)
from namesieve.functions.text import normalise_name
from namesieve.params import ENTITY_TYPES, NAME_TYPES
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
from namesieve.sources.sheet_rows import read_sheet
from namesieve.sources.store import LOG_SCHEMA, ListStore, list_fingerprint
from namesieve.workspace import work_folder, written


def party_list(
    spark: SparkSession, parties: str, aliases: str | None = None,
    addresses: str | None = None, overflow: str | None = None,
) -> ParsedList:
    return shape_parties(
        scan_parties(read_lines(spark, parties)).rows,
        scan_aliases(read_optional_lines(spark, aliases)).rows,
        scan_addresses(read_optional_lines(spark, addresses)).rows,
        scan_overflow(read_optional_lines(spark, overflow)).rows,
    )


def xml_list(spark: SparkSession, path: str) -> ParsedList:
    people = shape_individuals(read_individuals(spark, path))
    groups = shape_entities(read_entities(spark, path))
    # Entities follow the individuals, as they do in the list.
    def ordered(first: DataFrame, second: DataFrame) -> DataFrame:
        def of_section(rows: DataFrame, number: int) -> DataFrame:
            places = [c for c in ("position", "entry") if c in rows.columns]
            return rows.withColumns({c: F.struct(F.lit(number).alias("section"), F.col(c).alias("at")) for c in places})

        return of_section(first, 0).unionByName(of_section(second, 1))

    return ParsedList(
        ordered(people.entities, groups.entities), ordered(people.names, groups.names)
    )


def sheet_list(spark: SparkSession, path: str) -> ParsedList:
    return shape_sheet(read_sheet(spark, path), path=f"{work_folder(spark)}/sheet")


def require_own_ids(store: ListStore | BucketStore, entities: DataFrame, names: DataFrame, lists: list[str]) -> None:
    """Fail if an id would stand for two keys. Of other lists only ids and keys are read."""
    for table, rows, column, keys in (
        ("entities", entities.select(*ENTITY_KEY, entity_id().alias("entity_id")), "entity_id", ENTITY_KEY),
        ("names", names.select(*NAME_KEY, name_id().alias("name_id")), "name_id", NAME_KEY),
    ):
        stored = store.read(table)
        if stored is not None:
            rows = rows.unionByName(stored.select(*rows.columns))
        clash = colliding_ids(rows, column, keys).first()
        if clash is not None:
            raise ValueError(f"{column} {clash[0]} stands for {clash['first']} and {clash['last']}")


def prepared_batch(parsed: ParsedList, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(entities, names, names of the lists) of one parsed list, written.

    Of rows that repeat a key the last counts, and so do the names that came with it.
    """
    rows = parsed.entities.select(*ENTITY_COLUMNS, F.col("position").alias("last_entry"))
    batch = last_per_key(rows, ENTITY_KEY)
    batch = written(require_domain(batch, "entity_type", ENTITY_TYPES), f"{folder}/entities")
    lists = sorted(r[0] for r in batch.select("source_list").distinct().collect())
    names = require_domain(parsed.names, "name_type", NAME_TYPES)
    names = names.join(batch.select(*ENTITY_KEY, "last_entry"), ENTITY_KEY)
    names = names.filter(F.col("entry").isNull() | (F.col("entry") == F.col("last_entry")))
    names = distinct_names(names).withColumn("name_normalised", normalise_name(F.col("name_original")))
    return batch, written(names, f"{folder}/names"), lists


def no_entities(batch: DataFrame) -> DataFrame:
    """The entity table before the first ingest."""
    now = F.current_timestamp()
    empty = batch.limit(0).select(*ENTITY_KEY, *ENTITY_FIELDS)
    return empty.withColumns({"first_seen_at": now, "last_updated_at": now})


def upsert_list(
    store: ListStore, parsed: ParsedList
) -> tuple[dict[str, DataFrame], DataFrame, list[str]]:
    """(next tables, run statistics, names of the lists in it) for one parsed list.

    Only the stored rows of these lists are read and written anew.
    """
    folder = work_folder(store.spark)
    batch, names, lists = prepared_batch(parsed, folder)
    require_own_ids(store, batch, names, lists)
    now = F.current_timestamp()
    old_entities, old_names = store.read("entities", lists), store.read("names", lists)
    old_entities = no_entities(batch) if old_entities is None else old_entities
    changes = written(classify(old_entities, batch), f"{folder}/changes")
    entities = apply_upsert(old_entities, batch, now).withColumn("entity_id", entity_id())
    kept = without_orphans(next_names(old_names, names), entities)
    statistics = run_statistics(changes.filter(F.col("change") != "absent"), names)
    tables = {"entities": entities, "names": kept}
    raw_rows, old_rows = parsed.raw_rows, store.read("raw_rows", lists)
    if old_rows is not None:  # rows of parties that this batch does not hold stay
        stay = old_rows.join(batch.select(*ENTITY_KEY), ENTITY_KEY, "left_anti")
        raw_rows = stay if raw_rows is None else stay.unionByName(raw_rows)
    if raw_rows is not None:
        tables["raw_rows"] = raw_rows
    return tables, statistics, lists


def upsert_buckets(store: BucketStore, parsed: ParsedList) -> DataFrame:
    """Bring one parsed list into a bucketed store; the run statistics.

    First the batch alone is shuffled, to the buckets of the stored keys: an
    entity whose record or names are not as stored marks its bucket. Then only
    marked buckets are read whole and written anew, with every row that their
    next version has; the number of a bucket is all that reaches the driver.
    A batch that changes nothing writes no table.
    """
    folder = work_folder(store.spark)
    batch, names, lists = prepared_batch(parsed, folder)
    require_own_ids(store, batch, names, lists)
    since = store.version()
    old, old_names = store.read("entities", version=since), store.read("names", version=since)
    first = old is None
    old = no_entities(batch) if first else old
    matchable = names.filter(F.col("name_normalised") != "")
    had = matchable.limit(0) if old_names is None else old_names
    changes = batch_changes(old, had, batch, matchable).withColumn("bucket", store.bucket())
    changes = written(changes, f"{folder}/changes")
    marked = changes.filter((F.col("change") != "unchanged") | F.col("names_changed"))
    touched = sorted(r[0] for r in marked.select("bucket").distinct().collect())

    def of_touched(rows: DataFrame) -> DataFrame:
        return store.placed(rows.filter(store.bucket().isin(touched)))

    def beside(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
        """Stored rows of entities outside the batch, and the batch's rows."""
        if stored is None:
            return rows
        kept = stored.filter(F.col("bucket").isin(touched)).join(new.select(*ENTITY_KEY), ENTITY_KEY, "left_anti")
        return kept.select(*rows.columns).unionByName(rows)

    new = of_touched(batch)
    before = old if first else old.filter(F.col("bucket").isin(touched))
    entities = apply_upsert(before, new, F.current_timestamp()).withColumn("entity_id", entity_id())
    tables = {
        "entities": store.placed(entities) if first else entities,
        "names": beside(old_names, next_names(None, of_touched(matchable))),
    }
    old_rows = store.read("raw_rows", version=since)
    raw_rows = parsed.raw_rows
    if raw_rows is None and old_rows is not None:
        raw_rows = old_rows.drop("bucket").limit(0)
    if raw_rows is not None:
        tables["raw_rows"] = beside(old_rows, of_touched(raw_rows))
    statistics = run_statistics(changes, names)
    store.commit(tables, touched, since)
    return statistics


def ingest(
    store: ListStore | BucketStore,
    lists: dict[str, Callable[[], ParsedList]],
    paths: dict[str, str] | None = None,
    from_cache: frozenset[str] = frozenset(),
) -> bool:
    """Ingest each list; a list that fails is logged and the others go on.

    ``paths`` names the main file of a list, for its fingerprint in the log;
    lists in ``from_cache`` are logged as fallbacks. True if any list succeeded.
    """
    spark, paths, succeeded = store.spark, paths or {}, False
    for name, parse in lists.items():
        started = time.monotonic()
        try:
            digest = list_fingerprint(spark, paths[name]) if name in paths else None
            if isinstance(store, BucketStore):
                statistics = upsert_buckets(store, parse())
            else:
                tables, statistics, in_batch = upsert_list(store, parse())
                store.commit(tables, in_batch)
            outcome = RunOutcome(
                "fallback_cache" if name in from_cache else "success",
                paths.get(name),
                digest,
                int((time.monotonic() - started) * 1000),
                "used cached copy" if name in from_cache else None,
            )
            store.append_run(log_rows(statistics, outcome, F.current_timestamp()))
            succeeded = True
        except (PySparkException, Py4JJavaError, OSError, ValueError) as error:
            row = (name, "failed", int((time.monotonic() - started) * 1000), str(error))
            failed = spark.createDataFrame(
                [row], "source_list string, status string, duration_ms bigint, message string"
            )
            empty = spark.createDataFrame([], LOG_SCHEMA)
            store.append_run(
                empty.unionByName(
                    failed.withColumn("run_at", F.current_timestamp()), allowMissingColumns=True
                )
            )
    return succeeded

