"""Bucketed stores: joins that leave the stored side in place, and buckets rewritten one by one."""

import os

import pytest
from pyspark.sql import functions as F

from listfiles import write_files
from namesieve.operators.sync import ENTITY_KEY, batch_changes
from namesieve.plans.ingest import ingest, party_list
from namesieve.sources.buckets import BucketStore


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_of(store, table):
    """{bucket: names of its data files} of the current version."""
    folders = store.manifest(table)[0]
    listed = {b: os.listdir(f) if os.path.isdir(f) else [] for b, f in folders.items()}
    return {b: sorted(n for n in names if n.startswith("part-")) for b, names in listed.items()}


def rows(spark, n, value, start=0):
    source = F.when(F.col("id") % 3 == 0, "L").otherwise("M")  # a literal would leave one column to join on
    number = F.col("id").cast("string")
    ids = spark.range(start, n).select(source.alias("source_list"), number.alias("reference_number"))
    return ids.withColumn("value", F.lit(value))


@pytest.fixture()
def store(spark, tmp_path):
    return BucketStore(spark, str(tmp_path / "store"), buckets=8)


def test_only_touched_buckets_are_written(spark, store):
    store.commit({"t": store.placed(rows(spark, 200, "old"))}, range(8), 0)
    first = files_of(store, "t")
    assert sorted(first) == list(range(8)) and all(len(names) == 1 for names in first.values())
    current = store.read("t")
    assert current.filter(F.col("bucket") != store.bucket()).count() == 0
    store.commit({"t": current.filter("bucket = 3").withColumn("value", F.lit("new"))}, [3], 1)
    second = files_of(store, "t")
    assert {b for b in range(8) if first[b] != second[b]} == {3}
    now = store.read("t")
    assert now.count() == 200 and now.filter("value = 'new' and bucket <> 3").count() == 0
    assert store.read("t", version=1).filter("value = 'new'").count() == 0  # earlier versions stay
    plan = plan_of(now.filter("bucket in (1, 2)"))
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    store.forget()
    assert len(spark.sql(f"show tables like '{store._prefix()}*'").collect()) == 1


def test_an_emptied_bucket_and_clashing_writers(spark, store):
    store.commit({"t": store.placed(rows(spark, 50, "x"))}, range(8), 0)
    kept = store.read("t").filter("bucket <> 5").count()
    store.commit({"t": store.read("t").filter("bucket = 5").limit(0)}, [5], 1)
    assert store.read("t").count() == kept
    with pytest.raises(RuntimeError):
        store.commit({"t": rows(spark, 1, "late")}, [0], 1)
    assert store.commit({"t": rows(spark, 1, "none")}, [], 2) == 2
    other = BucketStore(spark, store.root, buckets=4)
    with pytest.raises(ValueError):
        other.read("t")


def test_stored_side_is_not_shuffled(spark, store):
    def entities(n):
        return rows(spark, n, "v").withColumn("raw_record", F.lit("r"))

    def names(n):
        return rows(spark, n, "v").select(
            *ENTITY_KEY, F.lit("aka").alias("name_type"), F.col("reference_number").alias("name_original"),
            F.lit(None).cast("string").alias("alias_quality"),
        )

    store.commit({"e": store.placed(entities(100)), "n": store.placed(names(100))}, range(8), 0)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        changes = batch_changes(store.read("e"), store.read("n"), entities(150), names(120))
        plan = plan_of(changes)
        found = {tuple(r) for r in changes.groupBy("change", "names_changed").count().collect()}
    finally:
        spark.conf.set(conf, before)
    assert found == {("unchanged", False, 100), ("inserted", True, 20), ("inserted", False, 30)}
    lines = plan.splitlines()
    depths = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for place, line in enumerate(lines):  # up from each stored scan: no shuffle
        if "FileScan parquet" in line:
            depth = depths[place]
            for above in range(place - 1, -1, -1):
                if depths[above] < depth:
                    depth = depths[above]
                    assert "Exchange" not in lines[above], plan
    assert plan.count("Bucketed: true") == 2


def test_ingest_rewrites_the_buckets_of_changed_entities(spark, tmp_path, store):
    files = write_files(tmp_path)

    def run(parties, aliases=files["aliases"]):
        parse = lambda: party_list(spark, str(parties), str(aliases), files["addresses"], files["overflow"])
        assert ingest(store, {"OFAC": parse})
        return {t: files_of(store, t) for t in ("entities", "names", "raw_rows")}

    def bucket_of(reference):
        key = spark.createDataFrame([("OFAC", reference)], "source_list string, reference_number string")
        return key.select(store.bucket()).first()[0]

    def state():
        return {t: sorted(map(str, store.read(t).drop("bucket").collect())) for t in ("entities", "names", "raw_rows")}

    first, kept = run(files["parties"]), state()
    assert run(files["parties"]) == first and store.version() == 1  # the same again writes nothing
    assert state() == kept
    renamed = tmp_path / "renamed.csv"
    text = open(files["parties"], encoding="utf-8").read()
    assert "BRIGHT ANCHOR" in text
    renamed.write_text(text.replace("BRIGHT ANCHOR", "PALE ANCHOR"))
    second = run(renamed)
    for table in second:
        assert {b for b in second[table] if second[table][b] != first[table][b]} <= {bucket_of("88")}
    after = state()
    changed = [x for x in after["entities"] if x not in kept["entities"]]
    assert len(changed) == 1 and "PALE ANCHOR" in changed[0] and len(after["entities"]) == len(kept["entities"])
    # an entity that a later file lacks stays, with its names and side rows
    fewer = tmp_path / "fewer.csv"
    fewer.write_text("".join(x for x in text.splitlines(True) if "ANCHOR" in x))
    run(fewer)
    assert len(state()["entities"]) == len(kept["entities"]) and state()["raw_rows"] == kept["raw_rows"]
    assert state()["names"] == kept["names"]
    log = [(r.entities_inserted, r.entities_updated) for r in store.read_log().orderBy("log_id").collect()]
    assert log == [(4, 0), (0, 0), (0, 1), (0, 1)]
