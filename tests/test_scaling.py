"""Plans that must not move a whole table for a few rows, and the same results as the plain way."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from namesieve.operators.index import build_index, form_members
from namesieve.operators.screening import match_payload, screen, screening_audit, validate_requests
from namesieve.operators.shaping import shape_sheet
from namesieve.params import ScreeningParams
from namesieve.sources.sheet_rows import SHEET_COLUMNS, sheet_rows
from namesieve.workspace import work_folder, written

KINDS = ["individual", "entity", None]


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def listed(spark):
    names = [(i, i // 2, f"{random.Random(i).choice(['Red', 'Old'])} widget {i % 5}") for i in range(60)]
    names = spark.createDataFrame(names, "name_id long, entity_id long, name_original string")
    entities = [(i, "L", str(i), f"E{i}", KINDS[i % 3], None, None, None) for i in range(30)]
    schema = (
        "entity_id long, source_list string, reference_number string, primary_name string,"
        " entity_type string, nationality string, date_of_birth string, listed_date string"
    )
    names = names.withColumns({"name_type": F.lit("primary"), "alias_quality": F.lit(None).cast("string")})
    return names, spark.createDataFrame(entities, schema)


def test_requests_take_the_first_rows_of_a_list_without_a_sort(spark):
    names, entities = listed(spark)
    asked = [
        (i, f"widget {['red', 'old'][i % 2]} {i % 5}", 60.0 + i, i % 7 + 1, [None, "individual", "vessel", "entity"][i % 4])
        for i in range(40)
    ]
    schema = "query_id long, name string, threshold double, max_results int, entity_type string"
    valid, _ = validate_requests(spark.createDataFrame(asked, schema))
    index = build_index(names, entities, work_folder(spark))
    matches = screen(valid, index)
    assert re.search(r"Join Inner, .*<= max_results", optimized(matches))
    every = screen(valid.withColumns({"threshold": F.lit(0.0), "max_results": F.lit(100), "entity_type": F.lit(None).cast("string")}), index)
    wanted = every.drop("rank").join(valid.select("query_id", "threshold", "max_results", F.col("entity_type").alias("kind")), "query_id")
    wanted = wanted.filter("score >= threshold and (kind is null or kind = entity_type)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    wanted = wanted.withColumn("rank", F.row_number().over(order)).filter("rank <= max_results")
    columns = ["query_id", "rank", "entity_id", "name_id", "score"]
    found = sorted(map(tuple, matches.select(columns).collect()))
    assert found and found == sorted(map(tuple, wanted.select(columns).collect()))


def test_requests_of_one_id_are_ranked_together(spark):
    names, entities = listed(spark)
    asked = [(1, "widget red 1", 3), (1, "widget red 1", 3), (2, "widget old 2", 2), (1, "widget old 3", 5)]
    requests = spark.createDataFrame(asked, "query_id long, name string, max_results int")
    valid, _ = validate_requests(requests.selectExpr("*", "1D threshold", "cast(null as string) entity_type"))
    found = screen(valid, build_index(names, entities, work_folder(spark))).collect()
    ranks = lambda i: sorted(r["rank"] for r in found if r["query_id"] == i)
    assert ranks(2) == [1, 2]
    assert ranks(1)[:3] == [1, 2, 3] and ranks(1)[-1] <= 5  # a row beyond its own request's number is left out
    first = [r for r in found if r["query_id"] == 1 and r["rank"] <= 2]
    assert len({r["entity_id"] for r in first}) == 1


def test_matches_do_not_shuffle_the_lists(spark):
    names, entities = listed(spark)
    twice = names.unionByName(names.filter("name_id = 4"))
    requests = spark.createDataFrame([(1, "red widget 4"), (2, "old widget 4")], "query_id long, name string")
    requests = requests.selectExpr("*", "1D threshold", "50 max_results", "cast(null as string) entity_type")
    valid, _ = validate_requests(requests)
    matches = screen(valid, build_index(names, entities, work_folder(spark)))
    payload = match_payload(matches, twice, entities)
    assert "name_original" not in optimized(payload)
    plain = matches.drop("entity_type").join(twice, "name_id").join(entities, "entity_id", "left_semi")
    columns = ["query_id", "rank", F.col("name_original")]
    found = payload.select("query_id", "rank", F.col("matched_name").alias("name_original"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select(*columns).collect()))


def test_members_of_a_form_need_two_shuffles(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([*range(40), None]), rng.choice(KINDS), rng.choice("abc")) for i in range(600)]
    rows = spark.createDataFrame(rows, "name_id long, entity_id long, entity_type string, form string")
    found = form_members(rows, 5)
    assert executed(found).count("Exchange hashpartitioning") <= 2
    best: dict = {}
    for name, entity, kind, form in rows.collect():
        at = best.setdefault((form, kind), {})
        at[entity] = min(name, at.get(entity, name))
    smallest = lambda ids: sorted(ids, key=lambda e: (e is not None, e or 0))[:5]
    wanted = {(form, ids[e], e, kind) for (form, kind), ids in best.items() for e in smallest(ids)}
    got = found.select("form", F.inline("members")).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    assert ScreeningParams().max_results_bound == 100


def test_sheet_is_grouped_once(spark):
    rows = [("1a", "Ann", "Primary Name", 2), ("1b", "Anna", "aka", 1), ("2", "Bob", None, 3), ("", "C", None, 4)]
    raw = spark.createDataFrame(rows, "Reference string, Name string, `Name Type` string, position int")
    parsed = shape_sheet(sheet_rows(raw))
    assert "Join" not in optimized(parsed.entities)
    found = parsed.entities.select(
        "reference_number", "primary_name", F.get_json_object("raw_record", "$.rows_count").alias("n")
    )
    assert sorted(map(tuple, found.collect())) == [("1", "Ann", "2"), ("2", "Bob", "1")]
    keyless = sheet_rows(raw).select(F.lit(None).cast("string").alias("reference"), *[c for c in SHEET_COLUMNS if c != "reference"], "position")
    assert shape_sheet(keyless).entities.count() == 0


def test_results_of_an_audit_are_not_sent_through_the_driver(spark, tmp_path):
    names, entities = listed(spark)
    asked = [(i, f"widget red {i}", None, None, None) for i in range(10)]
    schema = "query_id long, name string, threshold double, max_results int, entity_type string"
    valid, _ = validate_requests(spark.createDataFrame(asked, schema))
    matches = screen(valid, build_index(names, entities, work_folder(spark)))
    payload = written(match_payload(matches, names, entities), f"{tmp_path}/payload")
    audit = screening_audit(written(valid, f"{tmp_path}/valid"), payload)
    assert "BroadcastExchange" not in executed(audit)
    counts = {r.query_id: r.match_count for r in audit.collect()}
    assert len(counts) == 10 and sum(counts.values()) == payload.count() > 0
