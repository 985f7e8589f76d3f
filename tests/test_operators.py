import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from namesieve.functions.phonetics import token_code
from namesieve.operators.evaluation import (
    QUOTAS,
    eligible_seeds,
    entity_forms,
    evaluation_cases,
    exact_percentiles,
    nicknamed,
    transliterated,
)
from namesieve.operators.index import NameIndex
from namesieve.operators.normalising import phonetic_keys
from namesieve.operators.reports import entity_detail
from namesieve.operators.shaping import side_rows, side_summary
from namesieve.operators.sync import duplicate_keys, last_per_key, name_changes
from namesieve.operators.vectors import lookup_scores
from namesieve.params import ScreeningParams


def test_percentiles_equal_the_definition(spark):
    rng = random.Random(2)
    groups = {f"g{n}": [rng.choice([1.5, 2.25, rng.random()]) for _ in range(n)]
              for n in (2, 3, 19, 20, 21, 400)}
    rows = spark.createDataFrame(
        [(g, v) for g, values in groups.items() for v in values], "g string, v double"
    )
    for r in exact_percentiles(rows, "g", "v", buckets=8).collect():
        values = groups[r.g]
        assert r.calls == len(values)
        assert r.p50 == statistics.median(values)
        assert abs(r.p95 - statistics.quantiles(values, n=20)[18]) < 1e-12


def test_side_rows_stay_rows_at_any_size(spark):
    def summary(values):
        rows = spark.createDataFrame(
            [("a", i, v) for i, v in enumerate(values)], "k string, position int, v string"
        )
        kept = [r.record for r in side_rows(rows, "k", ["v"], "items", "L").collect()]
        return side_summary(rows, "k", ["v"], "items").first(), kept

    many = [f"v{i}" for i in range(12_000)]
    first, kept = summary(many)
    assert first.items_count == 12_000 and sorted(kept) == sorted(f'{{"v":"{v}"}}' for v in many)
    assert summary(many[::-1])[0] == first
    assert summary([*many[1:], "other"])[0] != first
    assert summary(["x"])[1] == ['{"v":"x"}']


def test_an_index_refuses_larger_bounds():
    index = NameIndex(None, None, None, ScreeningParams(fuzzy_limit=8))
    index.require(ScreeningParams(fuzzy_limit=8))
    with pytest.raises(ValueError, match="fuzzy_limit"):
        index.require(ScreeningParams(fuzzy_limit=9))


def test_known_names_are_perturbed(spark):
    df = spark.createDataFrame(
        [(0, "vladimir petrov"), (1, "mohammed said"), (2, "jane roe")], "seed bigint, norm string"
    )
    rows = df.select(
        nicknamed(F.split("norm", " "), F.col("seed")).alias("nick"),
        transliterated(F.col("norm"), F.col("seed")).alias("spelt"),
    ).collect()
    assert [r.nick for r in rows] == ["vova petrov", "mohd said", None]
    assert [r.spelt for r in rows] == ["wladimir petrov", "mohamed said", None]


def test_entity_detail_order(spark):
    entities = spark.createDataFrame([(1, "UN", "7"), (2, "UN", "8")],
                                     "entity_id int, source_list string, reference_number string")
    names = spark.createDataFrame(
        [(1, "aka", None, "B"), (1, "primary", None, "Z"), (1, "aka", "Good", "A")],
        "entity_id int, name_type string, alias_quality string, name_original string",
    )
    keys = spark.createDataFrame([("un", "7")], "source_list string, reference_number string")
    assert [r.name_original for r in entity_detail(entities, names, keys).collect()] == ["Z", "A", "B"]


def test_batch_and_name_set_rules(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")],
                                 "k string, position int, v string")
    assert {tuple(r) for r in last_per_key(rows, ["k"]).collect()} == {("a", "new"), ("b", "only")}
    assert [(r.k, r.n) for r in duplicate_keys(rows, ["k"]).collect()] == [("a", 2)]
    schema = ("source_list string, reference_number string, name_type string,"
              " name_original string, alias_quality string")  # fmt: skip
    old = spark.createDataFrame([("L", "1", "aka", "A", None), ("L", "1", "aka", "B", "Low"),
                                 ("L", "2", "aka", "C", None)], schema)
    new = spark.createDataFrame([("L", "1", "aka", "A", None), ("L", "1", "aka", "D", None),
                                 ("L", "1", "aka", "B", "Good")], schema)
    changes = {r.name_original: r.change for r in name_changes(old, new).collect()}
    assert changes == {"A": "kept", "B": "requalified", "D": "added"}


def test_phonetic_keys_of_distinct_tokens(spark):
    rows = spark.createDataFrame([(1, "ali hassan"), (2, "hassan ali"), (3, "hassan hassan"), (4, "42 ali")], "id int, form string")
    got = {r.id: r.metaphone_key for r in phonetic_keys(rows, "form").collect()}
    want = {r.id: " ".join(sorted(token_code(t) for t in r.form.split())) for r in rows.collect()}
    assert got == want and got[1] == got[2] != got[3]


def test_evaluation_cases_of_first_seeds(spark):
    """Perturbations that the first seeds do not fill take the others, too; own names are no cases."""
    names = [("L", str(i), f"anna{'ou' if i % 7 == 0 else ''} word{i} {'ivan' if i == 33 else 'last'}") for i in range(40)]
    listed = spark.createDataFrame(names, "source_list string, reference_number string, primary_name string")
    listed = listed.withColumns({
        "entity_type": F.lit("individual"), "seed": F.col("reference_number").cast("long"),
        "name_normalised": F.col("primary_name"),
    })
    swapped = listed.withColumn("name_normalised", F.concat_ws(" ", F.element_at(F.split("primary_name", " "), 1),
                                                               F.element_at(F.split("primary_name", " "), -1)))
    forms = entity_forms(listed.unionByName(swapped.filter("seed < 20")))
    seeds = eligible_seeds(listed)
    quotas = {kind: 5 for kind in QUOTAS}

    def cases(first_seeds):
        return sorted(evaluation_cases(seeds, forms, quotas=quotas, first_seeds=first_seeds).collect())

    found = cases(3)
    assert found == cases(1000) == cases(12)
    order = sorted(range(40), key=lambda i: hashlib.md5(f"L/{i}".encode()).hexdigest())
    dropped = [r.truth["reference_number"] for r in found if r.perturbation == "dropped_middle"]
    assert dropped == [str(i) for i in order if i >= 20][:5]
    assert [r.truth["reference_number"] for r in found if r.perturbation == "nickname"] == ["33"]
    assert [r.case_id for r in found] == [f"P{i:03d}" for i in range(1, len(found) + 1)]


def test_vectors_in_cells_equal_the_joins(spark):
    """Lookups through the grid: repeated and missing vectors, odd lengths, nulls, other columns of a pair."""
    rng = random.Random(5)

    def vectors(prefix):
        rows = [(f"{prefix}{i}", [rng.uniform(-1, 1) for _ in range(8 if i % 9 else 3)]) for i in range(60)]
        odd = [(f"{prefix}1", [0.5] * 8), (None, [1.0] * 8), (f"{prefix}70", None), (f"{prefix}71", [0.1, None]),
               (f"{prefix}72", [])]
        return spark.createDataFrame(rows + odd, "form string, vector array<float>")

    wanted = [(f"q{rng.randrange(75)}", f"n{rng.randrange(75)}", rng.choice([None, 7]), [i % 3]) for i in range(3000)]
    wanted += [("q72", "n72", 1, []), ("q71", "n71", 2, None), (None, "n1", 3, []), ("q1", None, 4, []), ("q1", "n1", 5, [])]
    pairs = spark.createDataFrame(wanted, "query_form string, name_form string, k int, tags array<int>")
    pairs = pairs.unionByName(pairs.limit(50))
    q, n = vectors("q"), vectors("n")

    def rows(**limits):
        scored = lookup_scores(pairs, q, n, **limits)
        return sorted(map(repr, scored.select("query_form", "name_form", "k", "tags", "cosine", "embedding").collect()))

    assert rows(few_bytes=0) == rows() == rows(few_bytes=0, block_bytes=500)
    plan = lookup_scores(pairs, q, n, few_bytes=0)._jdf.queryExecution().toString()
    assert "Join" not in plan
