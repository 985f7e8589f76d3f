"""Phonetic pairs of hot keys: nothing a result lists is lost, and blocks are even."""

import itertools

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from namesieve.catalog.matching import letter_frequencies
from namesieve.operators import ranked_pairs
from namesieve.operators.candidates import distinct_forms, phonetic_pairs
from namesieve.operators.index import build_index
from namesieve.operators.screening import best_name_per_entity, score_pairs, top_rows
from namesieve.operators.vectors import encode_forms
from namesieve.params import ScreeningParams

KINDS = ["individual", "entity", "vessel"]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """600 forms that sound alike, several names an entity, and some others."""
    vowels = ["".join(v) for k in (1, 2, 3, 4) for v in itertools.product("aeiou", repeat=k)][:600]
    texts = [f"b{v}t" for v in vowels] + [f"karl m{v}ler" for v in vowels[:30]] + ["mr boat", "nobody"]
    rows = [(i, (i * 7) % 250, t, KINDS[(i * 7) % 250 % 3 if i % 90 else 2]) for i, t in enumerate(texts)]
    names = spark.createDataFrame([r[:3] for r in rows], "name_id long, entity_id long, name_original string")
    kinds = {e: KINDS[e % 3] if e != 5 else "aircraft" for _, e, _, _ in rows}
    entities = spark.createDataFrame(list(kinds.items()), "entity_id long, entity_type string")
    path = str(tmp_path_factory.mktemp("world"))
    vectors = encode_forms(names.select(F.col("name_original").alias("form")), letter_frequencies)
    queries = spark.createDataFrame([("boat",), ("bit",), ("mr beet",), ("karl muller",), ("buoyat",)], "form string")
    return names, entities, vectors, queries, path


@pytest.mark.parametrize("with_vectors, bound", [(False, 3), (True, 10)])
def test_listed_entities_are_those_of_all_pairs(spark, world, with_vectors, bound):
    names, entities, vectors, queries, path = world
    params = ScreeningParams(max_results_bound=bound)
    folder = f"{path}/{with_vectors}-{bound}"
    index = build_index(names, entities, folder, params, vectors if with_vectors else None)
    forms = distinct_forms(queries, params).cache()
    asked = encode_forms(queries, letter_frequencies) if with_vectors else None
    every = phonetic_pairs(forms, index.forms)
    kept = ranked_pairs.listed_phonetic_pairs(
        forms, index, params, folder, asked, hot_forms=100, form_block=150, query_block=2
    )
    known = index.vectors.select(F.col("name_key").alias("form"), "vector") if with_vectors else None

    def listed(pairs):
        scored = score_pairs(pairs, forms, index.forms, params, asked, known)
        rows = scored.select("query_form", "name_form", "score", "exact", F.inline("members"))
        # Pairs with an equal variant are left to the exact join.
        best = best_name_per_entity(rows.filter("exact = 0"), "query_form")
        order = [F.desc("score"), F.asc("entity_id")]
        top = top_rows(best, ["query_form", "entity_type"], order, bound)
        return {(r.query_form, r.entity_type, r.entity_id, r.score) for r in top.collect()}

    assert listed(kept) == listed(every)
    n_kept, n_every = kept.count(), every.count()
    assert n_kept < n_every / (1 if with_vectors and bound == 10 else 2)
    assert kept.subtract(every).isEmpty()


def test_blocks_of_a_hot_key_are_even(spark):
    """One key on a third of 100,000 forms: no group has much more than its share."""
    forms = spark.range(100_000).select(
        F.concat(F.lit("n"), "id").alias("form"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("key"),
    )
    slots = F.ceil(F.count("*").over(Window.partitionBy("key")) / 4096)
    sizes = forms.withColumn("slots", slots).withColumn("slot", F.pmod(F.xxhash64("form"), F.col("slots")))
    rows = sorted(r["count"] for r in sizes.groupBy("key", "slot").count().collect())
    assert rows[-1] <= 2 * rows[len(rows) // 2]


def test_small_keys_and_the_weighted_sum_keep_all_pairs(spark, world):
    names, entities, _, queries, path = world
    index = build_index(names, entities, f"{path}/plain")
    every = phonetic_pairs(distinct_forms(queries, ScreeningParams()), index.forms)
    for params, hot in ((ScreeningParams(), 10_000), (ScreeningParams(strategy="weighted_sum"), 10)):
        forms = distinct_forms(queries, params)
        kept = ranked_pairs.listed_phonetic_pairs(forms, index, params, f"{path}/{hot}", hot_forms=hot)
        assert kept.exceptAll(every).isEmpty() and every.exceptAll(kept).isEmpty()
