"""Search tables and vectors kept in segments, and streams pinned to a version of the lists."""

import random

import pytest

from namesieve.catalog.matching import letter_frequencies as letters
from namesieve.operators.index import build_index
from namesieve.operators.index_store import IndexStore
from namesieve.operators.vector_store import VectorStore
from namesieve.params import ScreeningParams
from namesieve.plans.screening import Screener
from namesieve.sources.segments import SegmentStore
from namesieve.streaming.continuous import (
    REQUEST_SCHEMA,
    screen_pinned,
)

NAMES = "name_id long, entity_id long, name_original string, name_type string, alias_quality string"
ENTITIES = """entity_id long, source_list string, reference_number string, primary_name string, entity_type string,
nationality string, date_of_birth string, listed_date string"""


def lists(spark, rows, kinds=None):
    """``rows``: (name_id, entity_id, name)."""
    names = spark.createDataFrame([(i, e, n, "primary", None) for i, e, n in rows], NAMES)
    ids = sorted({e for _, e, _ in rows})
    kind = lambda e: (kinds or {}).get(e, "entity")
    entities = [(e, "L", f"R{e}", f"Entity {e}", kind(e), None, None, None) for e in ids]
    return names, spark.createDataFrame(entities, ENTITIES)


def contents(index):
    forms = {
        r.form: (r.variants, r.codes, sorted(map(tuple, r.members))) for r in index.forms.collect()
    }
    keys = {r.name_key: (r.first_id, sorted(map(tuple, r.rows))) for r in index.keys.collect()}
    return forms, keys


def test_segments_equal_a_full_rebuild(spark, tmp_path):
    """Random edits over several versions; every version stays as it was."""
    rng = random.Random(3)
    words = ["amber", "brook", "cedar", "dr", "ember", "!!", "Färn"]
    rows = {i: (i, i % 9, " ".join(rng.choices(words, k=2))) for i in range(40)}
    kinds = {}
    store = IndexStore(spark, str(tmp_path / "index"), vectors=True, merge_every=2)
    seen = {}
    for step in range(3):
        if step:
            for i in rng.sample(sorted(rows), 4):
                del rows[i]
            for i in rng.sample(range(60), 5):
                rows[i] = (i, i % 9, " ".join(rng.choices(words, k=2)))
            kinds[rng.randrange(9)] = rng.choice(["individual", "vessel"])
        names, entities = lists(spark, list(rows.values()), kinds)
        done = store.refresh(names, entities)
        whole = contents(build_index(names, entities, str(tmp_path / f"whole-{step}")))
        seen[done.version] = whole
        assert contents(store.open(done.version).index) == whole
    assert store.refresh(*lists(spark, list(rows.values()), kinds)).added == 0
    assert max(seen) == store.current() and len(seen) == 3
    assert contents(store.open(0).index) == seen[0]
    log = store.segments.log()
    assert len({entry.base for entry in log.values()}) == 2  # merged once
    with pytest.raises(ValueError, match="no version"):
        store.open(99)


def test_only_new_forms_are_coded(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    first = store.refresh(*lists(spark, [(1, 1, "Amber Brook"), (2, 2, "Cedar"), (3, 3, "Cedar")]))
    assert (first.version, first.added, first.gone, first.coded) == (0, 3, 0, 2)
    second = store.refresh(*lists(spark, [(1, 1, "Amber Brook"), (3, 3, "cedar!"), (4, 1, "Ember"), (5, 2, "Amber brook")]))
    assert (second.added, second.gone, second.coded) == (3, 2, 1)  # one removed, one changed; "ember" is new
    forms = {r.form: sorted(m.name_id for m in r.members) for r in store.open().index.forms.collect()}
    assert forms == {"amber brook": [1, 5], "cedar": [3], "ember": [4]}


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path / "s"), {"t": ("k", "gone")})
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows.write.parquet(str(tmp_path / "s" / "segments" / "0-lost" / "t"))
    store.write(0, 0, {"t": rows})
    store.write(1, 0, {"t": rows.filter("k = 3"), "gone": rows.filter("k = 2").select("k")})
    assert [tuple(r) for r in store.read("t", 1).collect()] == [(1, "a")] and store.read("t", 0).count() == 2
    with pytest.raises(RuntimeError, match="meanwhile"):
        store.write(1, 0, {"t": rows})


def test_vectors_are_appended_and_struck(spark, tmp_path):
    forms = lambda *names: spark.createDataFrame([(n,) for n in names], "form string")
    store = VectorStore(spark, str(tmp_path / "v"), dead_share=0.4)
    first = store.sync(forms("ab", "cd", "ef"), "m", letters)
    assert (first.kept, first.dropped, first.encoded) == (0, 0, 3)
    second = store.sync(forms("ab", "cd", "gh"), "m", letters)
    assert (second.kept, second.dropped, second.encoded) == (2, 1, 1)
    log = store._segments("m").log()
    assert store._segments("m").segment(log[1], "vectors").count() == 1  # only what is new was written
    same = store.sync(forms("ab", "cd", "gh"), "m", letters)
    assert (same.kept, same.dropped, same.encoded) == (3, 0, 0) and store._segments("m").current() == 1
    third = store.sync(forms("ab"), "m", letters)
    assert third.dropped == 2 and store._segments("m").current() == 3  # three of four dead: merged
    again = store.sync(forms("ab", "ef"), "m", letters)  # struck before, back again
    assert again.encoded == 1 and sorted(r.form for r in again.vectors.collect()) == ["ab", "ef"]
    store.sync(forms("zz"), "other", letters)
    assert store.read("m").count() == 2 and store.read("other").count() == 1
    store.forget("other")
    assert store.read("other").count() == 0
    kept = store.sync(forms("ab"), "m", letters, drop=False)
    assert kept.dropped == 0 and store.read("m").count() == 2


def test_screener_of_store_equals_a_built_one(spark, tmp_path):
    rows = [(1, 1, "Amber Brook"), (2, 2, "Cedar Dale"), (3, 3, "Brook Amber"), (4, 4, "Dr Cedar Dell")]
    store = IndexStore(spark, str(tmp_path / "i"), vectors=True)
    store.refresh(*lists(spark, rows[:2]))
    store.refresh(*lists(spark, rows))
    names, entities = lists(spark, rows)
    requests = spark.createDataFrame([(1, "amber brok", 50.0, 5, None), (2, "cedar dale", 50.0, 5, None)], REQUEST_SCHEMA)
    kept = Screener.of_store(store, letters, VectorStore(spark, str(tmp_path / "v")))
    built = Screener.open(names, entities, encoder=letters)
    one, other = (s.screen(requests)[0].orderBy("query_id", "rank").collect() for s in (kept, built))
    assert one == other and len(one) >= 4


def test_a_replayed_batch_answers_as_before(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), ScreeningParams(), vectors=True)
    vectors = VectorStore(spark, str(tmp_path / "v"))
    out = str(tmp_path / "out")
    asked = spark.createDataFrame([(1, "Amber Brook", 60.0, 5, None)], REQUEST_SCHEMA)
    later = spark.createDataFrame([(2, "Amber Brook", 60.0, 5, None)], REQUEST_SCHEMA)

    def answers(number):
        rows = spark.read.parquet(f"{out}/matches/batch={number}").orderBy("rank").collect()
        audit = spark.read.parquet(f"{out}/audit/batch={number}").drop("created_at").collect()
        return [(r.entity.reference_number, r.score) for r in rows], audit

    store.refresh(*lists(spark, [(1, 1, "Amber Brook"), (2, 2, "Cedar Dale")]))
    screen_pinned(asked, 0, store, out, letters, vectors)
    first = answers(0)
    assert [r for r, _ in first[0]] == ["R1"] and first[1][0].list_version == 0
    store.refresh(*lists(spark, [(2, 2, "Cedar Dale"), (3, 3, "Amber Brook"), (4, 4, "Amber Brooks")]))
    screen_pinned(later, 1, store, out, letters, vectors)
    assert [r for r, _ in answers(1)[0]] == ["R3", "R4"] and answers(1)[1][0].list_version == 1
    screen_pinned(asked, 0, store, out, letters, vectors)  # the same batch after a failure
    assert answers(0) == first
