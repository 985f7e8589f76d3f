"""The screening job against a brute-force rendering of its definition."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from listfiles import write_files
from namesieve.catalog.matching import letter_frequencies as letters
from namesieve.functions.phonetics import token_code
from namesieve.functions.similarity import partial_ratio_pairs, ratio_pairs, token_sort
from namesieve.operators import candidates
from namesieve.operators.index import build_index
from namesieve.operators.screening import screen, validate_requests
from namesieve.params import ScreeningParams
from namesieve.plans.ingest import ingest, party_list, sheet_list, xml_list
from namesieve.plans.screening import Screener, evaluate, screen_and_audit, sync_vectors
from namesieve.sources.store import ListStore
from namesieve.streaming.continuous import REQUEST_SCHEMA, request_stream, start_screening


# ------------------------------------------------------------ brute force


def variants(form):
    return [form, form.removeprefix("haji ")] if form.startswith("haji ") else [form]


def codes(form):
    return [token_code(t) for t in form.split()]


def dice(a, b):
    shared = sum((Counter(codes(a)) & Counter(codes(b))).values())
    return 200.0 * shared / (len(a.split()) + len(b.split()))


def unit(form):
    v = letters()([form])[0]
    return (v / np.linalg.norm(v)).astype(np.float32).astype(float)


def brute_force(requests, names, kinds, params):
    """{query_id: [(entity_id, name_id, score)]} straight from the definition."""
    out = {}
    for query_id, q, threshold, limit, kind in requests:
        keys = {" ".join(sorted(codes(v))) for v in variants(q)}
        found = {
            i
            for i, (_, n) in names.items()
            if set(variants(q)) & set(variants(n))
            or keys & {" ".join(sorted(codes(v))) for v in variants(n)}
        }
        tsr = {i: ratio_pairs([token_sort(q)], [token_sort(n)])[0] for i, (_, n) in names.items()}
        close = sorted((-s, i) for i, s in tsr.items() if s >= params.fuzzy_cutoff)
        found |= {i for _, i in close[: params.fuzzy_limit]}
        cos = {i: round(float(unit(q) @ unit(n)), 9) for i, (_, n) in names.items()}
        near = sorted((-c, i) for i, c in cos.items())[: params.vector_limit]
        found |= {i for c, i in near if -c >= params.cosine_cutoff}
        best = {}
        for i in sorted(found):
            entity, n = names[i]
            exact = 100.0 if set(variants(q)) & set(variants(n)) else 0.0
            phonetic = round(max(dice(a, b) for a in variants(q) for b in variants(n)), 2)
            fuzzy = round(0.7 * tsr[i] + 0.3 * partial_ratio_pairs([q], [n])[0], 2)
            embedding = round(100 * max(0.0, float(unit(q) @ unit(n))), 2)
            score = max(exact, 0.97 * fuzzy, 0.9 * phonetic, 0.85 * embedding)
            if not exact and sum(s >= 80 for s in (phonetic, fuzzy, embedding)) >= 2:
                score = min(score + 3, 99)
            score = round(score, 2)
            allowed = kind is None or kinds[entity] == kind
            if allowed and score >= threshold and score > best.get(entity, (-1, 0))[0]:
                best[entity] = (score, i)
        ranked = sorted((-s, e, i) for e, (s, i) in best.items())[:limit]
        out[query_id] = [(e, i, -s) for s, e, i in ranked]
    return out


@pytest.fixture(scope="module")
def world(spark):
    """Names with one form on a third of all rows, near copies and honorifics."""
    rng = random.Random(11)
    words = "ali omar hassan hasan yusuf karim ivan petrov petrow marta nowak silver heron quill".split()
    hot = "ali hassan"
    names, kinds = {}, {}
    for i in range(1, 361):
        form = hot if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 4)))
        if i % 17 == 0:
            form = "haji " + form
        names[i * 7] = (rng.randint(1, 150), form)
    for entity in range(1, 151):
        kinds[entity] = rng.choice(["individual", "entity", "vessel"])
    requests = []
    for k in range(60):
        form = hot if k % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 3)))
        if k % 7 == 0:
            form = "haji " + form
        if k % 5 == 0:
            form = form[:2] + form[3:]
        form = " ".join(form.split())
        requests.append((k, form, float(rng.choice([60, 75, 90])), rng.choice([1, 5, 10, 100]),
                         rng.choice([None, None, "individual", "vessel"])))
    return names, kinds, requests


def run(spark, world, params, folder):
    names, kinds, requests = world
    name_rows = spark.createDataFrame(
        [(i, e, n.upper()) for i, (e, n) in names.items()],
        "name_id bigint, entity_id bigint, name_original string",
    )
    entities = spark.createDataFrame(list(kinds.items()), "entity_id bigint, entity_type string")
    raw = spark.createDataFrame(requests, REQUEST_SCHEMA)
    valid, rejected = validate_requests(raw, params)
    assert rejected.count() == 0

    def encoded(forms):
        return spark.createDataFrame(
            [(f, [float(x) for x in unit(f)]) for f in sorted(set(forms))],
            "form string, vector array<float>",
        )

    index = build_index(name_rows, entities, folder, params, encoded(n for _, n in names.values()))
    rows = screen(valid, index, params, encoded(r[1] for r in requests), path=folder).collect()
    got = {r[0]: [] for r in requests}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.entity_id, r.name_id, r.score))
    return got


@pytest.mark.parametrize("limit", [64, 5])
def test_screen_equals_brute_force(spark, world, tmp_path, monkeypatch, limit):
    # Small blocks, so that several groups and the final ranking over them are exercised.
    monkeypatch.setattr(candidates, "SMALLEST_QUERY_BLOCK", 8)
    monkeypatch.setattr(candidates, "QUERY_BLOCK", 16)
    params = ScreeningParams(fuzzy_limit=limit, vector_limit=limit)
    names, kinds, requests = world
    assert run(spark, world, params, str(tmp_path)) == brute_force(requests, names, kinds, params)


def test_small_name_blocks_change_nothing(spark, world):
    names, _, requests = world
    params = ScreeningParams()
    rows = spark.createDataFrame(
        [(i, e, "entity", n) for i, (e, n) in names.items()],
        "name_id bigint, entity_id bigint, entity_type string, form string",
    )
    queries = spark.createDataFrame([(r[1],) for r in requests], "form string").distinct()
    keys = candidates.token_keys(rows, params)
    one = candidates.fuzzy_rows(queries, keys, params).collect()
    many = candidates.fuzzy_rows(queries, keys, params, name_block=7).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


@pytest.mark.parametrize("limit", [4, 64])
def test_vector_cells_lose_nothing(spark, tmp_path, limit):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 12))
    names = np.concatenate([c + 0.2 * rng.normal(size=(40, 12)) for c in centres] + [np.zeros((2, 12))])
    names[7] = names[8]  # equal vectors: the smaller id goes first
    lengths = np.linalg.norm(names, axis=1)
    names[:-2] /= lengths[:-2, None]
    asked = [*names[::11], *rng.normal(size=(6, 12)), np.zeros(12)]
    asked = [a / max(np.linalg.norm(a), 1e-9) for a in asked]

    def frame(rows, prefix):
        return spark.createDataFrame(
            [(f"{prefix}{i}", i, [float(x) for x in v]) for i, v in enumerate(rows)],
            "form string, name_id bigint, vector array<double>",
        )

    listed = frame(names, "n")
    rows = listed.select(
        "name_id", F.col("name_id").alias("entity_id"), F.lit("entity").alias("entity_type"), "form"
    )
    params = ScreeningParams(vector_limit=limit)
    keys = candidates.vector_keys(rows, listed.select("form", "vector"), params)
    found = candidates.vector_rows(
        frame(asked, "q").select("form", "vector"), keys, params, name_block=20, path=str(tmp_path)
    ).collect()
    expected = set()
    for i, a in enumerate(asked):
        cosines = [(-round(float(a @ n), 9), j) for j, n in enumerate(names)]
        best = sorted(c for c in cosines if -c[0] >= params.cosine_cutoff)[:limit]
        expected |= {(f"q{i}", j) for _, j in best}
    assert {(r.query_form, r.name_id) for r in found} == expected
    cells = -(-len(names) // 20)
    visits = spark.read.parquet(str(tmp_path / "vector_visits")).count()
    assert visits < 0.7 * len(asked) * (cells - 1)


# ------------------------------------------------------------ end to end


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("screening")
    files = write_files(folder)
    store = ListStore(spark, str(folder / "store"))
    assert ingest(
        store,
        {
            "OFAC": lambda: party_list(spark, files["parties"], files["aliases"]),
            "UN": lambda: xml_list(spark, files["list"]),
            "DFAT": lambda: sheet_list(spark, files["sheet"]),
        },
    )
    return store


@pytest.fixture(scope="module")
def screener(lists):
    return Screener.open(lists.read("names"), lists.read("entities"))


def ask(spark, screener, *requests):
    rows = [tuple(r) + (None,) * (5 - len(r)) for r in requests]
    payload, audit, rejected = screener.screen(spark.createDataFrame(rows, REQUEST_SCHEMA))
    return payload.orderBy("query_id", "rank").collect(), audit.collect(), rejected.collect()


def test_listed_names(spark, screener):
    """One request per way of meeting a listed name, and the requests that meet none."""
    payload, audit, rejected = ask(
        spark, screener,
        (11, "copper LANTERN bakery"),
        (12, "Iron Lantern Bakery", 90.0),
        (13, "Lindqvist, Ulrika Vance", 75.0),
        (14, "Wendelin Ashgrove", 75.0),
        (15, "ο πλοηγος", 99.0),
        (16, "Teal Compass", 50.0, 5, "entity"),
        (17, "lantern", 40.0, 1),
        (18, "Grbavica Dubrovnik Tolstoyevsky", 95.0),
        (19, "?!"),
        (20, "q" * 600),
    )
    best = {r.query_id: r for r in reversed(payload)}  # rank 1 comes last and stays
    reference = {q: r.entity.reference_number for q, r in best.items()}
    assert {q: reference[q] for q in (11, 12, 13, 14, 15)} == {
        11: "40", 12: "40", 13: "P-5", 14: "13", 15: "61",
    }
    assert best[11].score == best[12].score == best[15].score == 100.0
    assert (best[12].matched_name_type, best[15].matched_name_type) == ("fka", "original_script")
    assert "exact" not in best[14].layers_fired and best[14].score < 100.0
    assert {r.entity.entity_type for r in payload if r.query_id == 16} <= {"entity"}
    assert sum(r.query_id == 17 for r in payload) <= 1
    counts = {r.query_id: r.match_count for r in audit}
    assert counts[18] == 0 and counts[11] >= 1 and set(counts) == set(range(11, 19))
    assert {r.query_id: r.reason for r in rejected} == {19: "name_unmatchable", 20: "name_too_long"}


def test_audit_log(spark, screener, lists):
    requests = spark.createDataFrame([(1, "Teal  COMPASS", None, None, None)], REQUEST_SCHEMA)
    screen_and_audit(screener, requests, lists)
    log = lists.read_log("screenings").collect()
    assert len(log) == 1 and log[0].query_name_normalised == "teal compass"


def test_encoder_layer(spark, lists):
    screener = Screener.open(lists.read("names"), lists.read("entities"), encoder=letters)
    payload, _, _ = ask(spark, screener, (1, "laet ssapmoc", 60.0))
    assert payload[0].entity.reference_number == "60"
    assert payload[0].layers.embedding == 100.0 and "embedding" in payload[0].layers_fired


def test_vectors_are_kept_in_step(spark, lists, tmp_path):
    names, store = lists.read("names"), ListStore(spark, str(tmp_path / "vectors"), "model")
    first = sync_vectors(names, store, "letters", letters)
    again = sync_vectors(names, store, "letters", letters)
    assert (first.kept, first.dropped) == (0, 0) and first.encoded == again.kept == again.vectors.count()
    assert (again.dropped, again.encoded) == (0, 0) and store.versions() == {"letters": 1}
    fewer = sync_vectors(names.filter("name_type = 'primary'"), store, "letters", letters)
    assert fewer.encoded == 0 and fewer.dropped > 0 and fewer.kept + fewer.dropped == again.kept
    other = sync_vectors(names, store, "more letters", letters)
    assert other.kept == 0 and other.dropped == fewer.kept and other.encoded == first.encoded
    assert {r.model for r in store.read("vectors").collect()} == {"more letters"}


def test_stream_with_vectors(spark, lists, tmp_path):
    names, entities = lists.read("names"), lists.read("entities")
    store = ListStore(spark, str(tmp_path / "vectors"), "model")
    screener = Screener.open(names, entities, encoder=letters, vector_store=store)
    rows = [(1, "laet ssapmoc", 60.0, None, None)]
    spark.createDataFrame(rows, REQUEST_SCHEMA).write.parquet(str(tmp_path / "requests"))
    start_screening(
        request_stream(spark, str(tmp_path / "requests")), screener.index, names, entities,
        str(tmp_path / "out"), str(tmp_path / "checkpoint"), encoder=letters,
    ).awaitTermination()
    best = spark.read.parquet(str(tmp_path / "out" / "matches")).orderBy("rank").first()
    assert best.entity.reference_number == "60" and best.layers.embedding == 100.0
    assert spark.read.parquet(str(tmp_path / "out" / "audit")).first().created_at is not None


def test_evaluation_job(spark, lists, screener):
    cases, by_threshold, by_kind = evaluate(screener)
    kinds = {r.perturbation for r in cases.select("perturbation").collect()}
    assert {"negative", "order_swap", "typo"} <= kinds
    rows = {r.threshold: r for r in by_threshold.collect()}
    assert rows[60].recall >= rows[90].recall
    recall = {r.perturbation: r.recall for r in by_kind.collect()}
    assert recall["order_swap"] == 1.0


def test_stream_replay_replaces_its_batch(spark, lists, screener, tmp_path):
    requests = spark.createDataFrame(
        [(1, "Teal Compass", None, None, None), (2, "!!!", None, None, None)], REQUEST_SCHEMA
    )
    requests.write.parquet(str(tmp_path / "requests"))
    names, entities = lists.read("names"), lists.read("entities")
    for attempt in ("one", "two"):  # a lost checkpoint replays batch 0
        start_screening(
            request_stream(spark, str(tmp_path / "requests")), screener.index, names, entities,
            str(tmp_path / "out"), str(tmp_path / f"checkpoint-{attempt}"),
        ).awaitTermination()
    audit = spark.read.parquet(str(tmp_path / "out" / "audit")).collect()
    assert len(audit) == 1 and audit[0].match_count == 1
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).count() == 1
