"""Screening job over stored lists, and the evaluation job built on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.functions.text import normalise_name
from namesieve.operators.evaluation import (
    case_outcomes,
    eligible_seeds,
    entity_forms,
    evaluation_cases,
    negative_cases,
    precision_recall,
    recall_by_perturbation,
)
from namesieve.operators.index import NameIndex, build_index
from namesieve.operators.screening import (
    match_payload,
    screen,
    screening_audit,
    validate_requests,
)
from namesieve.operators.index_store import IndexStore
from namesieve.operators.vector_store import Encoder, VectorStore, VectorSync, snapshot_with_vectors
from namesieve.operators.vectors import encode_forms, sync_plan, vector_key
from namesieve.params import ScreeningParams
from namesieve.sources.store import ListStore
from namesieve.workspace import work_folder, written

def sync_vectors(
    names: DataFrame, store: VectorStore | ListStore, model: str, encoder: Encoder
) -> VectorSync:
    """Bring the stored vectors of ``model`` in step with the names.

    Only forms without a stored vector are encoded; vectors that no name needs
    are dropped. A ``VectorStore`` appends and strikes out, so a run writes in
    proportion to what is new. A ``ListStore``, partitioned by model, rewrites
    its table and drops the vectors of other models too.
    """
    spark = names.sparkSession
    form = normalise_name(F.col("name_original")).alias("form")
    forms = names.select(form).filter("form <> ''").distinct()
    if isinstance(store, VectorStore):
        return store.sync(forms, model, encoder)
    folder = work_folder(spark)
    forms = written(forms.withColumn("vector_key", vector_key("form")), f"{folder}/forms")
    stored = store.read("vectors")
    if stored is None:
        stored = spark.createDataFrame([], "vector_key string, vector array<float>, model string")
    keep, drop, missing = sync_plan(stored, forms, model)
    fresh = encode_forms(missing, encoder).withColumn("model", F.lit(model))
    columns = ["vector_key", "model", "vector"]
    fresh = written(fresh.select(*columns), f"{folder}/fresh")
    kept, dropped = keep.count(), drop.count()
    if dropped or not fresh.isEmpty():
        store.commit({"vectors": keep.select(*columns).unionByName(fresh)}, sorted({model, *store.versions()}))
    current = store.read("vectors", [model])
    if current is None:
        current = stored.limit(0)
    vectors = forms.join(current, "vector_key").select("form", "vector")
    return VectorSync(vectors, kept, dropped, fresh.count())


@dataclass(frozen=True)
class Screener:
    """Opened lists with their search tables; screens any number of batches."""

    names: DataFrame
    entities: DataFrame
    index: NameIndex
    params: ScreeningParams
    encoder: Encoder | None = None

    @staticmethod
    def open(
        names: DataFrame, entities: DataFrame, params: ScreeningParams | None = None,
        encoder: Encoder | None = None, path: str | None = None,
        vector_store: VectorStore | ListStore | None = None, model: str = "default",
    ) -> Screener:
        """Builds the search tables. ``vector_store`` keeps vectors from one opening to the next."""
        params = params or ScreeningParams()
        path = path or work_folder(names.sparkSession)
        vectors = None
        if encoder is not None and vector_store is not None:
            vectors = sync_vectors(names, vector_store, model, encoder).vectors
        elif encoder is not None:
            form = normalise_name(F.col("name_original")).alias("form")
            forms = names.select(form).filter("form <> ''").distinct()
            vectors = written(encode_forms(forms, encoder), f"{path}/name_vectors")
        index = build_index(names, entities, f"{path}/index", params, vectors)
        return Screener(names, entities, index, params, encoder)

    @staticmethod
    def of_store(
        store: IndexStore, encoder: Encoder | None = None, vector_store: VectorStore | None = None,
        model: str = "default", version: int | None = None,
    ) -> Screener:
        """Opens search tables that are kept (``IndexStore.refresh``); nothing is built.

        With an ``encoder``, only forms that ``vector_store`` lacks are encoded.
        """
        snapshot = store.open(version)
        if encoder is not None:
            snapshot = snapshot_with_vectors(snapshot, encoder, vector_store, model)
        return Screener(snapshot.names, snapshot.entities, snapshot.index, store.params, encoder)

    def screen(self, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(matches with payload, audit rows, rejected requests)."""
        folder = work_folder(requests.sparkSession)
        valid, rejected = validate_requests(requests, self.params)
        valid = written(valid, f"{folder}/requests")
        vectors = None
        if self.encoder is not None:
            forms = valid.select(F.col("query_form").alias("form")).distinct()
            vectors = written(encode_forms(forms, self.encoder), f"{folder}/query_vectors")
        matches = screen(valid, self.index, self.params, vectors, path=folder)
        payload = written(match_payload(matches, self.names, self.entities, folder), f"{folder}/matches")
        return payload, screening_audit(valid, payload), rejected


def screen_and_audit(screener: Screener, requests: DataFrame, store: ListStore) -> DataFrame:
    """Screen a batch and append its audit rows to the store's screening log."""
    payload, audit, _ = screener.screen(requests)
    store.append_log(audit.withColumn("created_at", F.current_timestamp()), "screenings")
    return payload


def evaluate(screener: Screener) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, precision and recall per threshold, recall per perturbation).

    Cases are made from the screener's own lists and screened at the lowest
    threshold with ten results each.
    """
    entities = screener.entities.withColumn("seed", F.col("entity_id"))
    named = screener.names.drop("source_list", "reference_number").join(
        entities.select("entity_id", "source_list", "reference_number"), "entity_id"
    )
    forms = entity_forms(
        named.withColumn("name_normalised", normalise_name(F.col("name_original")))
    )
    positive = evaluation_cases(eligible_seeds(entities), forms)
    cases = written(
        positive.unionByName(negative_cases(forms)), f"{work_folder(named.sparkSession)}/cases"
    )
    requests = cases.select(
        F.col("case_id").alias("query_id"), F.col("query").alias("name"),
        F.lit(60.0).alias("threshold"), F.lit(10).alias("max_results"),
        F.lit(None).cast("string").alias("entity_type"),
    )
    payload, _, _ = screener.screen(requests)
    key = F.concat_ws("/", "truth.source_list", "truth.reference_number")
    keyed = cases.withColumn("truth_key", F.when(F.col("truth").isNotNull(), key))
    results = payload.select(
        F.col("query_id").alias("case_id"),
        F.concat_ws("/", "entity.source_list", "entity.reference_number").alias("entity_key"),
        "score",
    )
    outcomes = case_outcomes(keyed, results, "truth_key", "entity_key")
    return (
        cases,
        precision_recall(outcomes, "truth_key"),
        recall_by_perturbation(outcomes, "truth_key"),
    )
