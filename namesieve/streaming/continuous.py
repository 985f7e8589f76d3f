"""Continuous screening: requests arrive as files, answers leave per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from namesieve.operators.index import NameIndex
from namesieve.operators.index_store import IndexStore, Snapshot
from namesieve.operators.screening import (
    match_payload,
    screen,
    screening_audit,
    validate_requests,
)
from namesieve.operators.vector_store import VectorStore, snapshot_with_vectors
from namesieve.operators.vectors import encode_forms
from namesieve.params import ScreeningParams
from namesieve.workspace import drop_folder, exists, work_folder, written

REQUEST_SCHEMA = (
    "query_id bigint, name string, threshold double, max_results int, entity_type string"
)


def request_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Requests as files; a backlog is taken up ``files_per_batch`` files at a time."""
    reader = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def screen_batch(
    batch: DataFrame,
    number: int,
    snapshot: Snapshot,
    output: str,
    params: ScreeningParams,
    encoder: Callable | None = None,
    **screening,
) -> None:
    """Screen one micro-batch and overwrite its folders in ``matches``, ``audit`` and ``rejected``.

    The audit rows carry the version of the lists that answered.
    """
    spark = batch.sparkSession
    folder = work_folder(spark)
    valid, rejected = validate_requests(batch, params)
    valid = written(valid, f"{folder}/requests")
    vectors = None
    if encoder is not None:
        forms = valid.select(F.col("query_form").alias("form")).distinct()
        vectors = written(encode_forms(forms, encoder), f"{folder}/query_vectors")
    matches = screen(valid, snapshot.index, params, vectors, path=folder, **screening)
    payload = match_payload(matches, snapshot.names, snapshot.entities, folder)
    for name, df in {"matches": payload, "rejected": rejected}.items():
        df.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")
    answers = spark.read.schema(payload.schema).parquet(f"{output}/matches/batch={number}")
    audit = screening_audit(valid, answers).withColumns(
        {"list_version": F.lit(snapshot.version), "created_at": F.current_timestamp()}
    )
    audit.write.mode("overwrite").parquet(f"{output}/audit/batch={number}")
    drop_folder(spark, folder)  # a stream that runs for long must not fill the storage


def _started(requests: DataFrame, process: Callable, checkpoint: str, every: str | None) -> StreamingQuery:
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    stream = requests.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return stream.trigger(**trigger).start()


def start_screening(
    requests: DataFrame,
    index: NameIndex,
    names: DataFrame,
    entities: DataFrame,
    output: str,
    checkpoint: str,
    params: ScreeningParams | None = None,
    encoder: Callable | None = None,
    every: str | None = None,
    **screening,
) -> StreamingQuery:
    """Screen a stream of requests against fixed lists until it is drained, or every so often.

    A batch replayed after a failure has the same number and therefore replaces
    what its first run left behind. ``encoder`` gives the queries their vectors,
    for an index that has them.
    """
    params = params or ScreeningParams()
    snapshot = Snapshot(0, names, entities, index)

    def process(batch: DataFrame, number: int) -> None:
        screen_batch(batch, number, snapshot, output, params, encoder, **screening)

    return _started(requests, process, checkpoint, every)


def pinned_version(store: IndexStore, output: str, number: int) -> int:
    """The version of the lists that answers a micro-batch: the one current when it first ran."""
    path = f"{output}/pins/batch={number}"
    if exists(store.spark, f"{path}/_SUCCESS"):
        return store.spark.read.schema("version int").parquet(path).first()["version"]
    version = store.current()
    row = store.spark.createDataFrame([(version,)], "version int")
    row.coalesce(1).write.mode("overwrite").parquet(path)
    return version


def screen_pinned(
    batch: DataFrame,
    number: int,
    store: IndexStore,
    output: str,
    encoder: Callable | None = None,
    vector_store: VectorStore | None = None,
    model: str = "default",
) -> None:
    """One micro-batch with all layers, against the version of the lists pinned to its number.

    With an ``encoder``, only listed forms that ``vector_store`` lacks are encoded.
    """
    snapshot = store.open(pinned_version(store, output, number))
    if encoder is not None:
        snapshot = snapshot_with_vectors(snapshot, encoder, vector_store, model)
    screen_batch(batch, number, snapshot, output, store.params, encoder)


def start_pinned_screening(
    requests: DataFrame,
    store: IndexStore,
    output: str,
    checkpoint: str,
    encoder: Callable | None = None,
    vector_store: VectorStore | None = None,
    model: str = "default",
    every: str | None = None,
) -> StreamingQuery:
    """Screen a stream with all layers against lists that are refreshed meanwhile.

    Every micro-batch is answered by one version of the lists, pinned under its
    number before it runs: a refresh is seen from the next batch on, and a batch
    that is replayed after a failure gives the answers of its first run.
    """

    def process(batch: DataFrame, number: int) -> None:
        screen_pinned(batch, number, store, output, encoder, vector_store, model)

    return _started(requests, process, checkpoint, every)
