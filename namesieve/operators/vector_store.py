"""Vectors of names, kept by content and model: appended and struck out, not rewritten.

A sync appends the vectors of new forms as one segment beside a list of the
keys that no form needs any more. Readers leave struck keys out. When more than
``dead_share`` of the stored rows are struck, the living are written as a new
base. Other models have stores of their own and are not touched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.operators.index_store import Snapshot
from namesieve.operators.vectors import encode_forms, vector_key
from namesieve.sources.segments import SegmentStore
from namesieve.workspace import drop_folder, work_folder, written

Encoder = Callable[[], Callable[[np.ndarray], np.ndarray]]


@dataclass(frozen=True)
class VectorSync:
    """Vectors (form, vector) of all forms, and how many were kept, dropped and encoded."""

    vectors: DataFrame
    kept: int
    dropped: int
    encoded: int


@dataclass(frozen=True)
class VectorStore:
    """Vectors under ``root``, one segment store per model."""

    spark: SparkSession
    root: str
    dead_share: float = 0.3

    def _segments(self, model: str) -> SegmentStore:
        return SegmentStore(self.spark, f"{self.root}/model={model}", {"vectors": ("vector_key", "gone")})

    def read(self, model: str) -> DataFrame:
        """(vector_key, vector) of a model."""
        store = self._segments(model)
        log = store.log()
        if not log:
            return self.spark.createDataFrame([], "vector_key string, vector array<float>")
        return store.read("vectors", max(log), log)

    def forget(self, model: str) -> None:
        """Remove the vectors of a model that is not used any more."""
        drop_folder(self.spark, f"{self.root}/model={model}")

    def sync(self, forms: DataFrame, model: str, encoder: Encoder, drop: bool = True) -> VectorSync:
        """Encode the forms without a stored vector, and strike vectors no form needs.

        ``forms``: (form), distinct. With ``drop`` false nothing is struck, as
        when other versions of the lists still need what this one does not.
        """
        folder = work_folder(self.spark)
        forms = written(forms.select("form", vector_key("form").alias("vector_key")), f"{folder}/forms")
        keys, stored = forms.select("vector_key"), self.read(model).select("vector_key")
        missing = forms.join(stored, "vector_key", "left_anti")
        fresh = written(encode_forms(missing, encoder).select("vector_key", "vector"), f"{folder}/fresh")
        gone = stored.join(keys, "vector_key", "left_anti") if drop else stored.limit(0)
        gone = written(gone, f"{folder}/gone")
        encoded, dropped, before = fresh.count(), gone.count(), stored.count()
        store = self._segments(model)
        log = store.log()
        if encoded or dropped or not log:
            version = max(log, default=-1) + 1
            base = log[version - 1].base if log else version
            store.write(version, base, {"vectors": fresh, "gone": gone})
            log = store.log()
            rows = sum(store.segment(log[n], "vectors").count() for n in range(base, version + 1))
            if rows - (before - dropped + encoded) > self.dead_share * rows:
                store.merge(["vectors"])
        vectors = forms.join(self.read(model), "vector_key").select("form", "vector")
        return VectorSync(vectors, before - dropped, dropped, encoded)


def snapshot_with_vectors(
    snapshot: Snapshot, encoder: Encoder, store: VectorStore | None = None, model: str = "default"
) -> Snapshot:
    """The snapshot with a vector layer; forms are encoded unless ``store`` has their vectors.

    Nothing is struck from the store: other versions of the lists may need it.
    """
    forms = snapshot.index.forms.select("form")
    if store is not None:
        return snapshot.with_vectors(store.sync(forms, model, encoder, drop=False).vectors)
    folder = work_folder(forms.sparkSession)
    return snapshot.with_vectors(written(encode_forms(forms, encoder), f"{folder}/name_vectors"))
