"""Candidate generation: exact, phonetic, fuzzy and vector joins.

All sub-scores depend on the normalised text only, so every join runs on
distinct *forms* (one row per normalised text) and is expanded to name rows at
the end. Heavily repeated names therefore cost one row before any shuffle on
their text.

The two similarity joins have no equi-join key. Both sides are cut into blocks
of bounded size, and each pair of blocks that can hold a match becomes one
group. A group emits at most ``limit`` rows per query, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesieve.functions.phonetics import phonetic_codes, phonetic_key
from namesieve.functions.similarity import NameBlock
from namesieve.functions.text import name_variants, normalise_name, sorted_tokens
from namesieve.operators.segment_index import FINE_CUTOFF, settled_rows
from namesieve.operators.vector_cells import (
    assigned,
    draw_pivots,
    home_visits,
    measured,
    other_visits,
)
from namesieve.params import ScreeningParams
from namesieve.workspace import work_folder, written

NAME_BLOCK = 32_768
VECTOR_BLOCK = 8192
QUERY_BLOCK = 4096
SMALLEST_QUERY_BLOCK = 64
LONGEST_NAME = 2**31
#: Keys that are sent to every task may take this many bytes, with so many for each beside its text.
FEW_BYTES, ROW_BYTES = 8 << 20, 32


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kernel_partitions(df: DataFrame) -> int:
    """Tasks for block kernels: several per core, whatever the shuffle setting."""
    shuffle, cores = shuffle_partitions(df), df.sparkSession.sparkContext.defaultParallelism
    return min(4 * shuffle, max(shuffle, 8 * cores))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Fix the partition count ahead of work that is heavy for its size in bytes.

    Adaptive execution merges partitions by bytes, which would put such work
    into a few tasks; it leaves an explicit partition count alone.
    """
    return df.repartition(shuffle_partitions(df), *keys)


def spread_scan(df: DataFrame) -> DataFrame:
    """Shuffle a plain scan only if it has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def normalised_rows(df: DataFrame, text: str, output: str = "form") -> DataFrame:
    """Add the normalised form and drop rows that have none.

    The explode keeps the expression from being copied into a pushed-down filter.
    """
    form = F.filter(F.array(normalise_name(F.col(text))), lambda f: f != "")
    return df.select("*", F.explode(form).alias(output))


def distinct_forms(rows: DataFrame, params: ScreeningParams, codes: bool = True) -> DataFrame:
    """One row per form with its search variants and their phonetic codes."""
    return coded_forms(spread(rows.select("form").distinct(), "form"), params, codes)


def coded_forms(forms: DataFrame, params: ScreeningParams, codes: bool = True) -> DataFrame:
    """Forms with their search variants and the phonetic codes of these."""
    forms = forms.withColumn("variants", name_variants(F.col("form"), params.honorifics))
    return forms.withColumn("codes", phonetic_codes("variants")) if codes else forms


def meeting(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` ahead of a join with the written ``keys``: cut to these if the keys are few.

    Few keys are sent to the rows, so that a large table is not shuffled for the
    sake of a few of its rows. Otherwise the rows are left to the join.
    """
    wanted = keys.select(key).distinct()
    size = wanted.agg(F.sum(F.octet_length(F.col(key).cast("string")) + F.lit(ROW_BYTES))).first()[0] or 0
    return rows.join(F.broadcast(wanted), key, "left_semi") if size <= FEW_BYTES else rows


def _keyed_pairs(query_keys: DataFrame, name_keys: DataFrame) -> DataFrame:
    return query_keys.join(name_keys, "key").select("query_form", "name_form").distinct()


def exact_pairs(query_forms: DataFrame, name_forms: DataFrame) -> DataFrame:
    """Form pairs that share a search variant. ``query_forms`` should be written, for it is read twice."""
    asked = query_forms.select(F.col("form").alias("query_form"), F.explode("variants").alias("key"))
    names = name_forms.select(F.col("form").alias("name_form"), F.explode("variants").alias("key"))
    return _keyed_pairs(asked, meeting(names, asked, "key"))


def phonetic_pairs(query_forms: DataFrame, name_forms: DataFrame) -> DataFrame:
    """Form pairs that share the sorted phonetic key of a variant."""

    def keys(forms: DataFrame, side: str) -> DataFrame:
        exploded = forms.select(F.col("form").alias(side), F.explode("codes").alias("codes"))
        return exploded.select(side, phonetic_key("codes").alias("key")).distinct()

    return _keyed_pairs(keys(query_forms, "query_form"), keys(name_forms, "name_form"))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows per key. Each task prunes its own rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit)


def _length_thresholds(cutoff: float) -> list[int]:
    """Bucket starts such that lengths within the ratio bound are at most one bucket apart.

    A ratio of at least ``cutoff`` needs ``longer / shorter <= (200 - cutoff) / cutoff``.
    """
    bound = (200.0 - cutoff) / cutoff
    starts = [1]
    while starts[-1] < LONGEST_NAME:
        starts.append(max(starts[-1] + 1, math.floor(starts[-1] * bound + 1e-9) + 1))
    return starts


def _length_bucket(key: str, starts: list[int]) -> Column:
    """Number of thresholds the length reaches."""
    steps = " ".join(f"when length({key}) < {s} then {i}" for i, s in enumerate(starts))
    return F.expr(f"case {steps} else {len(starts)} end")


def _block_grid(queries: DataFrame, names: DataFrame, name_block: int) -> DataFrame:
    """Per bucket: into how many slots each side is split. One row per bucket."""
    partitions = kernel_partitions(queries) // 2
    name_counts = names.groupBy("bucket").agg(F.count("*").alias("n_names"))
    query_counts = queries.groupBy("bucket").agg(F.count("*").alias("n_queries"))
    name_slots = F.ceil(F.col("n_names") / name_block)
    needed = F.ceil(F.col("n_queries") / QUERY_BLOCK)
    # Split further while that fills the cluster and blocks stay worthwhile.
    wanted = F.least(F.ceil(F.col("n_queries") / SMALLEST_QUERY_BLOCK), F.lit(partitions))
    return name_counts.join(query_counts, "bucket").select(
        "bucket",
        name_slots.alias("name_slots"),
        F.greatest(needed, F.ceil(wanted / name_slots)).alias("query_slots"),
    )


def _slot(key: str, slots: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(slots))


def _slots(count: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))


def block_top(
    queries: DataFrame,
    names: DataFrame,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    limit: int,
    name_block: int = NAME_BLOCK,
) -> DataFrame:
    """Best ``limit`` names per query under a block kernel.

    ``queries`` has (bucket, query_key, ...) with one row per target bucket,
    ``names`` has (bucket, name_key, first_id, ...), both with distinct keys.
    The kernel returns (query_key, name_key, first_id, score).
    """
    # One row per bucket, and the number of buckets is fixed: safe to broadcast.
    grid = F.broadcast(_block_grid(queries, names, name_block))
    partitions = kernel_partitions(queries)
    group = ["bucket", "name_slot", "query_slot"]
    # A fixed partition count: groups are small in bytes but heavy in work, so
    # they must not be coalesced by size.
    left = (
        queries.join(grid, "bucket")
        .withColumn("query_slot", _slot("query_key", "query_slots"))
        .withColumn("name_slot", _slots("name_slots"))
        .drop("name_slots", "query_slots")
        .repartition(partitions, *group)
    )
    right = (
        names.join(grid, "bucket")
        .withColumn("name_slot", _slot("name_key", "name_slots"))
        .withColumn("query_slot", _slots("query_slots"))
        .drop("name_slots", "query_slots")
        .repartition(partitions, *group)
    )
    found = (
        left.groupBy(*group)
        .cogroup(right.groupBy(*group))
        .applyInPandas(
            lambda q, n: kernel(q, n),
            "query_key string, name_key string, first_id long, score double",
        )
    )
    order = [F.desc("score"), F.asc("first_id")]
    return top_rows(found, ["query_key"], order, limit).drop("_rank")


def _top_frame(parts: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    if not parts:
        text, ids = pd.Series([], dtype=object), pd.Series([], dtype=np.int64)
        score = pd.Series([], dtype=np.float64)
        return pd.DataFrame({"query_key": text, "name_key": text, "first_id": ids, "score": score})
    return pd.DataFrame(
        {
            "query_key": [p[0] for p in parts for _ in p[3]],
            "name_key": np.concatenate([p[1] for p in parts]),
            "first_id": np.concatenate([p[2] for p in parts]),
            "score": np.concatenate([p[3] for p in parts]),
        }
    )


def _fuzzy_kernel(cutoff: float, limit: int):
    def kernel(queries: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or names.empty:
            return _top_frame([])
        block = NameBlock(names["name_key"].tolist(), names["first_id"].to_numpy())
        labels = np.array(block.names, dtype=object)
        parts = []
        for query in queries["query_key"]:
            at, score = block.top(query, cutoff, limit)
            if len(at):
                parts.append((query, labels[at], block.ids[at], score))
        return _top_frame(parts)

    return kernel


def _vector_kernel(cutoff: float, limit: int):
    def kernel(queries: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or names.empty:
            return _top_frame([])
        matrix = np.array(names["vector"].tolist(), dtype=np.float64)
        ids = names["first_id"].to_numpy()
        labels = names["name_key"].to_numpy()
        parts = []
        for start in range(0, len(queries), 256):
            batch = queries.iloc[start : start + 256]
            # Rounded, so that equal cosines rank alike whatever the block shape.
            cosines = np.array(batch["vector"].tolist(), dtype=np.float64) @ matrix.T
            cosines = np.round(cosines, 9)
            for query, row in zip(batch["query_key"], cosines):
                at = np.flatnonzero(row >= cutoff)
                if len(at) > limit:  # keep all ties at the boundary for the id order
                    at = at[row[at] >= np.partition(row[at], -limit)[-limit]]
                at = at[np.lexsort((ids[at], -row[at]))[:limit]]
                if len(at):
                    parts.append((query, labels[at], ids[at], row[at]))
        return _top_frame(parts)

    return kernel


def first_rows(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """Per key: the smallest name_id, and the name rows with the ``limit`` smallest.

    ``rows`` has (name_id, entity_id, entity_type, form). Returns
    (name_key, first_id, rows), with at most ``limit`` rows in each array.
    """
    row = F.struct("name_id", "entity_id", "entity_type", F.col("form").alias("name_form"))
    keyed = rows.select(key.alias("name_key"), "name_id", row.alias("row"))
    first = top_rows(keyed, ["name_key"], [F.asc("name_id")], limit)
    return first.groupBy("name_key").agg(
        F.min("name_id").alias("first_id"), F.collect_list("row").alias("rows")
    )


def token_keys(rows: DataFrame, params: ScreeningParams) -> DataFrame:
    """Search table of the fuzzy layer: one row per token-sorted name."""
    return first_rows(rows, sorted_tokens(F.col("form")), params.fuzzy_limit)


def vector_keys(rows: DataFrame, vectors: DataFrame, params: ScreeningParams) -> DataFrame:
    """Search table of the vector layer: one row per form that has a vector.

    ``vectors`` has (form, vector) with distinct forms.
    """
    keyed = vectors.select(F.col("form").alias("name_key"), "vector")
    return first_rows(rows, F.col("form"), params.vector_limit).join(keyed, "name_key")


def _best_rows(top: DataFrame, keys: DataFrame, limit: int, score: str) -> DataFrame:
    """From best keys to best name rows.

    The first ``limit`` rows by (score, name_id) lie within the best ``limit``
    keys by (score, smallest name_id), and within the ``limit`` smallest ids
    of each of them, so neither cut loses a row.
    """
    rows = (
        top.select("query_key", "name_key", F.col("score").alias(score))
        .join(keys.select("name_key", "rows"), "name_key")
        .select("query_key", score, F.inline("rows"))
    )
    return top_rows(rows, ["query_key"], [F.desc(score), F.asc("name_id")], limit).drop("_rank")


def fuzzy_rows(
    query_forms: DataFrame,
    keys: DataFrame,
    params: ScreeningParams,
    name_block: int = NAME_BLOCK,
    path: str | None = None,
) -> DataFrame:
    """Best name rows per query form by token-sort ratio, canonical forms only.

    ``query_forms`` has distinct (form); ``keys`` comes from ``token_keys``.
    Returns (query_form, token_sort_ratio, name_id, entity_id, entity_type, name_form).
    Queries whose rows the segment index settles do not meet the list again.
    """
    starts = _length_thresholds(params.fuzzy_cutoff)
    keyed = query_forms.select(
        F.col("form").alias("query_form"), sorted_tokens(F.col("form")).alias("query_key")
    )
    asked = keyed.select("query_key").distinct()
    path = path or work_folder(keys.sparkSession)
    settled = None
    if params.fuzzy_cutoff <= FINE_CUTOFF:
        settled = settled_rows(asked, keys, params.fuzzy_limit, path)
    if settled is not None:
        settled = written(settled, f"{path}/settled")
        asked = asked.join(settled.select("query_key"), "query_key", "left_anti")
    own = _length_bucket("query_key", starts)
    queries = asked.select("query_key", F.explode(F.array(own - 1, own, own + 1)).alias("bucket"))
    names = keys.select(
        "name_key", "first_id", _length_bucket("name_key", starts).alias("bucket")
    )
    kernel = _fuzzy_kernel(params.fuzzy_cutoff, params.fuzzy_limit)
    top = block_top(queries, names, kernel, params.fuzzy_limit, name_block)
    if settled is not None:
        order = [F.desc("score"), F.asc("first_id")]
        best = top_rows(settled, ["query_key"], order, params.fuzzy_limit).drop("_rank")
        top = top.unionByName(best)
    # At most ``limit`` rows a query: few of the keys are needed, so the others are not shuffled for them.
    top = written(top, f"{path}/fuzzy_top")
    rows = _best_rows(top, meeting(keys, top, "name_key"), params.fuzzy_limit, "token_sort_ratio")
    return keyed.join(rows, "query_key").drop("query_key")


def vector_rows(
    query_vectors: DataFrame,
    keys: DataFrame,
    params: ScreeningParams,
    name_block: int = VECTOR_BLOCK,
    path: str | None = None,
) -> DataFrame:
    """Best name rows per query form by cosine of unit vectors.

    ``query_vectors`` has (form, vector) with distinct forms; ``keys`` comes
    from ``vector_keys``. Returns (query_form, cosine, name_id, entity_id,
    entity_type, name_form). Both should be written tables, for they are read
    more than once. Working tables go to ``path``.

    Names are placed in cells of about ``name_block``. A query meets its most
    promising cell first; the score of its last place there is a floor, and of
    the other cells it meets only those that can hold a name at or above it.
    """
    if params.cosine_cutoff <= 0:
        raise ValueError("cosine_cutoff must be positive")
    path = path or work_folder(keys.sparkSession)
    limit, kernel = params.vector_limit, _vector_kernel(params.cosine_cutoff, params.vector_limit)
    queries = query_vectors.select(F.col("form").alias("query_key"), "vector")
    total = keys.count()
    if total <= name_block:  # one cell, which every query meets
        names = keys.select(F.lit(0).alias("bucket"), "name_key", "first_id", "vector")
        top = block_top(queries.withColumn("bucket", F.lit(0)), names, kernel, limit, name_block)
    else:
        queries = written(queries, f"{path}/vector_queries")
        pivots = draw_pivots(keys, total, name_block)
        names = written(assigned(keys, pivots), f"{path}/vector_names")
        cells = measured(names, pivots)
        names = names.select("bucket", "name_key", "first_id", "vector")
        home = block_top(home_visits(queries, cells), names, kernel, limit, name_block)
        home = written(home, f"{path}/vector_home")
        full = home.groupBy("query_key").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        last = F.when(F.col("n") >= limit, F.col("last"))
        floors = queries.join(full, "query_key", "left").withColumn(
            "floor", F.coalesce(last, F.lit(params.cosine_cutoff))
        )
        visits = written(other_visits(floors, cells), f"{path}/vector_visits")
        top = home.unionByName(block_top(visits, names, kernel, limit, name_block))
        top = top_rows(top, ["query_key"], [F.desc("score"), F.asc("first_id")], limit)
    rows = _best_rows(top, keys, limit, "cosine")
    return rows.withColumnRenamed("query_key", "query_form")


def candidate_union(*sources: DataFrame) -> DataFrame:
    """Union of candidate sets without duplicates on (query, name)."""
    keys = ["query_id", "name_id"]
    union = sources[0].select(*keys)
    for source in sources[1:]:
        union = union.unionByName(source.select(*keys))
    return union.distinct()
