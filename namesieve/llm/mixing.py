"""Mix sources to target weights by fitting token budgets with a subset sum.

Every source gets a budget of words. Whole passes over the source are taken
while they fit; the rest of the budget is a subset-sum problem: documents are
counted by exact length, all but a few long documents' worth of the budget is
spread over the lengths in proportion to their counts with seeded rounding, and
a bounded knapsack decided by dynamic programming fits what remains to the word. Which documents of a length are
taken follows a seeded hash, so reruns agree.

Data flow: texts are read once and reduced to (doc_id, source, size). The
dynamic program sees one row per (source, length), never documents, and its
table has a fixed size. A group of documents of one source and length is cut
into buckets of about ``bucket_rows`` by hash; whole buckets are taken in
order and only the bucket in which the count ends is ranked, so a third of
all rows in one group is spread over many tasks.

Nulls and odd rows: a null text has size 0, a null source is a source of its
own and comes last, a null id is an ordinary value. Documents of size 0 are
taken as often as their source's whole passes and add nothing. A source
without words has target 0. Repeated rows are separate documents. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namesieve.llm.common import WORD, located, whole
from namesieve.workspace import work_folder, written


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code-point order. The mix holds
    ``share`` times all words; no source exceeds ``cap`` times its own.
    ``table`` bounds the budget left to the dynamic program, in words beyond
    the longest document."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: float = 2.0
    seed: int = 17
    table: int = 1 << 16
    bucket_rows: int = 512


def _share(sizes: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Documents of each length in proportion to the counts, of at most ``budget`` words.

    The fractional part of a share is rounded up or down by ``unit``, a random
    number per length, so every length gets its share on average; what is then
    too much goes in the random ``order``.
    """
    total = int((sizes * counts).sum())
    taken = np.minimum(counts, np.floor(counts * (max(0, budget) / total) + unit)).astype(np.int64)
    over = int((sizes * taken).sum()) - max(0, budget)
    for i in order:
        if over <= 0:
            break
        fewer = min(int(taken[i]), 1)
        taken[i] -= fewer
        over -= fewer * int(sizes[i])
    return taken if over <= 0 else np.zeros_like(taken)


def _subset_sum(sizes: np.ndarray, spare: np.ndarray, left: int, order: np.ndarray) -> np.ndarray:
    """How many more of each length come nearest to ``left`` words, by a bounded knapsack.

    A length enters as 1, 2, 4, ... documents. ``via[s]`` is the item by which
    the sum s was first reached; items on a path strictly decrease, so none is
    used twice. Sums go up to twice ``left``, so that overshooting by less than
    the gap wins.
    """
    more = np.zeros_like(spare)
    reached = np.zeros(2 * left + 1, dtype=bool)
    reached[0] = True
    via = np.full(2 * left + 1, -1, dtype=np.int32)
    items: list[tuple[int, int]] = []
    for i in order:
        rest, piece = int(spare[i]), 1
        while rest > 0 and not reached[left]:
            piece = min(piece, rest)
            weight = piece * int(sizes[i])
            if weight >= len(reached):
                break
            fresh = reached[:-weight] & ~reached[weight:]
            if fresh.any():
                at = np.flatnonzero(fresh) + weight
                via[at] = len(items)
                reached[at] = True
            items.append((int(i), piece))
            rest -= piece
            piece *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        i, piece = items[via[at]]
        more[i] += piece
        at -= piece * int(sizes[i])
    return more


def fit_counts(
    sizes: np.ndarray, counts: np.ndarray, budget: int, table: int, seed: int = 0
) -> np.ndarray:
    """How many documents of each length to take so that the words come nearest to ``budget``.

    ``sizes`` are distinct and positive. All but a remainder of a few long
    documents is spread over the lengths in proportion to their counts; a
    bounded knapsack over the documents left, lengths in seeded order, fits the
    remainder. If it misses, more of the share is given back, eight times as
    much each time, up to ``table`` words (beyond the longest document).
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    rank = np.argsort(np.argsort(sizes))  # draws go by length, whatever the order of the rows
    draw = np.random.default_rng([seed, budget, len(sizes)])
    unit, order = draw.random(len(sizes))[rank], np.argsort(draw.random(len(sizes))[rank], kind="stable")
    best, missed, free = counts, total - budget, 4 * int(sizes.max())
    while missed:
        free = min(free, table, budget)
        taken = _share(sizes, counts, budget - free, order, unit)
        left = budget - int((sizes * taken).sum())
        for i in order:
            if left > table:
                more = min(int(counts[i] - taken[i]), (left - table) // int(sizes[i]))
                taken[i] += more
                left -= more * int(sizes[i])
        taken += _subset_sum(sizes, counts - taken, left, order)
        gap = abs(int((sizes * taken).sum()) - budget)
        if gap < missed:
            best, missed = taken, gap
        if free >= min(table, budget):
            break
        free *= 8
    return best


def _source_key(source: str) -> Column:
    """A key that tells null from every text, and sorts null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("~"))


def _ranked(sources: DataFrame, folder: str) -> DataFrame:
    """``sources`` with ``position``, their rank by key, without one task seeing all."""
    ordered = sources.orderBy("source_key").withColumn("part", F.spark_partition_id())
    ordered = written(ordered, f"{folder}/ordered")
    local = Window.partitionBy("part").orderBy("source_key")
    parts = ordered.groupBy("part").agg(F.count("*").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    return ordered.join(offsets, "part").select(
        "source_key", "source_size",
        (F.row_number().over(local) - 1 + F.col("offset")).alias("position"),
    )


def source_targets(sizes: DataFrame, params: MixParams, folder: str) -> DataFrame:
    """(source_key, source_size, target): the share of each source by weight, capped.

    What is above a cap is shared again among the sources below theirs, until
    none is above: each round is one aggregate over the table of sources.
    """
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(totals, folder)
    weights = F.array(*[F.lit(float(w)) for w in params.weights])
    weight = F.element_at(weights, (F.col("position") % len(params.weights) + 1).cast("int"))
    table = ranked.select(
        "source_key", "source_size", weight.alias("weight"),
        (F.col("source_size") * params.cap).alias("most"),
    )
    table = written(table, f"{folder}/sources")
    budget = params.share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("most")
        row = table.agg(
            F.count_if(full).alias("capped"),
            F.sum(F.when(full, F.col("most"))).alias("fixed"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
        ).first()
        if row["capped"] == capped or not row["free"]:
            break
        capped, level = row["capped"], (budget - (row["fixed"] or 0.0)) / row["free"]
    return table.select(
        "source_key", "source_size", F.least("most", F.col("weight") * level).alias("target")
    )


def _fit_source(params: MixParams):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        size, count = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // total) if total else 0
        extra = np.zeros_like(count)
        some = size > 0
        extra[some] = fit_counts(size[some], count[some], round(target - passes * total), params.table, params.seed)
        return rows[["source_key", "size", "n", "source_size", "target"]].assign(
            passes=passes, extra=extra
        )

    return fit


PLAN = (
    "source_key string, size long, n long, source_size long, target double, passes long, extra long"
)


def mix(
    docs: DataFrame, params: MixParams | None = None, text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), one row per row of ``docs``.

    ``copies`` says how often the mix repeats the document, ``taken`` its words
    in the mix. The columns ``keep`` go along; ties of an id are ordered by them.
    """
    params = params or MixParams()
    folder = work_folder(docs.sparkSession)
    sizes = docs.select(
        "doc_id", *keep, _source_key("source").alias("source_key"),
        F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), F.lit(params.seed)).alias("draw"),
    )
    sizes = written(sizes, f"{folder}/sizes")
    lengths = sizes.groupBy("source_key", "size").agg(F.count("*").alias("n"))
    targets = source_targets(sizes, params, folder)
    plan = lengths.join(targets, "source_key").groupBy("source_key").applyInPandas(
        _fit_source(params), PLAN
    )
    plan = written(plan, f"{folder}/plan")

    # Buckets by the draw, in the draw's order: rank of a row = rows in earlier buckets + rank within.
    buckets = F.ceil(F.col("n") / params.bucket_rows)
    unit = F.shiftrightunsigned("draw", 33) / float(1 << 31)
    drawn = sizes.join(plan, ["source_key", "size"]).withColumn(
        "bucket", F.floor(unit * buckets).cast("long")
    )
    drawn = written(drawn, f"{folder}/drawn")
    key = ["source_key", "size", "bucket"]
    filled = drawn.groupBy(*key).agg(F.count("*").alias("in_bucket"), F.first("extra").alias("want"))
    earlier = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    filled = filled.withColumn("before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    filled = filled.withColumn("quota", F.col("want") - F.col("before"))
    place = Window.partitionBy(*key).orderBy("draw", "doc_id", *keep)
    chosen = drawn.join(filled.select(*key, "quota"), key).withColumn("place", F.row_number().over(place))
    copies = F.col("passes") + (F.col("place") <= F.col("quota")).cast("long")
    return chosen.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"), *keep,
    )


def mixed_documents(
    docs: DataFrame, params: MixParams | None = None, in_files: bool = False
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    Rows find their number of copies by their place in the files, so repeated ids
    and repeated rows are separate documents. ``in_files``: the table is a plain
    scan of different files, see ``located``.
    """
    folder = work_folder(docs.sparkSession)
    placed = located(docs, folder, in_files)
    texts = placed.select("caller.doc_id", "caller.source", "caller.text", "path", "row")
    plan = mix(texts, params, keep=("path", "row")).filter("copies > 0").select("path", "row", "copies")
    joined = placed.join(written(plan, f"{folder}/copies"), ["path", "row"])
    many = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return joined.select("caller", many.alias("copy")).select("caller.*")
