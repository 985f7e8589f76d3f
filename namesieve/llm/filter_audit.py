"""What each filter of a chain removes, over all orders of the chain.

A state is the set of filters applied so far: a corner of the subset lattice. An
edge applies one more filter and removes the documents that fail it and none of
the state. ``lattice`` counts paths: ``forward`` the orders that reach a state
from the empty set, ``backward`` the orders that lead from a state to the full
set. An edge lies on forward(state) * backward(next state) orders; with that
weight its removals sum to the Shapley value of its filter, times the number of
orders. The steps of a single order are the edges of its path, so they are read
from the same table and no order is run by itself.

Data flow: one pass over the texts gives a bit mask of the text filters and a
digest; the digests that several rows share get the smallest id, by partial
aggregates, and only they are joined back. Documents then become counts by
(part, mask), at most 2^k rows a part, whatever their number; edges and orders
are built from those. Written tables stand between, so that Spark splits a text
that a third of all rows hold. k is at most ``MOST_FILTERS``: orders grow with k!.

Nulls and odd rows: a null text is empty, a null part is the empty string. A null
id ranks after every other; rows with the same id and text are no copies of
another. Labels count a document as good (toxic) if any of its label rows says
so; null labels say nothing. A text of any length is read whole. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namesieve.llm.common import whole
from namesieve.workspace import work_folder, written

MOST_FILTERS = 7
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def default_filters() -> dict[str, Column]:
    """Conditions under which a text, the column ``body``, fails."""
    body = F.col("body")
    parts = F.split(F.translate(body, "\t\n\u000b\u000c\r", "     "), " ", -1)
    n_words = F.size(F.array_remove(parts, ""))
    distinct = F.array_distinct(parts)
    n_distinct = F.size(F.array_remove(distinct, ""))
    capitals = F.octet_length(body) - F.octet_length(F.translate(body, UPPER, ""))
    return {
        "A": n_words < 200,
        "B": 100 * n_distinct < 50 * n_words,
        "C": 100 * capitals > 3 * F.char_length(body),
        "D": body.rlike(r"[#$%&*|]"),
    }


def lattice(n: int) -> list[dict[str, int]]:
    """Edges (state, bit, orders) of the subset lattice over ``n`` filters.

    ``orders`` is the number of orders that take the edge.
    """
    full = (1 << n) - 1
    bits = [1 << i for i in range(n)]
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):  # a superset is a larger number
        for bit in bits:
            if not state & bit:
                forward[state | bit] += forward[state]
    for state in range(full, -1, -1):
        for bit in bits:
            if not state & bit:
                backward[state] += backward[state | bit]
    return [
        {"state": state, "bit": bit, "orders": forward[state] * backward[state | bit]}
        for state in range(full + 1) for bit in bits if not state & bit
    ]


def order_steps(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, state, bit): the edges on the path of every order."""
    steps = []
    for order in permutations(range(len(names))):
        state, text = 0, "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            steps.append((text, step, state, 1 << i))
            state |= 1 << i
    return steps


def failure_masks(
    docs: DataFrame, filters: dict[str, Column], copies: str | None, part: str, text: str, folder: str
) -> DataFrame:
    """(doc_id, part, mask): bit i says that the document fails the i-th filter.

    ``copies`` names a last filter that fails a text which a smaller id holds too.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole(text).alias("body")
    )
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.coalesce(fails, F.lit(False)).cast("int") * (1 << i)
    masked = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest"))
    masked = written(masked, f"{folder}/masked")
    if copies is None:
        return masked.drop("digest")
    shared = masked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    shared = written(shared.filter("n > 1").drop("n"), f"{folder}/shared")
    later = F.col("first_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    bit = later.cast("int") * (1 << len(filters))
    return masked.join(shared, "digest", "left").select("doc_id", "part", (F.col("mask") + bit).alias("mask"))


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row per id."""
    def any_is_one(name):
        return F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0))

    flags = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
    return flags.agg(any_is_one("quality").alias("good"), any_is_one("toxic").alias("toxic"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the filters they fail."""
    marked = masks.join(label_flags(labels), "doc_id", "left")
    return marked.groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def edge_removals(counted: DataFrame, n_filters: int) -> DataFrame:
    """One row per part and edge of the lattice, edges that remove nothing included.

    (part, state, bit, orders, removed, good_lost, toxic_lost, kept, fails,
    unique_fails, shapley).
    """
    edges = F.from_json(
        F.lit(json.dumps(lattice(n_filters))), "array<struct<state: int, bit: int, orders: long>>"
    )
    on_edges = counted.select("*", F.inline(edges))
    mask, state, bit = F.col("mask"), F.col("state"), F.col("bit")
    untouched = mask.bitwiseAND(state) == 0
    failing = mask.bitwiseAND(bit) != 0

    def total(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    removals = on_edges.groupBy("part", "state", "bit", "orders").agg(
        total(untouched & failing, "n").alias("removed"),
        total(untouched & failing, "good").alias("good_lost"),
        total(untouched & failing, "toxic").alias("toxic_lost"),
        total(untouched & ~failing, "n").alias("kept"),
        total(failing, "n").alias("fails"),
        total(mask == bit, "n").alias("unique_fails"),
    )
    of_filter = Window.partitionBy("part", "bit")
    return removals.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(of_filter))


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column] | None = None,
    copies: str | None = "E",
    part: str = "lang",
    text: str = "text",
) -> DataFrame:
    """Counts per part, order and step; see the module's text.

    ``filters`` gives conditions over the column ``body`` under which a text
    fails, by name; ``copies`` names the filter of texts that a smaller id holds.
    (part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley).
    """
    spark = docs.sparkSession
    filters = default_filters() if filters is None else filters
    names = [*filters, *([] if copies is None else [copies])]
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"between 1 and {MOST_FILTERS} filters of different names can be audited")
    folder = work_folder(spark)
    masks = failure_masks(docs, filters, copies, part, text, folder)
    counted = written(cells(masks, labels), f"{folder}/cells")
    edges = edge_removals(counted, len(names))
    # k! * k rows, a fixed number, so they may be broadcast.
    steps = spark.createDataFrame(order_steps(names), "filter_order string, step int, state int, bit int")
    name = F.element_at(F.array(*map(F.lit, names)), (F.log2(F.col("bit")) + 1).cast("int"))
    return edges.join(F.broadcast(steps), ["state", "bit"]).select(
        "part", "filter_order", "step", name.alias("filter"), "kept", "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
