"""Ranked lexical search of a set of items over all documents, by bag deduplication.

Only terms that an item holds can add to a score. So a document is restricted to
the items' vocabulary: its bag is the vector of (term, frequency) pairs there,
and beside the bag only its length norm ``m`` matters. Documents that agree in
both are one class. Classes are found by a hash and verified by the vector and
``m`` themselves; each is scored once against every item, and the documents
behind the best classes come back in ascending order of their ids.

Exactness: scores are 64-bit integers. The best k documents of an item lie in
its best k classes by (score, smallest id), for each class puts a document before
all those behind it; and no class gives more than its k smallest ids. So neither
a class nor a task keeps more than k of anything per item, and nothing is lost.

Data flow: one pass over the texts writes (id, length, bag) where a text is
read. Totals and document frequencies are sums over that table. Classes are
grouped by hash; every task cuts a class to its k smallest ids before the
shuffle, so a bag that a third of all rows share costs k rows a task. Scoring
reads classes in blocks and keeps k classes per item. Items go to the tasks in
blocks of about ``block_terms`` terms; a larger set takes several passes.

Nulls and odd rows: a null or empty text has no terms and is never listed. Ids
are integers; a null id comes after all others. Repeated rows are separate
documents. Every row of ``items`` is ranked by itself, so rows with one id are
listed one beside the other; an item without terms has no documents. Other columns
are not read. Without documents or items the result is empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namesieve.llm.chunks import binary_array, packed_ids, slices
from namesieve.llm.common import bounded_batches, whole
from namesieve.workspace import work_folder, written

#: What separates terms: ASCII characters other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for a null id and sorts after all others.
LAST_ID = (1 << 63) - 1
#: Cells of a scoring block.
CELLS = 4_000_000


@dataclass(frozen=True)
class SearchParams:
    """``top`` documents per item; terms of items that one pass takes up."""

    top: int = 20
    block_terms: int = 200_000


def term_lists(texts: pa.Array) -> pa.Array:
    """The terms of each text, in lower case; an empty text has one empty term."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=GAP, replacement=" ")
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))


def bags(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Terms per text, and (number in the vocabulary, frequency) pairs as packed integers."""
    lists = term_lists(texts)
    flat = lists.flatten()
    many = lists.value_lengths().to_numpy().astype(np.int64)
    code = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy()
    doc = np.repeat(np.arange(len(texts)), many)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    many -= np.bincount(doc[empty], minlength=len(texts))
    known = code >= 0
    size = max(1, len(vocabulary))
    pair, frequency = np.unique(doc[known] * size + code[known], return_counts=True)
    ends = np.searchsorted(pair, np.arange(len(texts) + 1) * size)
    values = np.empty(2 * len(pair), "<u4")
    values[::2], values[1::2] = pair % size, frequency
    return many, binary_array(values.tobytes(), ends * 8)


def bag_table(docs: DataFrame, vocabulary: list[str], text: str) -> DataFrame:
    """(key, n, bag) of every document."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(vocabulary)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("key")
    rows = docs.select(key, whole(text).alias("body"))

    def restricted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(terms.value, pa.string())
        for batch in batches:
            done = 0
            for part in slices(batch.column("body")):
                n, bag = bags(part, value_set)
                keys = batch.column("key").slice(done, len(part))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n), bag], ["key", "n", "bag"])
                done += len(part)

    return rows.mapInArrow(restricted, "key long, n long, bag binary")


def document_frequencies(table: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs; one row per term reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            values, _ = packed_ids(batch.column("bag"))
            total += np.bincount(values[::2], minlength=size)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "df"])

    found = table.select("bag").mapInArrow(counted, "code long, df long")
    out = np.zeros(size, np.int64)
    for row in found.groupBy("code").agg(F.sum("df").alias("df")).collect():
        out[row["code"]] = row["df"]
    return out


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Rare terms weigh more; terms that no document holds are never asked for."""
    return np.floor(1000.0 * np.log((2.0 * documents + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def bag_classes(table: DataFrame, documents: int, terms: int, top: int) -> DataFrame:
    """(m, bag, keys): documents alike in bag and norm, with their ``top`` smallest ids."""
    norm = F.expr(f"100 - 25 + ((25 * n * {documents}L) div {max(1, terms)}L)")
    rows = table.filter(F.octet_length("bag") > 0).select("key", "bag", norm.alias("m"))
    # The hash leads; the rows of one hash are told apart by norm and bag themselves.
    same = ["hash", "m", "bag"]
    rows = rows.withColumn("hash", F.xxhash64("bag", "m"))
    place = F.row_number().over(Window.partitionBy(*same).orderBy("key"))
    first = rows.withColumn("place", place).filter(F.col("place") <= top)
    grouped = first.groupBy(*same).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return grouped.select("m", "bag", "keys")


class Best:
    """The best classes of one item so far, by (score, smallest id)."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.keys: list = []
        self.floor = 0

    def offer(self, score: np.ndarray, first: np.ndarray, keys: list) -> None:
        at = np.flatnonzero((score > 0) & (score >= self.floor))
        if not len(at):
            return
        if len(at) > self.top:
            at = at[np.lexsort((first[at], -score[at]))[: self.top]]
        scores, firsts = np.concatenate([self.score, score[at]]), np.concatenate([self.key, first[at]])
        members = self.keys + [keys[i] for i in at]
        order = np.lexsort((firsts, -scores))[: self.top]
        self.score, self.key, self.keys = scores[order], firsts[order], [members[i] for i in order]
        if len(order) == self.top:
            self.floor = int(self.score[-1])


def saturation(frequency: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * frequency) // (1000 * frequency + 12 * m)


def best_classes(classes: DataFrame, items: list[tuple], size: int, top: int) -> DataFrame:
    """(item, score, keys): the ``top`` classes per item of every task.

    ``items``: (number, term numbers, weights times their repeats) each.
    """
    asked = classes.sparkSession.sparkContext.broadcast(items)
    block = max(16, min(1024, CELLS // max(1, size)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in asked.value]
        cells = np.zeros((size, block), np.int64)
        for batch in batches:
            for low in range(0, len(batch), block):
                part = batch.slice(low, block)
                values, ends = packed_ids(part.column("bag"))
                code, frequency = values[::2].astype(np.int64), values[1::2].astype(np.int64)
                of = np.repeat(np.arange(len(part)), np.diff(ends) // 2)
                m = part.column("m").to_numpy().astype(np.int64)
                cells[code, of] = saturation(frequency, m[of])
                keys = part.column("keys").to_pylist()
                first = np.array([k[0] for k in keys], np.int64)
                for (_, terms, weights), found in zip(asked.value, best):
                    found.offer(weights @ cells[terms, : len(part)], first, keys)
                cells[code, of] = 0
        rows = [
            (number, int(score), keys)
            for (number, _, _), found in zip(asked.value, best)
            for score, keys in zip(found.score, found.keys)
        ]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "score", "keys"])

    return classes.mapInArrow(scored, "item long, score long, keys array<long>")


def _first(df: DataFrame, second: str, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc(second)))
    return df.withColumn("rank", place).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, asked: list[tuple[int, list[str]]], params: SearchParams, folder: str, text: str):
    """(item, rank, key, score) of a bounded list of (number, terms)."""
    vocabulary = sorted({term for _, terms in asked for term in terms})
    number = {term: i for i, term in enumerate(vocabulary)}
    table = written(bag_table(docs, vocabulary, text), f"{folder}/bags")
    totals = table.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = totals["documents"] or 0, totals["terms"] or 0
    weights = term_weights(document_frequencies(table, len(vocabulary)), documents)
    items = []
    for item, held in asked:
        counts = Counter(number[t] for t in held)
        codes = np.array(sorted(counts), np.int64)
        repeats = np.array([counts[c] for c in codes.tolist()], np.int64)
        items.append((item, codes, weights[codes] * repeats))
    classes = written(bag_classes(table, documents, terms, params.top), f"{folder}/classes")
    best = best_classes(classes, items, len(vocabulary), params.top)
    first_key = best.withColumn("first_key", F.element_at("keys", 1))
    best = _first(first_key, "first_key", params.top).select("item", "score", F.explode("keys").alias("key"))
    return _first(best, "key", params.top).select("item", "rank", "key", "score")


def search(
    docs: DataFrame, items: DataFrame, params: SearchParams | None = None, text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of every row of ``items``.

    ``items`` has (item_id, text). Only scores above zero are listed.
    """
    params = params or SearchParams()
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark)

    @F.arrow_udf("array<string>")
    def terms_of(texts: pa.Array) -> pa.Array:
        return term_lists(texts)

    listed = items.select("item_id", terms_of(whole("text")).alias("terms"))
    listed = listed.withColumn("terms", F.array_remove("terms", ""))
    listed = written(listed.withColumn("item", F.monotonically_increasing_id()), f"{folder}/items")
    total = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-total // params.block_terms))
    found = None
    for number in range(passes):  # each with a part of the items that fits the tasks
        part = listed.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == number).filter("size(terms) > 0")
        asked = [(row["item"], row["terms"]) for row in part.select("item", "terms").collect()]
        if asked:
            rows = search_block(docs, asked, params, f"{folder}/pass-{number}", text)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "item long, rank int, key long, score long")
    doc_id = F.when(F.col("key") < LAST_ID, F.col("key")).alias("doc_id")
    return found.join(listed.select("item", "item_id"), "item").select("item_id", "rank", doc_id, "score")
