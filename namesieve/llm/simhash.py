"""Near-duplicates by SimHash, found with vantage-point trees over the fingerprints.

Fingerprints: a text's words form shingles; each bit of the fingerprint is set
if it is set in over half of the shingles' hashes. Documents link when their
fingerprints differ in at most ``radius`` bits.

Search: equal fingerprints collapse first, so copies are one row. A pair that
differs in at most 3 bits differs in at most 1 bit in one of its two 32-bit
halves; so each half gets a vantage-point tree of its own and a search radius
of ``radius // 2`` there. A tree node holds a vantage half and the median
Hamming distance to it: nearer halves go left, others right. A fingerprint
lives in the shard of the leaf it falls to; by the triangle inequality all its
partners live in leaves whose branches its ball reaches, and it visits those
shards as well. Within a shard the residents are compared with residents and
visitors on all 64 bits, again skipping those whose distances to a vantage
differ by more than the radius. So every pair is found exactly, whatever the
vantages; these come from a bounded sample and decide only the balance.

Data flow: texts are read once; 20 bytes per document go on. The trees have at
most 2^``depth`` leaves each, a fixed bound for what is broadcast. A shard
emits no pairs, but ties each of its members to the smallest member it is
linked to, directly or not, within the shard: at most one edge per row. A leaf
whose sample says that it holds more than ``block`` rows is cut into blocks by hash, and
every block of residents meets every block of visitors in a task group of its
own, so a large cloud of near copies is spread and stays exact; its work is
the product of its distinct fingerprints, never of its documents.

Nulls and odd rows: a null text is the empty text; texts without words have
fingerprint zero and link like any other. Null ids are ignored in the smallest
id of a component unless it holds no other. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.llm.common import bounded_batches, first_by_hash, located, whole
from namesieve.llm.components import components
from namesieve.workspace import work_folder, written


@dataclass(frozen=True)
class SimHashParams:
    """``words`` per shingle; ``seed`` of the hash. A shard aims at ``leaf``
    residents, up to 2^``depth`` shards; ``per_leaf`` sampled rows shape a leaf."""

    words: int = 3
    seed: int = 42
    radius: int = 3
    leaf: int = 4096
    depth: int = 18
    per_leaf: int = 16
    block: int = 4096


def text_fingerprint(text: bytes, words: int, seed: int) -> int:
    """The fingerprint of one UTF-8 text."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)], np.uint64)
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        windows = zip(*(parts[i:] for i in range(words)))
        hashes = np.array([digest(join(w), seed) for w in windows], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: Column, params: SimHashParams | None = None) -> Column:
    """The fingerprint of a text column as a 64-bit integer (two's complement)."""
    params = params or SimHashParams()
    words, seed = params.words, params.seed

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        values = [text_fingerprint(t.as_py(), words, seed) for t in raw]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    return fingerprints(whole(text))


def hex_fingerprint(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@dataclass(frozen=True)
class Tree:
    """A complete vantage-point tree over 32-bit halves; node i has children 2i and 2i + 1.

    ``blocks`` holds, per leaf, in how many blocks its residents are cut.
    """

    depth: int
    vantage: np.ndarray
    border: np.ndarray
    blocks: np.ndarray


def _halves(fingerprints: np.ndarray, tree: int) -> np.ndarray:
    shift = np.uint64(32 * tree)
    return ((fingerprints >> shift) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def build_tree(sample: np.ndarray, depth: int, total: int, block: int, seed: int) -> Tree:
    """A tree over sampled halves of ``total`` fingerprints; the sample decides the balance only."""
    rng = np.random.default_rng(seed)
    vantage = np.zeros(1 << depth, np.uint32)
    border = np.zeros(1 << depth, np.int16)
    node = np.ones(len(sample), np.int64)
    for level in range(depth):
        order = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
        for i in range(1 << level):
            members = sample[order[starts[i] : starts[i + 1]]]
            at = (1 << level) + i
            if len(members):
                vantage[at] = members[rng.integers(len(members))]
                border[at] = np.median(np.bitwise_count(members ^ vantage[at]))
            else:
                vantage[at], border[at] = rng.integers(1 << 32), 16
        far = np.bitwise_count(sample ^ vantage[node]).astype(np.int16) > border[node]
        node = 2 * node + far
    share = np.bincount(node - (1 << depth), minlength=1 << depth) / max(1, len(sample))
    return Tree(depth, vantage, border, np.maximum(1, np.ceil(share * total / block)).astype(np.int32))


def route(halves: np.ndarray, tree: Tree, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, resident): every leaf that the ball around a half reaches."""
    row = np.arange(len(halves))
    node = np.ones(len(halves), np.int64)
    resident = np.ones(len(halves), bool)
    for _ in range(tree.depth):
        distance = np.bitwise_count(halves[row] ^ tree.vantage[node]).astype(np.int16)
        border = tree.border[node]
        left, right = distance - radius <= border, distance + radius > border
        near = distance <= border
        row = np.concatenate([row[left], row[right]])
        resident = np.concatenate([(resident & near)[left], (resident & ~near)[right]])
        node = np.concatenate([2 * node[left], 2 * node[right] + 1])
    return row, node - (1 << tree.depth), resident


def _spread(values: np.ndarray) -> np.ndarray:
    """A hash by which a leaf's rows are cut into blocks."""
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)


def shard_rows(fps: np.ndarray, tree_no: int, tree: Tree, radius: int) -> pd.DataFrame:
    """(tree, leaf, home, visit, fp, resident, visitor): the task groups of some fingerprints.

    In a leaf of one block a resident is its own visitor, in one row. In a leaf
    of b blocks a resident goes to the b groups of its block and, as a visitor,
    to the b groups of its other block.
    """
    row, leaf, resident = route(_halves(fps, tree_no), tree, radius // 2)
    blocks = tree.blocks[leaf].astype(np.int64)
    one = blocks == 1
    parts = [(row[one], leaf[one], 0 * leaf[one], 0 * leaf[one], resident[one], np.ones(one.sum(), bool))]
    place = _spread(fps).astype(np.int64)
    for b in np.unique(blocks[~one]):
        for as_resident in (True, False):
            pick = np.flatnonzero((blocks == b) & (resident | (not as_resident)))
            own = np.repeat(place[row[pick]] % b, b)
            other = np.tile(np.arange(b), len(pick))
            home, visit = (own, other) if as_resident else (other, own)
            flag = np.full(len(own), as_resident)
            parts.append((np.repeat(row[pick], b), np.repeat(leaf[pick], b), home, visit, flag, ~flag))
    row, leaf, home, visit, resident, visitor = (np.concatenate(c) for c in zip(*parts))
    return pd.DataFrame({
        "tree": np.full(len(row), tree_no, np.int32), "leaf": leaf.astype(np.int32),
        "home": home.astype(np.int32), "visit": visit.astype(np.int32),
        "fp": fps[row].view(np.int64), "resident": resident, "visitor": visitor,
    })


SHARD = "tree int, leaf int, home int, visit int, fp long, resident boolean, visitor boolean"


def link_shard(residents: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each linked fingerprint with the smallest one it hangs together with here."""
    values, where = np.unique(np.concatenate([residents, others]), return_inverse=True)
    home, rest = np.unique(where[: len(residents)]), np.unique(where)
    root = np.arange(len(values))
    # Sorted by their distance to one vantage, partners lie within the radius of each other.
    distance = np.bitwise_count(values ^ values[0]).astype(np.int64)
    rest = rest[np.argsort(distance[rest], kind="stable")]
    sorted_distance = distance[rest]
    for d in np.unique(distance[home]):
        near = home[distance[home] == d]
        lo, hi = np.searchsorted(sorted_distance, [d - radius, d + radius + 1])
        against = rest[lo:hi]
        step = max(1, (1 << 20) // max(1, len(against)))
        for i in range(0, len(near), step):
            part = near[i : i + step]
            close = np.bitwise_count(values[part][:, None] ^ values[against][None, :]) <= radius
            for k in np.flatnonzero(close.sum(1) > 1):
                roots = np.unique(root[against[close[k]]])
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
    tied = np.flatnonzero(root != np.arange(len(values)))
    return values[tied], values[root[tied]]


def shard_links(groups: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges among fingerprints from the task groups of ``shard_rows``."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().view(np.uint64)
        resident, visitor = rows["resident"].to_numpy(), rows["visitor"].to_numpy()
        a, b = link_shard(fps[resident], fps[visitor], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return groups.groupBy("tree", "leaf", "home", "visit").applyInPandas(link, "a long, b long")


def near_pairs(distinct: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints within the radius of each other.

    ``distinct``: a written table with one row per ``fp``.
    """
    spark, total = distinct.sparkSession, distinct.count()
    depth = min(params.depth, max(0, int(np.ceil(np.log2(max(1, total / params.leaf))))))
    wanted = params.per_leaf << depth
    drawn = first_by_hash(distinct.select("fp"), ["fp"], wanted, total, params.seed)
    sample = drawn.toArrow()["fp"].to_numpy().view(np.uint64)
    trees = spark.sparkContext.broadcast(
        [build_tree(_halves(sample, t), depth, total, params.block, params.seed + t) for t in (0, 1)]
    )
    radius = params.radius

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 4096):
                for t, tree in enumerate(trees.value):
                    yield pa.RecordBatch.from_pandas(
                        shard_rows(fps[i : i + 4096], t, tree, radius), preserve_index=False
                    )

    return shard_links(distinct.select("fp").mapInArrow(spread, SHARD), radius)


def near_groups(
    docs: DataFrame, params: SimHashParams | None = None, text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, fp, component_id) and the columns ``keep``: ``component_id`` is the smallest id reachable."""
    params = params or SimHashParams()
    bounded_batches(docs.sparkSession)
    folder = work_folder(docs.sparkSession)
    marked = docs.select("doc_id", *keep, fingerprint(F.col(text), params).alias("fp"))
    marked = written(marked, f"{folder}/fingerprints")
    per_fp = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), f"{folder}/distinct")
    edges = written(near_pairs(per_fp, params).distinct(), f"{folder}/edges")
    roots = components(edges, f"{folder}/components")
    tied = per_fp.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    tied = written(tied, f"{folder}/tied")
    smallest = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    smallest = written(smallest, f"{folder}/smallest")
    named = written(tied.join(smallest, "root").select("fp", "component_id"), f"{folder}/named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", *keep)


def without_near_copies(
    docs: DataFrame, params: SimHashParams | None = None, in_files: bool = False
) -> DataFrame:
    """One document of each group, the one with the smallest id; columns of ``docs``.

    Rows with a null id stay: they cannot be told apart. Each row that repeats an
    id is judged by its own group, and of a group all rows with its smallest id stay.
    ``in_files``: the table is a plain scan of different files, see ``located``.
    """
    folder = work_folder(docs.sparkSession)
    placed = located(docs, folder, in_files)
    texts = placed.select("caller.doc_id", "caller.text", "path", "row")
    groups = near_groups(texts, params, keep=("path", "row"))
    dropped = groups.filter("doc_id <> component_id").select("path", "row")
    kept = placed.join(written(dropped, f"{folder}/dropped"), ["path", "row"], "left_anti")
    return kept.select("caller.*")
