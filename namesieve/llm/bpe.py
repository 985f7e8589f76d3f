"""Byte-level BPE encoding and decoding by a published table of ranks.

A text is cut into pieces by the tokenizer's pattern; each piece is encoded
separately. A segment tree over a piece's byte positions holds, at each
position where a part starts, the rank of joining that part with the next, and
in every inner node the smallest rank below it with its leftmost position. The
root names the next merge; a merge changes three leaves (the joined part, the
one before it, the one swallowed), each by a walk to the root. A piece of n
bytes takes O(n log n), so a text without any break does no harm.

Words repeat, so a batch looks up each of its distinct words once, and a Python
worker remembers words up to a bound, those used lately (``chunks``). Documents are encoded where they are read, without a
shuffle. Ids travel as little-endian unsigned 32-bit integers in one binary
value per text; ``decode`` turns them back into bytes. The ranks come from a
file named by a parameter and are broadcast (a fixed table of some 50,000
entries).

Nulls and odd rows: a null or empty text has no ids. Repeated rows are encoded
alike. Special tokens are ordinary text. Unknown ids in ``decode`` raise.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.llm.chunks import Recall, before_marks, binary_array, encode_chunks, packed_ids, slices
from namesieve.llm.common import bounded_batches, whole

#: Chunks that a worker remembers in each of two generations.
MEMORY = 100_000
#: Longer pieces are encoded one by one, and longer chunks forgotten after their batch.
LONG = 64
#: Pieces encoded side by side.
SIDE_BY_SIDE = 8192
NONE = 1 << 62


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """One ``base64 rank`` pair per line."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Merges:
    """The rank of joining two tokens, looked up for many pairs at once.

    Pairs lie in a table with open addressing: a pair is at the slot of its hash
    or, if that is taken, in the slots after it up to the first empty one.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.base = max(ranks.values()) + 1
        find, found = ranks.get, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = find(token[:cut]), find(token[cut:])
                if left is not None and right is not None:
                    found[left * self.base + right] = rank
        bits = (4 * len(found)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.zeros(1 << bits, dtype=np.int64)
        slots = self._slots(np.fromiter(found, np.int64, len(found))).tolist()
        for (key, rank), slot in zip(found.items(), slots):
            while self.keys[slot] != -1:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """``none`` where the two do not join."""
        keys = left.astype(np.int64) * self.base + right
        at = self._slots(keys)
        there = self.keys.take(at)
        out = np.where(there == keys, self.ranks.take(at), none)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys.take(at[open_])
            hit = open_[there == keys[open_]]
            out[hit] = self.ranks.take(at[hit])
            open_ = open_[(there != keys[open_]) & (there != -1)]
        return out


def encode_side_by_side(pieces: list[bytes], merges: Merges, width: int) -> list[bytes]:
    """Packed ids of pieces of at most ``width`` bytes, a power of two.

    Every piece has a segment tree of 2 * ``width`` nodes in ``tree``: leaf
    ``width + i`` holds rank * width + i for the part that starts at byte i and
    its successor, an inner node the smaller of its two children, so that the
    root is the leftmost pair of lowest rank. Each round merges one pair of
    every piece that has one.
    """
    kind = np.int32 if merges.base * width < 1 << 31 else np.int64
    none, bits = np.iinfo(kind).max, width.bit_length() - 1
    n = np.array([len(p) for p in pieces])
    many, places = len(pieces), np.arange(width)
    inside = places < n[:, None]
    ids = np.zeros((many, width), dtype=kind)
    ids[inside] = merges.single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile((places + 1).astype(kind), many)
    before = np.tile((places - 1).astype(kind), many)
    paired = inside[:, 1:]
    tree = np.full((many, 2 * width), none, dtype=kind)
    rank = merges.rank(ids[:, :-1][paired], ids[:, 1:][paired], none)
    value = np.where(rank < none, rank * width + np.nonzero(paired)[1], none)
    tree[:, width:-1][paired] = value
    low = width
    while low > 1:
        tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
        low //= 2
    rows = np.flatnonzero(tree[:, 1] < none)
    ids, tree = ids.ravel(), tree.ravel()
    while len(rows):
        flat, top = rows * width, rows * (2 * width)
        root = tree.take(top + 1)
        here, joined = root & (width - 1), root >> bits
        gone = after.take(flat + here)
        stop = after.take(flat + gone)
        ids[flat + here] = joined
        after[flat + here] = stop
        more, less = np.flatnonzero(stop < n.take(rows)), np.flatnonzero(here)
        before[flat[more] + stop[more]] = here[more]
        value = np.full(len(rows), none, dtype=kind)
        rank = merges.rank(joined[more], ids.take(flat[more] + stop[more]), none)
        value[more] = np.where(rank < none, rank * width + here[more], none)
        previous = before.take(flat[less] + here[less])
        rank = merges.rank(ids.take(flat[less] + previous), joined[less], none)
        # Point updates: the swallowed part, the joined part, the part before it.
        tree[top + (width + gone)] = none
        tree[top + (width + here)] = value
        tree[top[less] + (width + previous)] = np.where(rank < none, rank * width + previous, none)
        node = np.concatenate([gone, here, previous]) + width
        top = np.concatenate([top, top, top[less]])
        for _ in range(bits):
            node >>= 1
            child = top + 2 * node
            tree[top + node] = np.minimum(tree.take(child), tree.take(child + 1))
        rows = rows[tree.take(rows * (2 * width) + 1) < none]
    # Parts that are left: their starts, walked by ``after`` from 0.
    starts = np.zeros(many * width, dtype=bool)
    rows, at = np.arange(many), np.zeros(many, dtype=np.int64)
    while len(rows):
        starts[rows * width + at] = True
        at = after.take(rows * width + at)
        go = at < n.take(rows)
        rows, at = rows[go], at[go]
    flat = ids[starts].astype("<u4").tobytes()
    ends = (np.cumsum(starts.reshape(many, width).sum(1)) * 4).tolist()
    return [flat[i:j] for i, j in zip([0, *ends], ends)]


def encode_long(piece: bytes, ranks: dict[bytes, int]) -> bytes:
    """Packed ids of one long piece: the same tree for a single row, in plain lists."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    end = list(range(1, n + 1))  # of the part that starts at a position
    start_before = list(range(-1, n - 1))  # start of the part before it
    find = ranks.get
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while tree[1] != NONE:
        here = tree[1] % width
        gone = end[here]
        stop = end[here] = end[gone]
        rank = None
        if stop < n:
            start_before[stop] = here
            rank = find(piece[here : end[stop]])
        changes = [(gone, NONE), (here, NONE if rank is None else rank * width + here)]
        if here:
            before = start_before[here]
            rank = find(piece[before:stop])
            changes.append((before, NONE if rank is None else rank * width + before))
        for position, value in changes:
            i = width + position
            if tree[i] == value:
                continue
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return np.array(ids, "<u4").tobytes()


#: Marks of texts that are not plain: white space other than single spaces and
#: line feeds between other characters, and the mark that cuts plain texts.
CUT = "\0"
RARE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
NOT_PLAIN = rf"\A[ \n]|[ \n]\z|  | \n|\n |\n\n|[{RARE}{CUT}]"


class Encoder:
    """Encodes texts in one Python worker; remembers chunks from batch to batch.

    The pattern takes a single space between two other characters as the first
    character of the next piece, and a single line feed there as a piece of its
    own, whatever surrounds them; a mark after a letter or digit always starts a
    piece. So a plain text may be cut before each space, around each line feed
    and before such marks, and a word is encoded alike wherever it stands. Any
    other text is cut by the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.merges = Merges(ranks)
        self.recall = Recall(self.learn, MEMORY, LONG)

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks, each a run of whole pieces."""
        out: list[bytes | None] = []
        single, mixed = [], []  # letters, with or without a space before them, are one piece
        for i, chunk in enumerate(chunks):
            word = chunk[1:] if chunk[:1] == " " else chunk
            if word.isalpha():
                raw = chunk.encode()
                rank = self.ranks.get(raw)
                out.append(None if rank is None else pack("<I", rank))
                if rank is None:
                    single.append((i, raw))
            else:
                out.append(None)
                mixed.append((i, self.pieces(chunk)))
        for i, ids in zip([i for i, _ in single], self.merged([raw for _, raw in single])):
            out[i] = ids
        known = self.learn_pieces({p for _, pieces in mixed for p in pieces})
        for i, pieces in mixed:
            out[i] = b"".join([known[p] for p in pieces])
        return out

    def learn_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of single pieces."""
        known: dict[str, bytes] = {}
        unknown = []
        for piece in pieces:
            rank = self.ranks.get(piece.encode())
            ids = self.recall.seen(piece) if rank is None else pack("<I", rank)
            if ids is None:
                unknown.append(piece)
            else:
                known[piece] = ids
        known.update(zip(unknown, self.merged([p.encode() for p in unknown])))
        return known

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids by merging; pieces of like length side by side."""
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > LONG:
                out[i] = encode_long(piece, self.ranks)
            else:
                by_width.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, group in by_width.items():
            for low in range(0, len(group), SIDE_BY_SIDE):
                part = group[low : low + SIDE_BY_SIDE]
                packed = encode_side_by_side([pieces[i] for i in part], self.merges, width)
                for i, ids in zip(part, packed):
                    out[i] = ids
        return out

    def _some(self, texts: pa.Array) -> pa.Array:
        odd = pc.match_substring_regex(texts, pattern=NOT_PLAIN)
        marked = pc.replace_substring(texts.filter(pc.invert(odd)), pattern=" ", replacement=CUT + " ")
        marked = pc.replace_substring(marked, pattern="\n", replacement=f"{CUT}\n{CUT}")
        marked = before_marks(marked, CUT)
        plain = encode_chunks(pc.split_pattern(marked, CUT), self.recall)
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(odd_at):
            return plain
        pieces = [self.pieces(t) for t in texts.filter(odd).to_pylist()]
        other = encode_chunks(pa.array(pieces, pa.list_(pa.string())), self.recall)
        order = np.concatenate([np.setdiff1d(np.arange(len(texts)), odd_at), odd_at])
        return pa.concat_arrays([plain, other]).take(pa.array(np.argsort(order)))

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text."""
        parts = [self._some(part) for part in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


@lru_cache(maxsize=2)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(parse_ranks(content), pattern)


@lru_cache(maxsize=2)
def _tokens(content: bytes) -> pa.Array:
    ranks = parse_ranks(content)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.binary())


def decode_array(packed: pa.Array, tokens: pa.Array) -> pa.Array:
    """The bytes of packed ids: tokens one after another are the texts one after another."""
    ids, ends = packed_ids(packed)
    found = tokens.take(pa.array(ids))
    if found.null_count:
        raise ValueError("an id stands for no token")
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1]
    return binary_array(data if data is not None else b"", at[ends] if len(ids) else ends)


class Tokenizer:
    """Column functions of one table of ranks."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        self.content = spark.sparkContext.broadcast(Path(ranks_path).read_bytes())
        self.pattern = pattern

    def encode(self, text: Column) -> Column:
        """Packed ids of a text column."""
        content, pattern = self.content, self.pattern

        @F.arrow_udf("binary")
        def text_ids(texts: pa.Array) -> pa.Array:
            return _encoder(content.value, pattern).encode_array(texts)

        return text_ids(whole(text))

    def decode(self, ids: Column) -> Column:
        """Bytes of packed ids."""
        content = self.content

        @F.arrow_udf("binary")
        def text_bytes(packed: pa.Array) -> pa.Array:
            tokens = _tokens(content.value)
            ends = [decode_array(packed.slice(i, 256), tokens) for i in range(0, len(packed), 256)]
            return pa.concat_arrays(ends) if ends else pa.array([], pa.binary())

        return text_bytes(ids)


def encode_documents(
    docs: DataFrame, tokenizer: Tokenizer, text: str = "text"
) -> DataFrame:
    """(doc_id, ids, decoded): packed ids of every text, and the bytes they decode to."""
    bounded_batches(docs.sparkSession)
    encoded = docs.select("doc_id", tokenizer.encode(F.col(text)).alias("ids"))
    return encoded.select("doc_id", "ids", tokenizer.decode(F.col("ids")).alias("decoded"))
