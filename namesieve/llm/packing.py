"""Pack token ids of documents into windows of fixed length by minimum bin slack.

A document's ids, with an end id after them, are cut into whole windows and a
rest shorter than one. Rests wait in a pool, counted by length. To fill a window
the longest rest goes in, and a subset-sum program over the other lengths finds
the multiset that comes nearest to the capacity: bit s of an integer says that
the sum s can be reached, a length held n times enters as 1, 2, 4, ... pieces,
and the program stops at the first exact fill. The integers before each item
give the counts back. Where no multiset fills the window, the shortest rest
that is too long is cut to its slack, so a window is always full. What is left
when a task ends is less than a window; it is cut into sequences whose lengths
are powers of two. No sequence needs padding.

Data flow: each task reads its part of the table, tokenises and packs it as a
stream: no shuffle, nothing reaches the driver, and a lost task is done again
alone. A pool holds at most ``pool`` rests, or less than a window. Sequences are numbered by
task, so a table of many small parts has a few short sequences for each part.

Tokenising: for tokenizers that split at white space (``splits_at_space``) each
distinct word of a batch is looked up once (``chunks``); a new word is
normalised, split and encoded by the library. Other tokenizers get whole texts.
Strings of special tokens in a text are ordinary text.

Nulls and odd rows: a null or empty text has no ids but the end id. A document
of any length is cut into windows. Repeated rows are packed one by one, ids of
documents may be null or of any type. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from namesieve.llm.chunks import Recall, before_marks, encode_chunks, packed_ids, slices
from namesieve.llm.common import bounded_batches, whole

#: Pre-tokenizer pattern of word tokenizers in lower case, for words of ASCII.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
#: Words that a worker remembers in each of two generations.
MEMORY = 150_000
#: From here on characters may combine with those before them.
COMBINING = "[^\\x00-\\x{2ff}]"


@dataclass(frozen=True)
class PackParams:
    """Ids per window, the id after each document, and how many rests wait at most."""

    window: int = 4096
    end_id: int = 2
    pool: int = 1024


def splits_at_space(config: dict) -> bool:
    """True for tokenizers in lower case whose words end at white space and never join across it."""
    steps = [s.get("type") for s in (config.get("normalizer") or {}).get("normalizers", [])]
    splits = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": WORD_PATTERN}
        and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and not splits[1]["add_prefix_space"]
    )


class TextIds:
    """Ids of texts in one Python worker."""

    def __init__(self, content: str):
        self.library = Tokenizer.from_str(content)
        self.library.encode_special_tokens = True
        self.by_word = splits_at_space(json.loads(content))
        self.tokenize, self.words = self.library.model.tokenize, Recall(self._words, MEMORY)
        if self.by_word:  # how the pre-tokenizer writes the bytes of other than ASCII characters
            letters = "".join(map(chr, range(0xA0, 0x180)))
            written = self.library.pre_tokenizer[1].pre_tokenize_str(letters)[0][0]
            self.as_characters = dict(zip(letters.encode(), map(ord, written)))

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        out = []
        for word in words:
            if word.isascii() and word.isprintable():
                small = word.lower()
                out.append(self._piece(small) if word.isalpha() else self._join(ASCII_PIECES(small)))
            elif word.isalpha() and max(word) < "\u0130":
                # Letters that normalising leaves alone: one piece, its bytes as characters.
                out.append(self._piece(word.lower().encode().decode("latin-1").translate(self.as_characters)))
            else:
                clean = self.library.normalizer.normalize_str(word)
                out.append(self._join([p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]))
        return out

    def _join(self, pieces: list[str]) -> bytes:
        return b"".join(map(self._piece, pieces))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text of a bounded array."""
        if not self.by_word:
            found = self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return pa.array([np.array(e.ids, "<u4").tobytes() for e in found], pa.binary())
        # Capitals may become small before normalising where nothing can combine with them.
        plain = pc.invert(pc.match_substring_regex(texts, pattern=COMBINING))
        texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
        # White space is dropped, so it may be put wherever a piece starts anyway.
        return encode_chunks(pc.ascii_split_whitespace(before_marks(texts, " ")), self.words)


@lru_cache(maxsize=2)
def _text_ids(content: str) -> TextIds:
    return TextIds(content)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes nearest to ``capacity`` from below."""
    reached, items = 1, []
    full = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not reached >> capacity:
            take = min(take, left)
            items.append((length, take, reached))
            reached |= reached << (length * take) & full
            left -= take
            take *= 2
        if reached >> capacity:
            break
    total = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(items):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


@dataclass
class Rest:
    """Ids of a document from ``start`` on that wait for a place."""

    doc: object
    start: int
    ids: bytes
    doc_tokens: int


class Packer:
    """Windows of one task; ``rows`` collects their pieces."""

    def __init__(self, params: PackParams, first_sequence: int):
        self.params, self.sequence = params, first_sequence
        self.pool: dict[int, deque[Rest]] = {}
        self.waiting, self.tokens = 0, 0  # rests, and their ids
        self.rows: list[tuple] = []
        self.row_bytes = 0

    def _place(self, rest: Rest, length: int, offset: int) -> Rest | None:
        """Put the first ``length`` ids of a rest into the open sequence; what is left of it."""
        ids = rest.ids[: 4 * length]
        self.rows.append((rest.doc, rest.start, length, ids, rest.doc_tokens, self.sequence, offset))
        self.row_bytes += len(ids) + 64
        if len(ids) == len(rest.ids):
            return None
        return Rest(rest.doc, rest.start + length, rest.ids[4 * length :], rest.doc_tokens)

    def _wait(self, rest: Rest) -> None:
        length = len(rest.ids) // 4
        self.pool.setdefault(length, deque()).append(rest)
        self.waiting += 1
        self.tokens += length

    def _next(self, length: int) -> Rest:
        queue = self.pool[length]
        rest = queue.popleft()
        if not queue:
            del self.pool[length]
        self.waiting -= 1
        self.tokens -= length
        return rest

    def add(self, doc: object, ids: bytes) -> None:
        """Whole windows of a document go out, its rest waits."""
        window, total = self.params.window, len(ids) // 4
        for start in range(0, total - window + 1, window):
            part = Rest(doc, start, ids[4 * start : 4 * (start + window)], total)
            self._place(part, window, 0)
            self.sequence += 1
        if total % window:
            start = total - total % window
            self._wait(Rest(doc, start, ids[4 * start :], total))
        while self.waiting > self.params.pool and self.tokens >= window:
            self._fill()

    def _fill(self) -> None:
        """One full window."""
        window = self.params.window
        longest = max(self.pool)
        self._place(self._next(longest), longest, 0)
        offset = longest
        counts = {length: len(rests) for length, rests in self.pool.items() if length <= window - longest}
        for length, take in best_fill(counts, window - longest).items():
            for _ in range(take):
                self._place(self._next(length), length, offset)
                offset += length
        while offset < window:
            length = min((n for n in self.pool if n > window - offset), default=max(self.pool, default=0))
            rest = self._next(length)
            placed = min(length, window - offset)
            left = self._place(rest, placed, offset)
            offset += placed
            if left is not None:
                self._wait(left)
        self.sequence += 1

    def finish(self) -> None:
        """Full windows while there is enough, then sequences of 2^k ids."""
        window = self.params.window
        while self.tokens >= window:
            self._fill()
        left = self.tokens
        rests = deque(r for length in sorted(self.pool, reverse=True) for r in self.pool[length])
        self.pool, self.waiting, self.tokens = {}, 0, 0
        while left:
            size, offset = 1 << (left.bit_length() - 1), 0
            while offset < size:
                rest = rests.popleft()
                placed = min(len(rest.ids) // 4, size - offset)
                more = self._place(rest, placed, offset)
                offset += placed
                if more is not None:
                    rests.appendleft(more)
            left -= size
            self.sequence += 1

    def taken(self) -> list[tuple]:
        rows, self.rows, self.row_bytes = self.rows, [], 0
        return rows


#: Bytes of pieces sent back at once, and sequences that a task may number.
OUTPUT_BYTES, PER_TASK = 4_000_000, 1 << 33


def pack(docs: DataFrame, tokenizer_path: str, params: PackParams | None = None, text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row per piece.

    ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts the ids
    of the document before the piece, ``offset`` those of the sequence.
    """
    params = params or PackParams()
    bounded_batches(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    rows = docs.select("doc_id", whole(text).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
    )
    end = np.array([params.end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _text_ids(content.value)
        packer = Packer(params, TaskContext.get().partitionId() * PER_TASK)
        doc_type = None

        def output() -> pa.RecordBatch:
            columns = list(zip(*packer.taken()))
            kinds = [doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            ids_of, done = batch.column("doc_id"), 0
            doc_type = ids_of.type
            for part in slices(batch.column("body")):
                found, ends = packed_ids(texts.encode(part))
                data, at = found.tobytes(), (ends * 4).tolist()
                for doc, low, high in zip(ids_of.slice(done, len(part)).to_pylist(), at, at[1:]):
                    packer.add(doc, data[low:high] + end)
                    if packer.row_bytes > OUTPUT_BYTES:
                        yield output()
                done += len(part)
        packer.finish()
        if packer.rows:
            yield output()

    return rows.mapInArrow(packed, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
