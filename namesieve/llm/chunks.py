"""Ids of texts from the ids of their chunks.

Tokenizers of words encode a chunk alike wherever it stands, and chunks repeat.
A batch of texts is cut into chunks as Arrow arrays, each distinct chunk of the
batch is looked up once, and the ids of the texts are gathered from those of
the chunks, without a Python object per word. What a worker remembers from one
batch to the next is bounded: chunks used lately stay, older ones go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and chunks, taken up at once.
BATCH_BYTES, BATCH_CHUNKS = 2_000_000, 400_000


class Recall:
    """Packed ids of chunks, remembered in two generations.

    A hit moves a chunk to the young generation; when that is full it becomes
    the old one and the old one is dropped. Chunks of more than ``longest``
    characters are not kept. ``learn`` gives the packed ids of new chunks.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], entries: int = 100_000, longest: int = 64):
        self.learn, self.entries, self.longest = learn, entries, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def seen(self, chunk: str) -> bytes | None:
        ids = self.young.get(chunk)
        return self.old.get(chunk) if ids is None else ids

    def packed(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of distinct chunks."""
        out = list(map(self.young.get, chunks))
        fresh = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = self.old.get(chunks[i])
            if out[i] is None:
                fresh.append(i)
            else:
                self.young[chunks[i]] = out[i]
        for i, ids in zip(fresh, self.learn([chunks[i] for i in fresh])):
            out[i] = ids
            if len(chunks[i]) <= self.longest:
                self.young[chunks[i]] = ids
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young
        return out


#: A letter or digit of Latin script, and an ASCII punctuation mark after it.
#: Not the dotted capital I, which becomes a letter and a mark in lower case.
MARK_AFTER = r"([0-9A-Za-zÀ-ÖØ-öø-įı-ſ])([!-/:-@\[-`{-~])"


def before_marks(texts: pa.Array, cut: str) -> pa.Array:
    """``texts`` with ``cut`` before every mark that follows a letter or digit."""
    return pc.replace_substring_regex(texts, pattern=MARK_AFTER, replacement=f"\\1{cut}\\2")


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of about BATCH_BYTES, at least one text each."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            yield texts.slice(low, high - low)


def binary_array(data: bytes | pa.Buffer, ends: np.ndarray) -> pa.Array:
    """Values that lie one after another in ``data``; ``ends`` begins with 0."""
    offsets = pa.py_buffer(np.ascontiguousarray(ends, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(data)])


def encode_chunks(chunks: pa.Array, recall: Recall) -> pa.Array:
    """Packed ids of each list of chunks."""
    flat = chunks.flatten()
    bounds = chunks.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    data, ends, done = [], [np.zeros(1, np.int64)], 0
    for low in range(0, len(flat), BATCH_CHUNKS):
        coded = flat.slice(low, BATCH_CHUNKS).dictionary_encode()
        packed = recall.packed(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(packed), "<u4")
        length = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(length) - length
        at = coded.indices.to_numpy()
        taken = length[at]
        stop = np.cumsum(taken)
        total = int(stop[-1])
        data.append(ids[np.arange(total) + np.repeat(start[at] - (stop - taken), taken)].tobytes())
        ends.append(stop + done)
        done += total
    return binary_array(b"".join(data), np.concatenate(ends)[bounds] * 4)


def packed_ids(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, ends per value in ids) of an array of packed ids."""
    array = array.cast(pa.binary())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1] // 4
    ids = np.frombuffer(data, "<u4") if data is not None and data.size else np.zeros(0, "<u4")
    return ids[ends[0] : ends[-1]], ends - ends[0]
