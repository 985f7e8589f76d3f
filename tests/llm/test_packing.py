"""Packing: every id once, gapless sequences without padding, ids as the library's."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from namesieve.llm import packing
from namesieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, wanted, window):
    """``wanted``: (doc_id, ids) of every row of the table."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    spans = defaultdict(list)
    for r in rows:
        spans[(r.doc_id, r.doc_tokens)].append((r.start, r.length))
    for (doc, total), parts in spans.items():
        copies = sum(1 for d, ids in wanted if d == doc and len(ids) == total)
        assert Counter(i for s, n in parts for i in range(s, s + n)) == dict.fromkeys(range(total), copies)
    assert {(d, len(ids)) for d, ids in wanted} == set(spans)
    return sequences


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {d.doc_id: ids_of(library, d.text) for d in docs}
    rows = QUERIES["op13_packing"](spark, SF).collect()
    sequences = check(rows, list(ids.items()), 4096)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    total = sum(map(len, ids.values()))
    assert sum(sum(n for _, n in s) == 4096 for s in sequences.values()) == total // 4096


@pytest.mark.parametrize("window, pool", [(4096, 1024), (8, 3), (64, 5)])
def test_odd_rows(spark, odd_docs, no_docs, library, window, pool):
    params = packing.PackParams(window=window, pool=pool)
    wanted = [(r.doc_id, ids_of(library, r.text)) for r in odd_docs.collect()]
    check(packing.pack(odd_docs.coalesce(1), PATH, params).collect(), wanted, window)
    assert packing.pack(no_docs, PATH, params).count() == 0
    text_ids = odd_docs.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert packing.pack(text_ids, PATH).schema["doc_id"].dataType.simpleString() == "string"


def test_ids_equal_the_library(library):
    rng = random.Random(3)
    letters = " aeiouAEIOUxyzÉéßñİǰ日🎉\n\t ́̌ẞ\x1c\x1f  ſ'!12.,<|>JK"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(800)]
    texts += ["don't  stop", "<|endoftext|>", "'sale", "J̌", "ΣΑΣ ", "İ!", "Ḱ", "a" * 4000, ""]
    encoder = packing.TextIds(open(PATH).read())
    assert encoder.by_word
    for by_word in (True, False):
        encoder.by_word = by_word
        for text, ids in zip(texts, encoder.encode(pa.array(texts)).to_pylist()):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_best_fill_is_the_closest_sum(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 4) for n in rng.sample(range(3, 40), 5)}
    capacity = rng.randint(5, 120)
    sums = {0}
    for n, many in counts.items():
        sums = {s + k * n for s in sums for k in range(many + 1) if s + k * n <= capacity}
    chosen = packing.best_fill(counts, capacity)
    assert all(0 < k <= counts[n] for n, k in chosen.items())
    assert sum(n * k for n, k in chosen.items()) == max(sums)


def test_rests_are_packed_whole_where_they_fit():
    """Cuts only where no multiset of rests fills a window."""
    packer = packing.Packer(packing.PackParams(window=10, pool=100), 0)
    for doc, n in enumerate([7, 6, 4, 3, 5, 5]):
        packer.add(doc, bytes(4 * n))
    packer.finish()
    assert sorted((r[0], r[2]) for r in packer.rows) == [(0, 7), (1, 6), (2, 4), (3, 3), (4, 5), (5, 5)]
    assert packer.sequence == 3
