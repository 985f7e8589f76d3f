"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from namesieve.llm import ranked_search
from namesieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(SMALL))


def brute_force(docs, items, top=20):
    """``docs`` and ``items``: (id, text)."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    documents, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        scored = []
        for (doc, counts), n in zip(held, sizes):
            score = 0
            for term in terms_of(text):
                if counts[term]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[term] + 1)))
                    m = 100 - 25 + (25 * n * documents) // total
                    score += w * ((1_000_000_000 * counts[term]) // (1000 * counts[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1):
            rows.append((item, rank, doc, -score))
    return Counter(rows)


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert found(QUERIES["op12_ranked_search"](spark, SF)) == brute_force(docs, items)


@pytest.mark.parametrize("block_terms", [200_000, 3])
@pytest.mark.parametrize("top", [20, 2])
def test_ties_copies_and_hot_bags(spark, top, block_terms):
    """Many documents of one bag, equal scores of different bags, several passes over the items."""
    rng = random.Random(top)
    words = ["a", "B", "çà", "d1", "E", "zz", "x"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in rng.sample(range(500), 150)]
    docs += [(1000 + i, "a b a") for i in range(60)] + [(7, "hot"), (7, "hot"), (None, "a b"), (None, "hot hot")]
    items = [(1, "A b"), (2, "çà d1 d1 nowhere"), (3, "hot E"), (3, "zz"), (4, ""), (None, "x x x"), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    params = ranked_search.SearchParams(top=top, block_terms=block_terms)
    assert found(ranked_search.search(frame, asked, params)) == brute_force(docs, items, top)


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "the quick line"), (2, "word five"), (3, "日本語 x"), (4, "\0 $$$")]
    asked = spark.createDataFrame([(*r, 0, "k") for r in items], "item_id long, text string, key int, bag string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(ranked_search.search(odd_docs, asked)) == brute_force(docs, items)
    assert ranked_search.search(no_docs, asked).count() == 0
    assert ranked_search.search(odd_docs, asked.limit(0)).count() == 0
