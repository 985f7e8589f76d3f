"""Rows without a place of their own, and line keys at the edges of lines."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesieve.llm import chat_format, exact_dedup, line_dedup, mixing, simhash
from namesieve.workspace import work_folder


@pytest.fixture(scope="module")
def twice(spark):
    """Tables whose rows share places in files: exploded, a folder listed twice, a union with itself."""
    path = f"{work_folder(spark)}/twice"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5 + i)), "s") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    copied = docs.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).drop("n")
    return [copied, spark.read.parquet(path, path), docs.unionByName(docs)]


def test_one_row_of_each_text_stays(twice):
    for docs in twice:
        assert sorted(r.doc_id for r in exact_dedup.without_copies(docs).collect()) == list(range(9))
        groups = exact_dedup.exact_groups(docs).collect()
        assert all(r.group_size == 2 for r in groups) and sum(r.kept for r in groups) == 9


def test_rows_are_mixed_as_planned(twice):
    for docs in twice:
        plan = Counter()
        for r in mixing.mix(docs).collect():
            plan[r.doc_id] += r.copies
        mixed = mixing.mixed_documents(docs)
        assert Counter(r.doc_id for r in mixed.collect()) == +plan
    assert simhash.without_near_copies(twice[0]).count() == 18  # all rows of the smallest id stay


def test_clashing_columns_come_back(odd_docs):
    for kept in (exact_dedup.without_copies(odd_docs), simhash.without_near_copies(odd_docs), mixing.mixed_documents(odd_docs)):
        row = kept.first()
        assert kept.columns == odd_docs.columns and row["_metadata"] == "own _metadata" and row["caller"] == "own caller"


def test_line_keys_end_where_blanks_end(spark):
    """U+0085, U+2028 and U+2029 are no blanks, and a blank before them is inside the line."""
    lines = ["another long line", "another long line\t ", "another long line \u0085", "another long line\u0085",
             "another long line \u2028", "another long line\u2028", "another long line \u2029", "another long line\r"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}


@pytest.mark.parametrize("budget", [2_000, 20_000, 40_000])
def test_lengths_are_taken_by_their_counts(budget):
    sizes, counts = np.arange(100, 200), np.full(100, 3)
    total = int((sizes * counts).sum())
    taken = np.mean([mixing.fit_counts(sizes, counts, budget, 1 << 16, s) for s in range(30)], axis=0)
    want = 3 * budget / total
    for part in np.array_split(taken, 5):  # short and long lengths alike
        assert part.mean() == pytest.approx(want, rel=0.25)
    one, other = (mixing.fit_counts(sizes, counts, budget, 1 << 16, s) for s in (1, 2))
    assert (sizes * one).sum() == (sizes * other).sum() == budget and (one != other).any()
    shuffled = np.random.default_rng(0).permutation(100)
    assert (mixing.fit_counts(sizes[shuffled], counts, budget, 1 << 16, 1) == one[shuffled]).all()


def test_lengths_that_are_all_distinct():
    rng = np.random.default_rng(4)
    sizes = rng.choice(np.arange(10, 30_000), 3000, replace=False)
    counts = np.ones(3000, np.int64)
    budget = int(sizes.sum() * 0.3)
    taken = mixing.fit_counts(sizes, counts, budget, 1 << 16, 3)
    assert (sizes * taken).sum() == budget
    long = sizes > np.median(sizes)
    assert 0.2 < taken[long].mean() < 0.4 and 0.2 < taken[~long].mean() < 0.4


def test_a_broken_promise_is_found_at_the_restart(spark):
    def numbered(turns):
        return "".join(f"{i}: {text}\n" for i, (_, text) in enumerate(turns))

    rows = [(1, t, "user", f"t{t}") for t in range(40)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spans = chat_format.format_turns(docs, template=numbered, window=8, whole_chars=0)
    assert [s.position for s in spans.orderBy("position").collect() if not s.stable][0] == 8
    kept = chat_format.format_turns(docs, window=8, whole_chars=0)
    whole = chat_format.format_turns(docs, window=8)  # not costly: never restarted
    assert all(s.stable for s in kept.collect()) and sorted(kept.collect()) == sorted(whole.collect())
    assert all(s.stable for s in chat_format.format_turns(docs, template=numbered, window=8).collect())


def test_window_keeps_odd_texts(spark):
    rng = random.Random(2)
    rows = [(1, t, "assistant", "".join(rng.choice("#<:\\ a\n") for _ in range(9))) for t in range(30)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spans = chat_format.format_turns(docs, window=4, carry=2, whole_chars=0).orderBy("position").collect()
    assert [chat_format.unescape(s.rendered[s.start : s.stop]) for s in spans] == [r[3] for r in rows]
