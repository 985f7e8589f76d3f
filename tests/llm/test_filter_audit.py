"""The filter audit against running every order."""

import re
from collections import Counter
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from namesieve.llm import filter_audit
from namesieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(docs, good, toxic):
    """``docs``: (doc_id, text, lang). Applies the filters in every order, one after another."""
    null_last = lambda i: (i is None, i)
    fails = []
    for doc_id, text, lang in docs:
        body = text or ""
        words = WORD.findall(body)
        smaller = any((t or "") == body and null_last(i) < null_last(doc_id) for i, t, _ in docs)
        fails.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in body) > 3 * len(body),
            "D": any(c in "#$%&*|" for c in body), "E": smaller,
        })
    rows = {}
    for part in {d[2] or "" for d in docs}:
        mine = [(d, f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [d for d, f in left if f[name]]
                left = [(d, f) for d, f in left if not f[name]]
                shapley[name] += len(gone)
                failing = [f for _, f in mine if f[name]]
                rows[part, "".join(order), step] = [
                    name, len(left), len(gone), len(failing) - len(gone),
                    sum(sum(f.values()) == 1 for f in failing),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
        for key, row in rows.items():
            if key[0] == part:
                row.append(shapley[row[0]])
    return rows


def found(df):
    return {
        (r["part"], r["filter_order"], r["step"]): [
            r["filter"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"],
            r["toxic_lost"], r["shapley"],
        ]
        for r in df.collect()
    }


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, toxic = ({r.doc_id for r in labels if r[c] == 1} for c in ("quality", "toxic"))
    rows = QUERIES["op11_filter_audit"](spark, SF)
    assert rows.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
        "toxic_lost", "shapley",
    ]
    whole = filter_audit.audit(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    )
    assert found(whole) == brute_force([(d.doc_id, d.text, d.lang) for d in docs], good, toxic)
    assert rows.count() == whole.count()


def test_odd_rows(spark, odd_docs, no_docs, labels):
    rows = [(r.doc_id, r.text, None if i % 4 == 0 else f"l{i % 2}") for i, r in enumerate(odd_docs.collect())]
    rows += [(3, "\n", "l1"), (20, "mark #" + " WORD" * 300, "l0"), (21, "mark #" + " WORD" * 300, "")]
    docs = spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, mask int, digest string, n int"
    )
    some = spark.createDataFrame(
        [(1, 1, None), (1, 0, 1), (20, None, 1), (21, 1, 0), (None, 1, 1), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    assert found(filter_audit.audit(docs, some)) == brute_force(rows, {1, 21}, {1, 20})
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert filter_audit.audit(odd_docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_other_filters(spark, odd_docs, labels):
    only = {"x": F.col("body") == "", "y": F.col("body").isNull()}
    rows = filter_audit.audit(odd_docs, labels, only, copies=None, part="source").collect()
    assert {(r.filter_order, r.step) for r in rows} == {("xy", 1), ("xy", 2), ("yx", 1), ("yx", 2)}
    assert all(r.removed == 0 for r in rows if r["filter"] == "y")
    with pytest.raises(ValueError):
        filter_audit.audit(odd_docs, labels, {}, copies=None)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_lattice_counts_orders(n):
    edges = filter_audit.lattice(n)
    assert len(edges) == n * 2 ** (n - 1)
    for e in edges:
        size = e["state"].bit_count()
        assert e["orders"] == factorial(size) * factorial(n - size - 1)
