"""The trained models against plain loops: forward pass, gradient, paths, features, linear score."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesieve.llm import quality_mil, quality_rules, toxicity, url_filter
from namesieve.llm.common import table
from namesieve.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"


def plain_score(model, passages):
    """Gated attention and logistic layer of one bag, one number at a time."""
    energies = []
    for h in passages:
        gated = 0.0
        for j in range(len(model.w)):
            a = sum(h[i] * model.v[i, j] for i in range(len(h)))
            b = sum(h[i] * model.u[i, j] for i in range(len(h)))
            gated += model.w[j] * math.tanh(a) / (1 + math.exp(-b))
        energies.append(gated)
    top = max(energies)
    weights = [math.exp(e - top) for e in energies]
    bag = [sum(w * h[i] for w, h in zip(weights, passages)) / sum(weights) for i in range(len(passages[0]))]
    return 1 / (1 + math.exp(-sum(b * c for b, c in zip(bag, model.c))))


@pytest.fixture(scope="module")
def mil():
    rng = np.random.default_rng(1)
    shapes = {"v": (quality_mil.WIDTH, 4), "u": (quality_mil.WIDTH, 4), "w": (4,), "c": (quality_mil.WIDTH,)}
    parts = {k: rng.standard_normal(s) * 0.2 for k, s in shapes.items()}
    return quality_mil.MilModel(np.zeros(quality_mil.WIDTH), np.ones(quality_mil.WIDTH), **parts)


def test_attention_equals_plain_loops(mil):
    texts = [b"", b"One short text.", b"word " * 400, b"A" * 513 + b"? <b> 5%" * 99]
    x, counts = quality_mil.encode_passages(texts, 512)
    assert counts.tolist() == [1, 1, 4, 3]
    h = mil.normalise(x)
    ends = np.cumsum(counts)
    want = [plain_score(mil, h[e - c : e].tolist()) for e, c in zip(ends, counts)]
    assert mil.score(texts, 512) == pytest.approx(want, rel=1e-4)


def test_training_follows_the_gradient(monkeypatch):
    """One step of training, read from the first change of Adam, against finite differences."""
    rng = np.random.default_rng(2)
    counts = np.array([2, 3, 1, 4])
    x = rng.standard_normal((10, quality_mil.WIDTH)).astype(np.float32)
    label = np.array([0, 1, 1, 0])
    params = quality_mil.MilParams(attention=3, rounds=1, rate=1e-3, decay=0.0)
    before = quality_mil.train(x, counts, label, quality_mil.MilParams(attention=3, rounds=0, decay=0.0))
    before.c = rng.standard_normal(quality_mil.WIDTH).astype(np.float32) * 0.1
    real = quality_mil.MilModel

    def started(*args, **parts):
        return real(*args, **(parts | {"c": before.c.copy()}))

    monkeypatch.setattr(quality_mil, "MilModel", started)
    after = quality_mil.train(x, counts, label, params)
    balance = np.where(label == 1, 0.5 / 2, 0.5 / 2)

    def loss(model):
        p = model.forward(model.normalise(x).astype(np.float64), counts)["score"]
        return float((balance * -(label * np.log(p) + (1 - label) * np.log(1 - p))).sum())

    for name in "vuwc":
        start = getattr(before, name).astype(np.float64)
        moved = getattr(after, name) - getattr(before, name)
        for at in [tuple(rng.integers(0, n) for n in start.shape) for _ in range(12)]:
            slopes = []
            for sign in (1, -1):
                parts = {k: getattr(before, k).astype(np.float64) for k in "vuwc"}
                parts[name] = start.copy()
                parts[name][at] += sign * 1e-4
                slopes.append(loss(real(before.mean, before.spread, **parts)))
            slope = (slopes[0] - slopes[1]) / 2e-4
            if abs(slope) > 1e-6:  # Adam's first change is the rate, against the sign of the slope
                assert np.sign(moved[at]) == -np.sign(slope) and abs(moved[at]) == pytest.approx(1e-3, rel=0.02)


def test_labelled_bytes_are_bounded(spark):
    docs = spark.createDataFrame([(i, "good words here. " * 20 if i % 2 else "$$ ## " * 50) for i in range(60)],
                                 "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    few = quality_mil.fit(docs, labels, quality_mil.MilParams(class_bytes=1000))
    many = quality_mil.fit(docs, labels, quality_mil.MilParams())
    assert few is not None and not np.array_equal(few.c, many.c)
    assert quality_mil.fit(docs, labels, quality_mil.MilParams(class_bytes=100)) is None


def test_forest_paths_by_recursion():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 4))
    forest = quality_rules.grow(rows, rows, quality_rules.RuleParams(trees=20, per_tree=64))

    def path(tree, node, row):
        column = forest.column[tree, node]
        if column < 0:
            return float(forest.path[tree, node])
        right = np.float32(row[column]) >= forest.value[tree, node]
        return path(tree, 2 * node + 1 + int(right), row)

    asked = np.vstack([rows[:40], rng.normal(4, 1, size=(10, 4))])
    want = [2 ** (-np.mean([path(t, 0, r) for t in range(20)]) / forest.scale) for r in asked]
    assert forest.score(asked) == pytest.approx(want, rel=1e-6)


def test_verdicts_follow_forest_and_threshold(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    params = quality_rules.RuleParams()
    forest, threshold = quality_rules.fit(docs, labels, params)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules.judged(docs, labels).select("doc_id", "verdict.*").collect():
        stats = np.array([quality_rules.text_statistics(texts[r.doc_id].encode())])
        failed = stats[0, 0] < 20 or 100 * stats[0, 4] > 30 * stats[0, 0]
        anomaly = float(forest.score(quality_rules.features(stats))[0])
        assert r.base_failed == failed and r.anomaly == pytest.approx(anomaly)
        assert r.kept == (not failed and anomaly <= threshold)


def test_toxicity_score_is_linear(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels, toxicity.ToxicityParams())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.scored(docs, labels).collect():
        logit = model.bias
        for word in set(texts[r.doc_id].lower().split()):
            bare = word.strip(toxicity.EDGES)
            parts = [bare] + [bare[:k] + "~" for k in model.stems if len(bare) >= k] if bare else []
            logit += sum(model.weights.get(p, 0.0) for p in parts)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-9)


def test_url_features_in_plain_python(spark):
    urls = [r.url for r in table(spark, SF, "pages").collect()]
    urls += ["https://a.b-c.example.co.uk/x_1/2/?q=3&r=&s#f", "http://h", "x://1.2.3.4:80/é/ü?ä=1", "none", None, ""]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = rows.select("*", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    got = {r.page_id: r.asDict() for r in url_filter.lexical(rows).collect()}
    for i, url in enumerate(urls):
        url = url or ""
        after = url.partition("://")[2]
        host = "".join(c for c in after.split("/")[0].split("?")[0].split("#")[0])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = after[len(host) :].split("?")[0].split("#")[0]
        n, digits = len(url), sum("0" <= c <= "9" for c in url)
        shares = [k / n for k in Counter(url).values()]
        query = sum(1 for j, c in enumerate(url) if c in "?&" and "=" in url[j + 1 :]
                    and not set(url[j + 1 : url.index("=", j + 1)]) & set("&#"))
        want = {
            "n_chars": n, "host_chars": len(host), "path_chars": len(path), "host_depth": host.count("."),
            "path_depth": path.count("/"), "digit_ratio": digits / max(1, n),
            "path_digits": sum("0" <= c <= "9" for c in path), "entropy": -sum(s * math.log2(s) for s in shares),
            "n_params": query, "n_hyphens": url.count("-") + url.count("_"), "has_fragment": "#" in url,
            "is_secure": url.startswith("https:"), "suffix": ".".join(host.split(".")[-2:]),
        }
        for name, value in want.items():
            if name == "suffix":
                assert got[i][name] == value
            else:
                assert got[i][name] == pytest.approx(float(value), abs=1e-9), (url, name)
    assert len(URL_RULES) == 5
