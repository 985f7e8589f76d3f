"""Each operator against a brute-force version, and on odd and empty tables."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from namesieve.llm import (
    bpe, chat_format, components, exact_dedup, line_dedup, mixing, quality_mil, quality_rules,
    simhash, toxicity, url_filter,
)
from namesieve.llm.queries import QUERIES, URL_RULES, tokenizer
from namesieve.workspace import work_folder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table_rows(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


# ---------------------------------------------------------------- 1 mixing


@pytest.mark.parametrize("seed", range(8))
def test_fit_counts_is_the_best_subset_sum(seed):
    rng = random.Random(seed)
    sizes = np.array(rng.sample(range(3, 60), 6))
    counts = np.array([rng.randint(1, 3) for _ in sizes])
    budget = rng.randint(1, int((sizes * counts).sum()) - 1)
    sums = {0}
    for s, c in zip(sizes.tolist(), counts.tolist()):
        sums = {x + k * s for x in sums for k in range(c + 1)}
    taken = mixing.fit_counts(sizes, counts, budget, 1 << 16)
    assert (taken >= 0).all() and (taken <= counts).all()
    assert abs(int((sizes * taken).sum()) - budget) == min(abs(x - budget) for x in sums)
    assert abs(int((sizes * mixing.fit_counts(sizes, counts, budget, 10)).sum()) - budget) <= sizes.max()


def test_mix(spark):
    docs = table_rows(spark)
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    total = Counter()
    for d in docs:
        total[d.source] += size[d.doc_id]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    target, free, left = {}, set(total), 1.5 * sum(total.values())
    while len(target) < len(total):
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * total[s]} or set(free)
        for s in above:
            target[s] = min(2.0 * total[s], weight[s] * level)
            left -= target[s]
        free -= above
    first, again = (QUERIES["op1_mix_sources"](spark, SF).collect() for _ in range(2))
    assert sorted(first) == sorted(again)
    source, taken = {d.doc_id: d.source for d in docs}, Counter()
    for r in first:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= max(size[d.doc_id] for d in docs if d.source == s)


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and mixing.mix(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixing.mix(odd_docs, mixing.MixParams(bucket_rows=1)).agg(F.sum("taken")).first()[0] > 0


def test_rows_of_one_id_are_mixed_apart(spark):
    rows = [(1, "w " * n, "a") for n in range(1, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.size: r.copies for r in mixing.mix(docs).collect()}
    assert set(plan.values()) == {1, 2}
    got = Counter(len(r.text.split()) for r in mixing.mixed_documents(docs).collect())
    assert got == plan


# ------------------------------------------------------------ 2 and 5 dedup


def test_line_dedup_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.kept) for r in line_dedup.dedup_lines(odd_docs).collect()}
    first = "Línea única número uno\nshared line of some length\n\nshared line of some length"
    assert (9, first) in got and (10, "other") in got and (0, "") in got and (3, "\n") in got
    assert (14, "") in got  # its one line stays in document 13
    assert (None, "null id") in got
    assert line_dedup.dedup_lines(no_docs).count() == 0
    thrice = line_dedup.dedup_lines(odd_docs, line_dedup.LineParams(threshold=3))
    assert thrice.agg(F.sum("n_dropped")).first()[0] == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_groups(odd_docs, no_docs, digest):
    """Also with a digest of one letter, under which different texts collide."""
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.text or "", []).append(-1 if r.doc_id is None else r.doc_id)
    want = Counter()
    for ids in texts.values():
        for i in ids:
            want[(i, max(ids), len(ids))] += 1
    rows = exact_dedup.exact_groups(odd_docs, digest=digest).collect()
    null = lambda i: -1 if i is None else i
    assert Counter((null(r.doc_id), null(r.keep_id), r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(texts)
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.without_copies(odd_docs).columns == odd_docs.columns


def test_state_goes_on_with_later_batches(spark):
    state = exact_dedup.DedupState(spark, work_folder(spark))
    schema = "digest string, n_bytes int, id long, path string, row long"
    state.add(spark.createDataFrame([("d", 1, 5, "p", 0), ("e", 1, 6, "p", 1)], schema))
    state.add(spark.createDataFrame([("d", 1, 9, "q", 0)], schema))
    assert {(r.digest, r.best.id, r.n) for r in state.groups().collect()} == {("d", 9, 2), ("e", 6, 1)}


# ------------------------------------------------------- 3, 4, 10 judgement


def test_rule_statistics(spark):
    for d in table_rows(spark):
        text = d.text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside),
        )
        assert quality_rules.text_statistics(text.encode())[:5] == want


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    good, far = rng.normal(size=(600, 3)), rng.normal(7, 0.1, size=(20, 3))
    forest = quality_rules.grow(good, np.vstack([good, far]), quality_rules.RuleParams(trees=50, per_tree=256))
    good_score, far_score = forest.score(good), forest.score(far)
    threshold = quality_rules.calibrate(good_score, far_score, 0.01)
    assert (good_score <= threshold).mean() >= 0.99 and (far_score > threshold).all()


def test_judges_on_odd_rows(odd_docs, no_docs, labels):
    rows = quality_rules.judged(odd_docs, labels).select("doc_id", "verdict.*").collect()
    assert len(rows) == odd_docs.count() and not [r for r in rows if r.base_failed and r.kept]
    assert quality_rules.judged(no_docs, labels).count() == 0
    assert quality_rules.good_documents(odd_docs, None).columns == odd_docs.columns
    for scored in (quality_mil.scored, toxicity.scored):
        rows = scored(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert scored(no_docs, labels).count() == 0 and scored(odd_docs, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("name, label", [("op3_quality_classifier", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in table_rows_of(spark, folder, "labels")}
    rows = [r for r in QUERIES[name](spark, folder).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.97
    other = [r for r in rows if truth[r.doc_id] == (label == "toxic")]
    assert np.mean([r.predicted == truth[r.doc_id] for r in other]) > 0.9


def table_rows_of(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def test_swaps_lower_the_score_of_neutral_mentions():
    """Labelled texts name one group mostly where they are toxic; swapping undoes that."""
    toxic = [{"muslims", "are", "awful", f"w{i % 9}"} for i in range(60)]
    clean = [{"people", "came", "today", f"w{i % 9}"} for i in range(60)] + [{"christians", "came"}] * 3
    label = np.array([1] * 60 + [0] * 63)

    def mention(swap):
        model = toxicity.train(toxic + clean, label, toxicity.ToxicityParams(swap=swap, min_docs=2))
        return sum(map(model.word, {"muslims"})), model.bias + sum(map(model.word, {"muslims", "came", "today"}))

    (weight, neutral), (free_weight, free_neutral) = mention(5.0), mention(0.0)
    assert weight < free_weight / 2 and neutral < free_neutral and neutral < 0


# ------------------------------------------------------------------ 6 chat


def chat(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat_format.format_turns(df, **more)


def test_chat_round_trip(spark):
    parts = ["\\", "### ", "</turn>", ": ", "=", "User", "\n", "x", "é", "🎉", "<", "#"]
    rng = random.Random(4)
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool: #1", ""]), text())
            for c in range(12) for t in range(rng.randint(1, 30))]
    whole = chat(spark, rows).orderBy("conv_id", "position").collect()
    for window in (2, 64):
        cut = chat(spark, rows, window=window, carry=1).orderBy("conv_id", "position").collect()
        assert cut == whole
    for c in range(12):
        turns = [(r[2], r[3]) for r in sorted(x for x in rows if x[0] == c)]
        spans = [s for s in whole if s.conv_id == c]
        joined = "".join(s.rendered for s in spans)
        assert joined == chat_format.turn_template(turns) and chat_format.parse(joined) == turns
        assert [chat_format.unescape(s.rendered[s.start : s.stop]) for s in spans] == [t for _, t in turns]


def test_template_that_rewrites_history(spark):
    def counted(turns):
        return f"[{len(turns)} turns]" + chat_format.turn_template(turns)

    spans = chat(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")], template=counted)
    assert [s.stable for s in spans.orderBy("position").collect()] == [True, False]
    with pytest.raises(Exception, match="rewrites history"):
        chat_format.require_stable(spans).collect()


def test_long_conversations_are_rendered_whole(spark):
    def numbered(turns):
        if turns and turns[0][0] != "system":
            raise ValueError("a system turn must come first")
        return "".join(f"turn {i}: {text}\n" for i, (_, text) in enumerate(turns, 1))

    def forgetful(turns):
        return "".join("-\n" if i < len(turns) - 70 else f"{text}\n" for i, (_, text) in enumerate(turns))

    rows = [(1, t, "user" if t else "system", f"t{t}") for t in range(200)]
    spans = chat(spark, rows, template=numbered).orderBy("position").collect()
    assert [s.rendered for s in spans] == [f"turn {t + 1}: t{t}\n" for t in range(200)]
    assert all(s.stable and s.rendered[s.start : s.stop] == f"t{s.position}" for s in spans)
    spans = chat(spark, rows, template=forgetful).orderBy("position").collect()
    assert [s.stable for s in spans] == [t < 70 for t in range(200)]


def test_chat_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None)]
    got = {r.conv_id: r for r in chat_format.read_back(chat(spark, rows)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 0
    assert got[None].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat_format.read_back(chat(spark, [])).count() == 0


# ------------------------------------------------------------------- 7 URLs


def test_url_rules(spark):
    urls = [
        "http://www.Example.com/en/1", "http://example.com/en/1", "https://a.example.com/en", "x://b.net/es/?q",
        "x://notnet/es/", "http://com/a#b", "http://q.org", None, "no scheme", "://h.com/x?y#z", "http://a.net/fr/",
    ]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judged(pages, URL_RULES).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/"), 1: ("example.com", "/en/1", "example.com/en/"),
        2: ("a.example.com", "/en", "com/"), 3: ("b.net", "/es/", "net/es/"), 4: ("notnet", "/es/", None),
        5: ("com", "/a", "com/"), 6: ("q.org", "", None), 7: ("", "", None), 8: ("", "", None),
        9: ("h.com", "/x", "com/"), 10: ("a.net", "/fr/", "net/fr/"),
    }
    assert url_filter.judged(pages.limit(0), URL_RULES).count() == 0
    one = url_filter.judged(pages, [url_filter.rule("block", "org/")])
    assert {r.verdict for r in one.collect()} == {"allow"}
    text = spark.createDataFrame([("aab",), ("",)], "t string").select(url_filter.entropy(F.col("t")).alias("e"))
    assert sorted(r.e for r in text.collect()) == [0.0, pytest.approx(0.9182958)]


def test_url_model_learns(spark):
    rows = [(i, f"http://h{i % 7}.com/a/{i}") for i in range(80)]
    rows += [(i, f"http://h{i % 7}.net/casino-bonus/{i}?a=1&b=2") for i in range(80, 160)]
    rows += [(200, "http://new.org/a/3"), (201, "http://new.org/casino-bonus/9?a=1&b=2")]
    rules = [url_filter.rule("allow", "com/"), url_filter.rule("block", "net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, rules).collect()}
    assert (got[200], got[201]) == ("allow", "block")


# -------------------------------------------------------------------- 8 BPE


def test_bpe_equals_the_library(spark, odd_docs, no_docs):
    content = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    rng = random.Random(7)
    texts = ["".join(rng.choice(" aeiouxyzé日🎉\n\t\u00a0'!12") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["ab" * 4000, "\n\nx", " a", "a ", "<|endoftext|>", "don't  stop"]
    texts += [r.text or "" for r in odd_docs.collect()]
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text, packed in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    rows = bpe.encode_documents(odd_docs, tokenizer(spark)).collect()
    assert Counter(bytes(r.decoded) for r in rows) == Counter((r.text or "").encode() for r in odd_docs.collect())
    assert bpe.encode_documents(no_docs, tokenizer(spark)).count() == 0


# ---------------------------------------------------------------- 9 SimHash


def linked(fps, radius=3):
    """Smallest index reachable, by comparing all pairs."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_simhash_equals_all_pairs(spark):
    docs = sorted(table_rows(spark), key=lambda d: d.doc_id)
    fps = []
    for d in docs:
        words = (d.text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = linked(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {d.doc_id: (f"{fps[i]:016x}", docs[root[i]].doc_id) for i, d in enumerate(docs)}


@pytest.mark.parametrize("leaf, block", [(4096, 4096), (8, 4096), (16, 8)])
def test_trees_lose_no_link(spark, leaf, block):
    """A cloud of near fingerprints among random ones, with deep trees and cut leaves."""
    rng = random.Random(leaf)
    centre = rng.getrandbits(64)
    cloud = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)}
    fps = sorted(cloud | {rng.getrandbits(64) for _ in range(150)} | {0, 7, (1 << 64) - 1})
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    params = simhash.SimHashParams(leaf=leaf, block=block)
    edges = simhash.near_pairs(spark.createDataFrame(rows, "fp long"), params)
    found = {r.node: r.root for r in components.components(edges, work_folder(spark)).collect()}
    root, groups = linked(fps), {}
    for i, f in enumerate(fps):
        groups.setdefault(root[i], set()).add(int(np.uint64(f).astype(np.int64)))
    for group in groups.values():
        assert {found.get(f, f) for f in group} == {min(group)}


def test_simhash_odd_rows(odd_docs, no_docs):
    rows = simhash.near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    group = {r.doc_id: r.component_id for r in rows}
    assert group[0] == group[4] == 0 and group[14] == 13
    assert simhash.near_groups(no_docs).count() == 0
    kept = simhash.without_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 14").count() == 0


def test_unique_row_stays_if_its_id_has_a_near_copy(spark):
    rng = random.Random(5)
    one, other = (" ".join(str(rng.random()) for _ in range(400)) for _ in range(2))
    rows = [(3, one), (7, one + " end"), (7, other), (9, other + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.without_near_copies(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, one), (7, other)]
