"""A toxicity classifier that is regularised with counterfactual swaps.

A linear model over the distinct words of a text and their first letters (so
that unseen forms of a known stem count). In every labelled sentence that names
a group, the group's name is swapped for the others of its kind; the loss adds
the squared change of the score over these pairs, so that naming a group, which
is common in labelled toxic text, does not itself raise the score of neutral text.

Training uses a bounded sample of labelled rows. Scoring looks up word weights
where a text is read, without a shuffle; the vocabulary that is broadcast has
a bound that is a parameter.

Only the text is an input. Labels are learnt from rows whose crc32(doc_id as
text) mod 5 is not 0. Nulls and odd rows: a null or empty text has the score of
no evidence; repeated rows get equal scores; without usable labels the score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.llm.common import bounded_batches, held_out, labelled_sample, whole

#: Terms of one tuple are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"), ("african", "european", "american", "arab"),
    ("old", "young"), ("disabled", "blind", "deaf"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
EDGES = ".,;:!?\"'()[]{}<>*#$%&|«»¿¡…-"


@dataclass(frozen=True)
class ToxicityParams:
    """``toxic`` and ``clean`` bound the labelled rows learnt from, ``vocabulary``
    the features kept; a feature must be ``ratio`` times as frequent in toxic as
    in clean texts, or belong to an identity term. ``swap`` weighs the
    counterfactual term."""

    toxic: int = 2000
    clean: int = 3500
    vocabulary: int = 5000
    min_docs: int = 4
    ratio: float = 3.0
    stems: tuple[int, ...] = (4, 5)
    rounds: int = 150
    rate: float = 0.1
    decay: float = 1e-4
    swap: float = 1.0
    threshold: float = 0.5
    seed: int = 3
    terms: tuple[tuple[str, ...], ...] = field(default=IDENTITY_TERMS)


def word_features(word: str, stems: tuple[int, ...]) -> list[str]:
    """Features of one raw word: its form without edge marks, and its beginnings."""
    bare = word.strip(EDGES)
    if not bare:
        return []
    return [bare, *(f"{bare[:k]}~" for k in stems if len(bare) >= k)]


def text_words(text: str) -> set[str]:
    return set(text.lower().split())


def counterfactuals(words: set[str], terms: tuple[tuple[str, ...], ...]) -> list[tuple[str, str]]:
    """(term, other) for every swap that a text with these words allows."""
    bare = {w.strip(EDGES) for w in words}
    return [(a, b) for kind in terms for a in kind if a in bare for b in kind if b != a]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    stems: tuple[int, ...]

    def word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(word, self.stems))


def train(
    texts: list[set[str]], label: np.ndarray, params: ToxicityParams
) -> ToxicityModel:
    """Adam on the balanced log loss, plus ``swap`` times the mean squared change under swaps."""
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for words, y in zip(texts, label):
        seen[int(y)].update({f for w in words for f in word_features(w, params.stems)})
    # One clean text more than seen: a word of few toxic texts must earn its ratio.
    n_clean, n_toxic = max(1, int((label == 0).sum())), max(1, int((label == 1).sum()))
    lift = {
        f: (n / n_toxic) / ((seen[0][f] + 1) / n_clean)
        for f, n in seen[1].items() if n >= params.min_docs
    }
    named = {f for kind in params.terms for t in kind for f in word_features(t, params.stems)}
    named = sorted(f for f in named if seen[0][f] + seen[1][f])
    telling = sorted((-v * np.sqrt(seen[1][f]), f) for f, v in lift.items() if v >= params.ratio)
    number = {f: i for i, f in enumerate(dict.fromkeys([*named, *[f for _, f in telling]][: params.vocabulary]))}
    rows = [
        np.array([number[f] for w in sorted(words) for f in word_features(w, params.stems) if f in number], np.int64)
        for words in texts
    ]
    length = np.array([len(r) for r in rows])
    column = np.concatenate([*rows, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(rows)), length)
    # Swaps as differences of features: +1 for the other term, -1 for the term in the text.
    pairs = Counter(pair for words in texts for pair in counterfactuals(words, params.terms))
    swaps = []
    for (a, b), n in sorted(pairs.items()):
        plus = [number[f] for f in word_features(b, params.stems) if f in number]
        minus = [number[f] for f in word_features(a, params.stems) if f in number]
        swaps.append((np.array(plus + minus, np.int64), np.array([1.0] * len(plus) + [-1.0] * len(minus)), n))
    n_swaps = max(1, sum(n for _, _, n in swaps))
    balance = np.where(label == 1, 0.5 / n_toxic, 0.5 / n_clean)  # both classes weigh alike
    theta = np.zeros(len(number) + 1)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, params.rounds + 1):
        logit = np.bincount(owner, theta[column], len(rows)) + theta[-1]
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label
        error *= balance
        grad = np.bincount(column, error[owner], len(theta)).astype(float)
        grad[-1] = error.sum()
        for at, sign, n in swaps:
            change = float(theta[at] @ sign)
            np.add.at(grad, at, 2 * params.swap * n / n_swaps * change * sign)
        grad[:-1] += params.decay * theta[:-1]
        m += 0.1 * (grad - m)
        s += 0.01 * (grad * grad - s)
        theta -= params.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    weights = {f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 1e-4}
    return ToxicityModel(weights, float(theta[-1]), params.stems)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> ToxicityModel | None:
    """A model from a bounded sample; None if a class has no row to learn from."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(labels, "toxic", {0: params.clean, 1: params.toxic}, params.seed)

    @F.arrow_udf("string")
    def distinct_words(texts: pa.Array) -> pa.Array:
        return pa.array(["\n".join(sorted(text_words(t))) for t in texts.to_pylist()], pa.string())

    marked = docs.select("doc_id", whole("text").alias("body")).join(F.broadcast(sample), "doc_id")
    rows = marked.select("doc_id", "label", distinct_words(F.col("body")).alias("words")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    label = rows["label"].to_numpy()
    if len(np.unique(label)) < 2:
        return None
    return train([set(w.split("\n")) - {""} for w in rows["words"]], label, params)


#: Words whose weight a worker remembers.
MEMORY = 400_000


def score(text: Column, model: ToxicityModel | None) -> Column:
    """The score of a text column, 0 to 1."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        model, known = shared.value, {}
        if model is None:
            return pa.array(np.zeros(len(texts)))
        get, out = known.get, []
        for text in texts:
            words = text_words(text.as_py())
            for word in words.difference(known):
                known[word] = model.word(word)
            out.append(model.bias + sum(map(get, words)))
            if len(known) > MEMORY:
                known.clear()
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30))))

    return scores(whole(text))


def scored(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    params = params or ToxicityParams()
    model = fit(docs, labels, params)
    rows = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
