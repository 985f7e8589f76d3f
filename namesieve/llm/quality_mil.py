"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded as a vector of byte
and byte-pair rates; a gated attention layer gives each passage a weight,
a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))), and a logistic layer scores
the weighted sum of the passages. Only documents have labels: the attention
learns which passages decide.

Training uses a sample of labelled rows, bounded in rows and in bytes of text,
whose passage vectors are computed on the executors; the model is a few small matrices. Scoring encodes
and scores documents where they are read, one Arrow batch at a time, without a
shuffle. All passages of a text count, however long it is.

Only the text is an input. Labels are learnt from rows whose crc32(doc_id as
text) mod 5 is not 0. Nulls and odd rows: a null or empty text is one empty
passage and gets a score like any other; documents without a label are scored;
repeated rows get equal scores; without usable labels the score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namesieve.llm.common import bounded_batches, held_out, labelled_sample, whole
from namesieve.workspace import work_folder, written

#: Byte classes of the single-byte rates: each printable ASCII character that is
#: no letter or digit has its own, the others share one per kind.
KINDS = np.zeros(256, np.int64)
KINDS[ord("a") : ord("z") + 1] = 1
KINDS[ord("A") : ord("Z") + 1] = 2
KINDS[ord("0") : ord("9") + 1] = 3
KINDS[[9, 10, 11, 12, 13, 32]] = 4
KINDS[128:] = 5
_OWN = [b for b in range(33, 127) if not KINDS[b]]
KINDS[_OWN] = np.arange(6, 6 + len(_OWN))
N_KINDS = 6 + len(_OWN)
PAIRS = 96


@dataclass(frozen=True)
class MilParams:
    """``per_class`` bounds the labelled rows of each class that are learnt from,
    ``class_bytes`` their texts together: rows are drawn in a seeded order, and
    those that do not fit any more are left out."""

    passage: int = 512
    per_class: int = 2000
    class_bytes: int = 64_000_000
    attention: int = 16
    rounds: int = 160
    rate: float = 0.02
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 5


WIDTH = N_KINDS + PAIRS + 4


def encode_passages(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, number of passages of each text); a text has at least one passage."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-lengths // size))
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = int(counts.sum())
    # The passage of each byte: its text's first passage + its offset in the text / size.
    offset = np.arange(len(data)) - np.repeat(begin, lengths)
    passage = np.repeat(first, lengths) + offset // size
    kind = KINDS[data]
    single = np.bincount(passage * N_KINDS + kind, minlength=n * N_KINDS).reshape(n, N_KINDS)
    length = np.maximum(1, single.sum(1, keepdims=True)).astype(np.float32)
    if len(data) > 1:
        inside = passage[1:] == passage[:-1]
        at, pair = passage[1:][inside], (kind[:-1] * 61 + kind[1:] * 7)[inside] % PAIRS
        pairs = np.bincount(at * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
    else:
        pairs = np.zeros((n, PAIRS))
    # Repetition: how many different 4-byte strings, and bytes equal to the one before.
    variety = np.zeros(n, np.float32)
    same = np.zeros(n, np.float32)
    if len(data) > 4:
        gram = data[:-3] * 16777619 + data[1:-2] * 65599 + data[2:-1] * 257 + data[3:]
        inside = passage[3:] == passage[:-3]
        cell = np.zeros((n, 512), bool)
        cell[passage[3:][inside], (gram[inside] * 2654435761 >> 13) % 512] = True
        variety = cell.sum(1).astype(np.float32)
        equal = (data[1:] == data[:-1]) & (passage[1:] == passage[:-1])
        same = np.bincount(passage[1:][equal], minlength=n).astype(np.float32)
    size_of = length[:, 0]
    extra = np.column_stack([
        variety / np.minimum(512, size_of + 8), same / size_of, np.log1p(size_of) / 7, np.ones(n),
    ])
    rates = np.sqrt(np.hstack([single, pairs]) / length)
    return np.hstack([rates, extra]).astype(np.float32), counts


@dataclass
class MilModel:
    """Standardised inputs, attention matrices V and U with w, and the logistic layer."""

    mean: np.ndarray
    spread: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray

    def forward(self, h: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        tanh, gate = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        energy = np.clip((tanh * gate) @ self.w, -30, 30)
        top = np.repeat(np.maximum.reduceat(energy, start), counts)
        weight = np.exp(energy - top)
        weight /= np.repeat(np.add.reduceat(weight, start), counts)
        bag = np.add.reduceat(h * weight[:, None], start, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ self.c, -30, 30)))
        return {"tanh": tanh, "gate": gate, "weight": weight, "bag": bag, "score": score, "start": start}

    def normalise(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def score(self, texts: list[bytes], size: int) -> np.ndarray:
        x, counts = encode_passages(texts, size)
        return self.forward(self.normalise(x), counts)["score"]


def train(x: np.ndarray, counts: np.ndarray, label: np.ndarray, params: MilParams) -> MilModel:
    """Full-batch Adam on the weighted log loss, both classes weighing alike."""
    rng = np.random.default_rng(params.seed)
    mean, spread = x.mean(0), x.std(0) + 1e-2
    mean[-1], spread[-1] = 0.0, 1.0  # the constant input is the bias
    shapes = {"v": (WIDTH, params.attention), "u": (WIDTH, params.attention), "w": (params.attention,)}
    start = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes.items()}
    model = MilModel(mean, spread, **start, c=np.zeros(WIDTH, np.float32))
    h = model.normalise(x).astype(np.float32)
    balance = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    moments = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in "vuwc"}
    for step in range(1, params.rounds + 1):
        f = model.forward(h, counts)
        error = ((f["score"] - label) * balance).astype(np.float32)
        by_passage = np.repeat(error, counts)
        # d loss / d energy = weight * (its own pull - the bag's mean pull).
        pull = h @ model.c
        mean_pull = np.repeat(f["bag"] @ model.c, counts)
        energy = by_passage * f["weight"] * (pull - mean_pull)
        gated = energy[:, None] * model.w
        grads = {
            "c": f["bag"].T @ error,
            "w": (f["tanh"] * f["gate"]).T @ energy,
            "v": h.T @ (gated * f["gate"] * (1 - f["tanh"] ** 2)),
            "u": h.T @ (gated * f["tanh"] * f["gate"] * (1 - f["gate"])),
        }
        for k, g in grads.items():
            value = getattr(model, k)
            g = g + params.decay * value
            m, s = moments[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            change = (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            setattr(model, k, (value - params.rate * change).astype(np.float32))
    return model


def fit(docs: DataFrame, labels: DataFrame, params: MilParams, label: str = "quality") -> MilModel | None:
    """A model from a bounded sample; None if a class has no row to learn from."""
    bounded_batches(docs.sparkSession)
    wanted = {0: params.per_class, 1: params.per_class}
    sample = labelled_sample(labels, label, wanted, params.seed)
    size = params.passage

    @F.arrow_udf("struct<vectors:binary,passages:long>")
    def encode(texts: pa.Array) -> pa.Array:
        raw = [t.as_py() for t in texts.cast(pa.binary())]
        vectors, counts = encode_passages(raw, size)
        ends = np.cumsum(counts)
        parts = [vectors[e - c : e].tobytes() for e, c in zip(ends, counts)]
        return pa.StructArray.from_arrays([pa.array(parts, pa.binary()), pa.array(counts)], ["vectors", "passages"])

    folder = work_folder(docs.sparkSession)
    marked = docs.select("doc_id", whole("text").alias("body")).join(F.broadcast(sample), "doc_id")
    drawn = marked.select(
        "doc_id", "label", F.octet_length("body").cast("long").alias("n_bytes"),
        F.xxhash64("doc_id", F.lit(params.seed)).alias("draw"), encode(F.col("body")).alias("bag"),
    )
    drawn = written(drawn, f"{folder}/labelled")
    in_order = Window.partitionBy("label").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    held = drawn.withColumn("held", F.sum("n_bytes").over(in_order)).filter(F.col("held") <= params.class_bytes)
    rows = held.select("doc_id", "label", "bag").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows["label"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    bags = rows["bag"].tolist()
    x = np.frombuffer(b"".join(b["vectors"] for b in bags), np.float32).reshape(-1, WIDTH)
    counts = np.array([b["passages"] for b in bags], np.int64)
    return train(x, counts, y, params)


def score(text: Column, model: MilModel | None, params: MilParams) -> Column:
    """The score of a text column, 0 to 1."""
    shared = SparkSession.active().sparkContext.broadcast(model)
    size = params.passage

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        raw, model = [t.as_py() for t in texts.cast(pa.binary())], shared.value
        if model is None:
            return pa.array(np.full(len(raw), 0.5))
        out, some, held = [], [], 0
        for text in raw:
            some.append(text)
            held += len(text)
            if held >= 2_000_000:
                out.append(model.score(some, size))
                some, held = [], 0
        if some:
            out.append(model.score(some, size))
        return pa.array(np.concatenate(out).astype(float) if out else np.zeros(0))

    return scores(whole(text))


def scored(docs: DataFrame, labels: DataFrame, params: MilParams | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    params = params or MilParams()
    model = fit(docs, labels, params)
    rows = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text"), model, params).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
