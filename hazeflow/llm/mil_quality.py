"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (`PASSAGE_WORDS` words each, the whole text). Every passage is encoded as a
vector of surface features; gated attention weights, learned from document labels only, say how much each
passage counts; the weighted passage representation is scored.

Scoring runs where the rows are, in Arrow batches; nothing is shuffled. The model is fitted on at most
`TRAIN_DOCS` labelled documents, picked by a hash of their ids, whose passages are encoded in Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from hazeflow.llm.frames import col, free_name, slices
from hazeflow.scratch import materialize

PASSAGE_WORDS = 128
TRAIN_DOCS = 6_000  # bound on the labelled documents the model is fitted on
THRESHOLD = 0.3
FOLDS = 5
WORD_BINS = 32
WIDTH, GATES = 16, 8
EPOCHS, BAGS_AT_ONCE, RATE, DECAY = 30, 128, 0.01, 1e-4


def _byte_classes() -> tuple[np.ndarray, int]:
    groups = [b"\n", b" ", b"\t\x0b\x0c\r", b".,", b"!?", b"|", b"#$%&*<>@^~=+_/\\", b"'\"()[]{}:;-`", bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(97, 123))]
    table = np.full(256, len(groups), np.int64)
    for number, group in enumerate(groups):
        table[list(group)] = number
    table[128:] = len(groups) + 1
    return table, len(groups) + 2


_CLASS, CLASSES = _byte_classes()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WORD_BASE = 0x9E3779B97F4A7C15
FEATURES = CLASSES + 6 + WORD_BINS


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, _WORD_BASE, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_WORD_BASE, -1, 1 << 64), np.uint64)])
    return up, down


def encode_passages(texts: pa.Array, passage_words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Feature vectors of all passages in a row, and the number of passages of each text (one at least)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    word = ~_SPACE[data]
    apart = np.zeros(len(data) + 1, bool)
    apart[offsets] = True
    begins = np.flatnonzero(word & (apart[:-1] | ~np.r_[False, word[:-1]]))
    ends = np.flatnonzero(word & (apart[1:] | ~np.r_[word[1:], False])) + 1
    first = np.searchsorted(begins, offsets)
    counts = np.diff(first)
    bags = np.maximum(-(-counts // passage_words), 1)
    total = int(bags.sum())
    lead = np.cumsum(bags) - bags  # number of each text's first passage
    text_of = np.repeat(np.arange(len(counts)), counts)
    passage = lead[text_of] + (np.arange(len(begins)) - first[text_of]) // passage_words
    n = np.bincount(passage, minlength=total)
    # a passage's bytes reach from its first word, or its text's start, to the next passage's
    edge = np.zeros(total + 1, np.int64)
    edge[-1] = len(data)
    edge[passage[::-1]] = begins[::-1]
    edge[lead] = offsets[:-1]
    size = np.maximum(np.diff(edge), 1)
    owner = np.repeat(np.arange(total), np.diff(edge))
    classes = np.bincount(owner * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES) / size[:, None]
    length = (ends - begins).astype(float)
    words = np.maximum(n, 1)
    mean = np.bincount(passage, length, total) / words
    spread = np.sqrt(np.maximum(np.bincount(passage, length**2, total) / words - mean**2, 0))
    up, down = _powers(len(data))
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    hashed = (sums[ends] - sums[begins]) * down[begins]
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bins = np.bincount(passage * WORD_BINS + (hashed >> np.uint64(59)).astype(np.int64), minlength=total * WORD_BINS)
    bins = np.sqrt(bins.reshape(total, WORD_BINS) / words[:, None])
    # equal words of a passage side by side
    keys = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    fresh = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    where = (keys[fresh] >> np.uint64(40)).astype(np.int64)
    commonest = np.zeros(total)
    np.maximum.at(commonest, where, np.diff(np.r_[fresh, len(keys)]))
    shape = np.stack([mean, spread, np.bincount(where, minlength=total) / words, commonest / words, np.log1p(n), np.log1p(size) - np.log1p(n)], axis=1)
    return np.hstack([classes, shape, bins]).astype(np.float32), bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Encoder `W`, attention `V`, gate `U`, their weights `w`, and the scoring vector `c`; or a constant."""

    weights: dict[str, np.ndarray]
    centre: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.weights, np.cumsum(bags) - bags
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), bags))
        a = e / np.repeat(np.add.reduceat(e, starts), bags)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, out: dict, bags: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.weights, np.cumsum(bags) - bags
        x, h, t, g, a, z = (out[k] for k in ("x", "h", "t", "g", "a", "z"))
        miss = (out["p"] - label) / len(label)
        dz = np.repeat(miss, bags)[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), bags))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ miss, "d": miss.sum(keepdims=True)}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = [np.zeros(0)]
        for part in slices(texts):
            x, bags = encode_passages(part)
            out.append(self.forward((x - self.centre) / self.scale, bags)["p"])
        return np.concatenate(out)


def fit_bags(x: np.ndarray, bags: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Fit on bags of passage vectors by Adam; with one class only the model is its share (0.5 without any bag)."""
    nothing = np.zeros(0)
    if len(label) == 0 or label.min() == label.max():
        return Model({}, nothing, nothing, float(label.mean()) if len(label) else 0.5)
    draw = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    shapes = {"W": (x.shape[1], WIDTH), "b": (WIDTH,), "V": (WIDTH, GATES), "U": (WIDTH, GATES), "w": (GATES,), "c": (WIDTH,), "d": (1,)}
    weights = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
    model = Model(weights, centre, scale)
    x = (x - centre) / scale
    ends = np.cumsum(bags)
    first, second, step = {k: 0.0 for k in shapes}, {k: 0.0 for k in shapes}, 0
    for epoch in range(epochs):
        order = draw.permutation(len(bags))
        for begin in range(0, len(order), BAGS_AT_ONCE):
            picked = order[begin : begin + BAGS_AT_ONCE]
            n = bags[picked]
            rows = np.repeat(ends[picked] - np.cumsum(n), n) + np.arange(n.sum())
            grads = model.gradient(model.forward(x[rows], n), n, label[picked])
            step += 1
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for k, grad in grads.items():
                grad = grad + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def remainder(id_col: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for part in slices(batch.column("text")):
            x, bags = encode_passages(part)
            ends = np.cumsum(bags)
            vectors = [x[e - n : e].tobytes() for n, e in zip(bags, ends)]
            ids, labels = (batch.column(name).slice(done, len(part)) for name in ("id", "label"))
            done += len(part)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(vectors, pa.binary())], names=["id", "label", "vectors"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on the labelled documents whose fold is not 0, at most `train_docs` of them (lowest hash of the id).

    Null ids and labels take no part; an id with several labels counts with its lowest.
    """
    known = labels.select(col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("label")).filter("labelled is not null and label is not null")
    known = known.filter(remainder(F.col("labelled")) != 0).groupBy("labelled").agg(F.min("label").alias("label"))
    here = docs.select(col(id_col).alias("id"), F.col(text_col).alias("text"))
    present = known.join(here.select(F.col("id").alias("labelled")).distinct(), "labelled", "left_semi")
    picked = materialize(present.orderBy(F.xxhash64("labelled"), "labelled").limit(train_docs), "labelled")
    # the picked table is bounded by train_docs, so every task can hold it
    bags = here.join(F.broadcast(picked), F.col("id") == F.col("labelled")).dropDuplicates(["id"])
    named = bags.select(F.col("id").cast("string").alias("id"), "label", "text")
    rows = named.mapInArrow(_encoded, "id string, label int, vectors binary").collect()
    rows.sort(key=lambda r: r.id)  # the fit does not depend on how the rows were laid out
    vectors = [np.frombuffer(r.vectors, np.float32).reshape(-1, FEATURES) for r in rows]
    sizes = np.array([len(v) for v in vectors], np.int64)
    return fit_bags(np.concatenate(vectors) if vectors else np.zeros((0, FEATURES)), sizes, np.array([r.label for r in rows], float))


def score_column(text: Column, model: Model) -> Column:
    """Probability of label 1; null and empty texts are scored as one empty passage."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    return arrow_udf(run, "double").asNondeterministic()(text)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document; a null id is not held out.

    Rows may repeat; an empty table gives none; other columns are ignored.
    """
    rows = docs.select(col(id_col).alias("doc_id"), score_column(col(text_col), model).alias("score"))
    return rows.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` less the rows scored under the threshold; columns stay as they are."""
    name = free_name(docs, "quality_score")
    return docs.withColumn(name, score_column(col(text_col), model)).filter(F.col(name) >= threshold).drop(name)
