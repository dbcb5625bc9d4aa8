"""Operator 13: a quality classifier by attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .tables import col, least_hashed, map_texts, read

FOLDS = 5                # labels of documents whose checksum this divides are never learned from
LEAST_SCORE = 0.3        # from here on a document is taken to be of label 1

PASSAGE_WORDS = 64
# Bounds of the sample the weights are fitted on: documents of each label, passages of each.
TRAIN_DOCUMENTS = 1500
TRAIN_PASSAGES = 16
EPOCHS = 30
BATCH = 128
RATE, SHRINK = 3e-3, 1e-3
CODE, GATE = 24, 12      # width of a passage's code and of its attention
SEED = 13

# What kind of byte each is; the pairs of kinds that follow each other describe a passage.
KINDS = 16
KIND_OF = np.full(256, KINDS - 1, np.uint8)
for _kind, _bytes in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
        b"\n\r\x0b\x0c", b".", b",;:", b"!", b"?", b"|", b"#*$%&<>~^", b"\"'`", b"()[]{}",
        b"-_/\\=+@", bytes(range(0x80, 0x100)))):
    KIND_OF[list(_bytes)] = _kind
BLANK = np.isin(KIND_OF, (3, 4))
WORD_FEATURES = 6
WIDTH = KINDS * KINDS + WORD_FEATURES


def passages(text: str) -> np.ndarray:
    """One row of features per passage of PASSAGE_WORDS words; an empty text has one of zeros.

    The shares of pairs of byte kinds tell prose from tables, marks, shouting and code in any
    language; the word features measure repetition and the length of words and lines.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    inside = ~BLANK[data]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(data) else []
    if not len(begins):
        return np.zeros((1, WIDTH), np.float32)
    starts = begins[::PASSAGE_WORDS]
    n = len(starts)
    kinds = KIND_OF[data[begins[0]:]].astype(np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    passage = np.repeat(np.arange(n), lengths)
    pairs = passage[1:] * KINDS * KINDS + kinds[:-1] * KINDS + kinds[1:]
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :KINDS * KINDS] = np.bincount(pairs, minlength=n * KINDS * KINDS).reshape(
        n, -1) / lengths[:, None]
    words = text.split()
    lines = np.add.reduceat(np.append(kinds == 4, False).astype(np.int64), starts - starts[0])
    for i in range(n):
        part = words[i * PASSAGE_WORDS:(i + 1) * PASSAGE_WORDS]
        k = max(1, len(part))
        out[i, KINDS * KINDS:] = (
            len(set(part)) / k, len(set(zip(part, part[1:], strict=False))) / k,
            sum(a == b for a, b in zip(part, part[1:], strict=False)) / k,
            np.log1p(lengths[i] / k), lines[i] / k, np.log1p(k))
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    W: np.ndarray        # features to code
    b: np.ndarray
    V: np.ndarray        # code to attention
    U: np.ndarray        # code to the attention's gate
    a: np.ndarray
    c: np.ndarray        # weighted code to score, the last entry by itself


def encode(model: Model, features: np.ndarray) -> np.ndarray:
    return np.tanh((features - model.mean) / model.scale @ model.W + model.b)


def attention(model: Model, codes: np.ndarray, bag: np.ndarray, bags: int):
    """Gated attention weights, summing to 1 in each bag, and the parts they are made of."""
    t, g = np.tanh(codes @ model.V), 1 / (1 + np.exp(-(codes @ model.U)))
    raw = (t * g) @ model.a
    most = np.full(bags, -np.inf)
    np.maximum.at(most, bag, raw)
    e = np.exp(raw - most[bag])
    return e / np.bincount(bag, e, bags)[bag], t, g


def pooled(codes: np.ndarray, weights: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
    out = np.zeros((bags, codes.shape[1]))
    np.add.at(out, bag, codes * weights[:, None])
    return out


def bag_scores(model: Model, features: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Score of each bag of passages, and the attention weights of all passages."""
    sizes = np.array([len(f) for f in features])
    bag = np.repeat(np.arange(len(sizes)), sizes)
    codes = encode(model, np.concatenate(features))
    weights, _, _ = attention(model, codes, bag, len(sizes))
    z = pooled(codes, weights, bag, len(sizes)) @ model.c[:-1] + model.c[-1]
    return 1 / (1 + np.exp(-z)), weights


def slopes(model: Model, features: np.ndarray, bag: np.ndarray, target: np.ndarray,
           cost: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Cross-entropy of the bags and its derivative by every weight."""
    x = (features - model.mean) / model.scale
    h = np.tanh(x @ model.W + model.b)
    weights, t, g = attention(model, h, bag, len(target))
    z = pooled(h, weights, bag, len(target))
    p = 1 / (1 + np.exp(-(z @ model.c[:-1] + model.c[-1])))
    loss = -np.sum(cost * (target * np.log(p + 1e-12) + (1 - target) * np.log(1 - p + 1e-12)))
    d = cost * (p - target)
    dz = d[:, None] * model.c[:-1]
    # The softmax of a bag passes on only what differs from the bag's mean.
    dw = np.sum(h * dz[bag], axis=1)
    draw = weights * (dw - np.bincount(bag, weights * dw, len(target))[bag])
    dt, dg = draw[:, None] * g * model.a, draw[:, None] * t * model.a
    dtv, dgu = dt * (1 - t * t), dg * g * (1 - g)
    dh = weights[:, None] * dz[bag] + dtv @ model.V.T + dgu @ model.U.T
    dx = dh * (1 - h * h)
    return float(loss), {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dtv, "U": h.T @ dgu,
                         "a": (t * g).T @ draw, "c": np.append(z.T @ d, d.sum())}


def fit(bags: Sequence[np.ndarray], target: np.ndarray, cost: np.ndarray) -> Model:
    """Weights by gradient steps of adaptive size over batches of bags, in a fixed order."""
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags) if bags else np.zeros((1, WIDTH), np.float32)
    model = Model(every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3),
                  rng.normal(0, WIDTH ** -0.5, (WIDTH, CODE)), np.zeros(CODE),
                  rng.normal(0, CODE ** -0.5, (CODE, GATE)),
                  rng.normal(0, CODE ** -0.5, (CODE, GATE)),
                  rng.normal(0, GATE ** -0.5, GATE), np.zeros(CODE + 1))
    first = {n: np.zeros_like(getattr(model, n)) for n in ("W", "b", "V", "U", "a", "c")}
    second = {n: np.zeros_like(v) for n, v in first.items()}
    step = 0
    for _ in range(EPOCHS if bags else 0):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            part = order[low:low + BATCH]
            bag = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
            _, slope = slopes(model, np.concatenate([bags[i] for i in part]), bag,
                              target[part], cost[part])
            step += 1
            for name, s in slope.items():
                s = s / len(part) + SHRINK * getattr(model, name) * (name != "c")
                first[name] += 0.1 * (s - first[name])
                second[name] += 0.01 * (s * s - second[name])
                getattr(model, name)[...] -= RATE * (first[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8)
    return model


def spread(features: np.ndarray, most: int = TRAIN_PASSAGES) -> np.ndarray:
    """At most so many passages, evenly spaced."""
    if len(features) <= most:
        return features
    return features[np.linspace(0, len(features) - 1, most).round().astype(int)]


def fitted(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str) -> Model:
    """The model, fitted by one task on a bounded sample of labelled documents.

    Of each label, TRAIN_DOCUMENTS distinct texts are drawn by their hash, so copies have one
    voice (their labels' mean) and cannot fill the sample; of each, TRAIN_PASSAGES passages.
    Only keys and hashes are shuffled to draw them. Each label counts as often as it occurs
    among all distinct labelled texts.
    """
    marks = labels.where(col(label).isin(0, 1)).groupBy(col(key).alias("__key")).agg(
        F.avg(col(label)).alias("label"))
    hashes = docs.select(col(key).alias("__key"), F.xxhash64(
        F.coalesce(col(text), F.lit(""))).alias("hash"))
    rows = stored(hashes.join(marks, "__key").groupBy("hash").agg(
        F.avg("label").alias("target"), F.min("__key").alias("__key")))
    sides = []
    for side in (rows.where("target < 0.5"), rows.where("target >= 0.5")):
        n, drawn = least_hashed(side, "hash", TRAIN_DOCUMENTS)
        sides.append(drawn.withColumn("cost", F.lit(n / max(1, min(n, TRAIN_DOCUMENTS)))))
    drawn = stored(sides[0].union(sides[1]))  # at most twice TRAIN_DOCUMENTS rows of 32 bytes
    body = F.coalesce(col(text), F.lit(""))
    chosen = docs.select(col(key).alias("__key"), F.xxhash64(body).alias("hash"),
                         body.alias("text")).join(F.broadcast(drawn), ["__key", "hash"])
    coded = stored(map_texts(chosen, lambda texts: {"bag": [
        spread(passages(t)).ravel() for t in texts]}, "bag array<float>",
        ("hash", "target", "cost")))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows that repeat a key and text whole are one.
        parts = list(batches)
        if not parts:
            return
        sample = pd.concat(parts).drop_duplicates("hash").sort_values("hash")
        bags = [np.asarray(b, np.float32).reshape(-1, WIDTH) for b in sample["bag"]]
        cost = sample["cost"].to_numpy(float)
        model = fit(bags, sample["target"].to_numpy(float), cost / cost.mean())
        yield pd.DataFrame({"name": list(model._fields),
                            "shape": [list(v.shape) for v in model],
                            "weights": [v.astype(float).ravel() for v in model]})

    found = stored(coded.coalesce(1).mapInPandas(
        train, "name string, shape array<int>, weights array<double>")).collect()
    if not found:
        return fit([], np.zeros(0), np.zeros(0))
    return Model(**{r["name"]: np.array(r.weights).reshape(r.shape) for r in found})


def scored(texts: list[str], model: Model) -> dict[str, Sequence]:
    bags = [passages(t) for t in texts]
    if not bags:
        return {"score": [], "n_passages": [], "top_passage": []}
    scores, weights = bag_scores(model, bags)
    sizes = np.array([len(b) for b in bags])
    ends = np.cumsum(sizes)
    top = [int(weights[e - s:e].argmax()) for s, e in zip(sizes, ends, strict=True)]
    return {"score": scores, "n_passages": sizes, "top_passage": top}


def attention_quality(docs: DataFrame, labels: DataFrame, label: str = "quality",
                      text: str = "text", key: str = "doc_id", learn: Column | None = None,
                      keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``score``, ``predicted``, ``n_passages`` and ``top_passage``
    (the passage of the greatest attention weight, from 0) of every whole text.

    A text is a bag of passages. Every passage is encoded; gated attention, learned from the
    labels of whole documents, weighs the passages; the weighted code gives the score, the
    chance that the label is 1. ``learn`` limits the documents learned from. One bounded task
    fits the weights; scoring is one pass without a shuffle, texts whole.

    NULL and empty texts are one passage of zeros and get a score like any other. Labels other
    than 0 and 1, and those of no document, teach nothing; several labels of one text count by
    their mean. Without any label every score is 0.5. Repeated rows get the same answer each,
    an empty table gives no rows, extra columns are left out unless kept.
    """
    model = fitted(docs if learn is None else docs.where(learn), labels, label, text, key)
    rows = map_texts(docs, lambda texts: scored(texts, model),
                     "score double, n_passages long, top_passage long", keep, text)
    return rows.select(*[col(c) for c in keep], "score", (F.col("score") >= LEAST_SCORE).cast(
        "int").alias("predicted"), "n_passages", "top_passage")


def op13_attention_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score and prediction of every document; a fifth of the labels is never learned from.

    A document without an id is never held out, as it has no label.
    """
    docs = read(spark, folder, "documents")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    scores = attention_quality(docs, read(spark, folder, "labels"), learn=~out)
    return scores.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score",
                         "predicted", "n_passages", "top_passage")
