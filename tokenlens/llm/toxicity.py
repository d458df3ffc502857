"""Operator 1: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled sample is drawn from all training rows,
toxic ones among them, and its labels are never looked at. With class prior p (the share of toxic
rows among the labelled training rows) a linear model over hashed words and word beginnings
minimises the non-negative risk

    p * E_pos[loss(+)] + max(0, E_unlabelled[loss(-)] - p * E_pos[loss(-)])

with logistic loss: where the corrected negative risk of a batch falls below zero, its gradient is
followed upwards instead, so the model can't fit the unlabelled texts as all negative.

The training sample is bounded: ``max_positives`` and ``max_unlabelled`` labelled rows, the first in
hash order. ``n_models`` tasks train one model each, leaving out a different part of the sample;
logits are averaged.
Scoring is one scan without a shuffle; a task holds one block of texts at a time.

Only rows of the training folds (crc32 of the id as text, modulo 3, other than 1) give labels, and
texts are the only input of a score. Null or empty texts get the score of no evidence; rows that
repeat an id get the same verdict for the same text; several labels of one id count as toxic if any
is; null labels and ids train nothing; without positives or other rows every score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import documents
from .textgrams import TO_LOWER, Block, blocks, mixed, prefix_hash, span_hash

BITS = 18
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
#: Letters, digits and all bytes of non-ASCII characters make words here.
IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts): the distinct hashed features of each document, one after the other."""
    data = TO_LOWER[block.data]
    inside, n = IN_WORD[data], len(data)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(start, block.offsets))
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    c = prefix_hash(data)
    parts = [(span_hash(c, start, end) >> np.uint64(64 - BITS), doc)]
    for k in BEGINNINGS:
        long = end - start > k
        h = mixed(span_hash(c, start[long], start[long] + k) + np.uint64(k))
        parts.append((h >> np.uint64(64 - BITS), doc[long]))
    both = np.unique(np.concatenate([(d << np.uint64(BITS)) | slot for slot, d in parts]))
    per_doc = np.diff(np.searchsorted(both, np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(BITS)))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int32), per_doc


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each document's values."""
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return c[ends] - c[ends - counts]


def evidence(weights: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return summed(weights[slots], counts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(pos: list[np.ndarray], unl: list[np.ndarray], least_z: float) -> np.ndarray:
    """Which features occur in clearly more or clearly fewer of the positives than of the rest."""
    p, u = (np.bincount(np.concatenate(x), minlength=1 << BITS) / len(x) for x in (pos, unl))
    both = (p * len(pos) + u * len(unl) + 1) / (len(pos) + len(unl) + 2)
    return np.abs(p - u) / np.sqrt(both * (1 - both) * (1 / len(pos) + 1 / len(unl))) > least_z


def train_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, epochs: int = 60, batch: int = 512,
               rate: float = 0.5, decay: float = 1e-4, least_z: float = 4.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear model over the telling features, by Adagrad on the
    non-negative risk."""
    w, g2, bias, b2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), log_odds(prior), 1e-8
    if not pos or not unl:
        return w, bias
    keep = telling(pos, unl, least_z)
    pos, unl = [x[keep[x]] for x in pos], [x[keep[x]] for x in unl]
    rng = np.random.default_rng(seed)
    per_pos = max(1, batch * len(pos) // (len(pos) + len(unl)))
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k, at in enumerate(range(0, len(unl), batch)):
            chosen_p = p_order[np.arange(k * per_pos, (k + 1) * per_pos) % len(pos)]
            chosen = [pos[i] for i in chosen_p] + [unl[i] for i in u_order[at:at + batch]]
            n_p, n_u = len(chosen_p), len(chosen) - len(chosen_p)
            slots, counts = np.concatenate(chosen), np.array([len(x) for x in chosen])
            z = evidence(w, slots, counts) + bias
            clean = np.logaddexp(0, z)  # loss of calling it clean
            s = sigmoid(z)
            d_clean = np.concatenate([-prior * s[:n_p] / n_p, s[n_p:] / n_u])
            if clean[n_p:].mean() >= prior * clean[:n_p].mean():
                d = d_clean.copy()
                d[:n_p] += prior * (s[:n_p] - 1) / n_p
            else:
                d = -d_clean
            touched, back = np.unique(slots, return_inverse=True)
            g = np.bincount(back, np.repeat(d, counts), len(touched)) + decay * w[touched]
            g2[touched] += g * g
            w[touched] -= rate * g / np.sqrt(g2[touched])
            b2 += d.sum() ** 2
            bias -= rate * d.sum() / np.sqrt(b2)
    scores = [evidence(w, np.concatenate(x), np.array([len(k) for k in x])) for x in (pos, unl)]
    return w, log_odds(THRESHOLD) - best_cut(*scores, prior)


def best_cut(pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """The middle of the widest gap with the least non-negative zero-one risk, estimated like the loss:
    missed positives plus what the unlabelled texts above the cut hold beyond the positives."""
    cuts = np.unique(np.concatenate([pos, unl]))
    missed = np.searchsorted(np.sort(pos), cuts, "right") / len(pos)
    above = 1 - np.searchsorted(np.sort(unl), cuts, "right") / len(unl)
    risk = prior * missed + np.maximum(0, above - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    gap = np.append(np.diff(cuts), 2.0)  # above the largest score nothing is toxic
    widest = best[gap[best].argmax()]
    return float(cuts[widest] + gap[widest] / 2)


def log_odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


class Model:
    """Average of the linear models."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, block: Block) -> np.ndarray:
        slots, counts = features(block)
        return sigmoid(evidence(self.weights, slots, counts) + self.bias)


def training_sample(labels: DataFrame, max_positives: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(doc_id, positive, unlabelled) of the bounded sample, and the class prior."""
    rows = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id")]
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    pos = rows.where("toxic = 1").orderBy(*order).limit(max_positives).select("doc_id", F.lit(1).alias("positive"), F.lit(0).alias("unlabelled"))
    unl = rows.orderBy(*order).limit(max_unlabelled).select("doc_id", F.lit(0).alias("positive"), F.lit(1).alias("unlabelled"))
    sample = pos.unionByName(unl).groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    return sample, min(max(toxic / total if total else 0.5, 1e-3), 0.5)


def train(docs: DataFrame, labels: DataFrame, max_positives: int = 4000, max_unlabelled: int = 8000, n_models: int = 4) -> Model:
    sample, prior = training_sample(labels, max_positives, max_unlabelled)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                slots, counts = features(block)
                cuts = np.cumsum(counts)[:-1]
                rows = batch.slice(block.first, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), rows.column(3), pa.array([x.tobytes() for x in np.split(slots, cuts)], pa.binary())],
                    names=["doc_id", "positive", "unlabelled", "slots"])

    found = texts.select("doc_id", "text", "positive", "unlabelled").mapInArrow(
        extract, "doc_id long, positive int, unlabelled int, slots binary")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "slots"])
        held = [np.frombuffer(x, np.int32) for x in rows["slots"]]
        pos = [x for x, p in zip(held, rows["positive"]) if p]
        unl = [x for x, u in zip(held, rows["unlabelled"]) if u]
        w, bias = train_nnpu(pos, unl, prior)
        return pd.DataFrame({"weights": [w.astype(np.float32).tobytes()], "bias": [bias]})

    own = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(n_models))
    others = F.filter(F.sequence(F.lit(0), F.lit(n_models - 1)), lambda k: (k != own) | (F.lit(n_models) == 1))
    shards = found.withColumn("shard", F.explode(others))
    models = shards.groupBy("shard").applyInPandas(fit, "weights binary, bias double").collect()  # n_models rows
    if not models:
        return Model(np.zeros(1 << BITS), log_odds(prior))
    return Model(np.mean([np.frombuffer(m[0], np.float32) for m in models], axis=0), float(np.mean([m[1] for m in models])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                scores = model.score(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(scores)), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    schema, text_at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_at)):
                scores = model.score(block)
                yield batch.slice(block.first, len(scores)).filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
