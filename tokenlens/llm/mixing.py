"""Operator 2: mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic), where values without a target of their
own count as ``*``: the number of cells follows the targets, not the corpus. Raking scales the cells
until every margin meets its targets, never beyond what a cell holds; the ratio of raked to present
tokens is the probability with which a cell's documents are drawn. The draw is a hash of the id, so
it repeats exactly and needs no state. The mixture takes ``total_share`` of all tokens; a value that
holds fewer than its target is taken whole, and what it lacks goes to the others of its margin. No
cell's probability is under ``LEAST``, so margins that contradict each other don't empty a cell.

The share of ``*`` is the observed one, targets of listed values share the rest, and values that
hold no tokens pass their target to the others. Without a topic column, a text's topic is the
largest of ``FAMILIES`` hashed families of its words of five bytes or more.

Two scans without any shuffle but the cell sums, which are added up map-side: a source that holds a
third of all rows is one row per task.

Null source or language is ``*``; null or empty texts hold no tokens and have topic ``*``; documents
in a cell without tokens are drawn with the mixture's overall share; rows that repeat an id are
drawn alike; a null id is an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .textgrams import blocks, mixed, word_hashes, words

FAMILIES, LONG_WORD = 8, 5
TOTAL_SHARE, LEAST = 0.7, 0.1
REST = "*"


class Targets(NamedTuple):
    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]

    def categories(self) -> list[list[str]]:
        return [[*margin, REST] for margin in self]


#: The query's mixture: the hot source at a fifth, the other sources alike, topics alike.
PRODUCTION = Targets({"src0": 0.2} | {f"src{i}": 0.8 / 19 for i in range(1, 20)},
                     {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11},
                     {f"t{i}": 1 / FAMILIES for i in range(FAMILIES)})


def topics_and_tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its topic's number (FAMILIES for none) and number of words."""
    topics, tokens = [], []
    for block in blocks(column):
        w = words(block)
        h = word_hashes(block, w)
        long = w.end - w.start >= LONG_WORD
        family = (h[long] >> np.uint64(32)) % np.uint64(FAMILIES)
        n = len(w.counts)
        table = np.bincount(w.document[long] * FAMILIES + family.astype(np.int64), minlength=n * FAMILIES).reshape(n, FAMILIES)
        topics.append(np.where(table.sum(1) > 0, table.argmax(1), FAMILIES))
        tokens.append(w.counts)
    return (np.concatenate(topics), np.concatenate(tokens)) if topics else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def draws(ids: pa.Array, seed: int) -> np.ndarray:
    """A uniform number in [0, 1) for each id, from a hash of it."""
    x = ids.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).view(np.uint64)
    return (mixed(mixed(x + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed)) >> np.uint64(11)) / float(1 << 53)


def cell_codes(batch: pa.RecordBatch, names: list[str], targets: Targets) -> tuple[np.ndarray, np.ndarray]:
    """Cell number and tokens of each row. names: the id, text, source and language columns."""
    topic, tokens = topics_and_tokens(batch.column(names[1]))
    code = np.zeros(len(topic), np.int64)
    for name, margin, values in zip(("source", "lang"), targets[:2], (names[2], names[3])):
        index = {v: i for i, v in enumerate(margin)}
        code = code * (len(margin) + 1) + np.array([index.get(v, len(margin)) for v in batch.column(values).to_pylist()], np.int64)
    index = {f"t{i}": i for i in range(FAMILIES)}
    place = np.array([list(targets.topic).index(t) if t in targets.topic else len(targets.topic) for t in index] + [len(targets.topic)])
    return code * (len(targets.topic) + 1) + place[topic], tokens


def shares(margin: dict[str, float], held: np.ndarray) -> np.ndarray:
    """Target shares of the margin's values and ``*``, given the tokens that each holds."""
    wanted = np.array([*margin.values(), 0.0]) * (held > 0)
    rest = held[-1] / held.sum() if held.sum() else 0.0
    if not wanted.sum():
        return held / max(held.sum(), 1)
    out = wanted / wanted.sum() * (1 - rest)
    out[-1] = rest
    return out


def fillable(share: np.ndarray, held: np.ndarray, total: float) -> np.ndarray:
    """Tokens by value for ``total`` in all: its share, or all that it holds where that is less."""
    goal, whole = share * total, np.zeros(len(share), bool)
    while (over := ~whole & (goal > held)).any():
        whole |= over
        rest = share[~whole].sum()
        goal = np.where(whole, held, share / rest * (total - held[whole].sum()) if rest else 0.0)
    return goal


def rake(held: np.ndarray, targets: Targets, total_share: float = TOTAL_SHARE, sweeps: int = 500, tolerance: float = 1e-6) -> np.ndarray:
    """Tokens of each cell in the mixture: margins at their targets, no cell above what it holds
    or below LEAST of it."""
    present = held.sum()
    if not present:
        return held
    goals = []
    for axis, margin in enumerate(targets):
        now = held.sum(tuple(i for i in range(held.ndim) if i != axis))
        goals.append(fillable(shares(margin, now), now, total_share * present))
    got = held * total_share
    for _ in range(sweeps):
        worst = 0.0
        for axis, goal in enumerate(goals):
            others = tuple(i for i in range(held.ndim) if i != axis)
            now = got.sum(others)
            factor = np.divide(goal, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0.0)))
            shape = [1] * held.ndim
            shape[axis] = -1
            got = np.clip(got * factor.reshape(shape), LEAST * held, held)
        if worst < tolerance:
            break
    return got


def probabilities(docs: DataFrame, targets: Targets, names: list[str], total_share: float) -> np.ndarray:
    """The probability of each cell, from one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = int(np.prod([len(c) for c in targets.categories()]))
        total = np.zeros(n)
        for batch in batches:
            code, tokens = cell_codes(batch, names, targets)
            total += np.bincount(code, tokens, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], names=["cell", "tokens"])

    rows = docs.select(*names).mapInArrow(run, "cell long, tokens double").groupBy("cell").sum("tokens").collect()  # a row per cell
    shape = [len(c) for c in targets.categories()]
    held = np.zeros(int(np.prod(shape)))
    for cell, tokens in rows:
        held[cell] = tokens
    got = rake(held.reshape(shape), targets, total_share).ravel()
    overall = got.sum() / held.sum() if held.sum() else 1.0
    return np.divide(got, held, out=np.full(len(held), overall), where=held > 0)


def weigh(docs: DataFrame, targets: Targets = PRODUCTION, total_share: float = TOTAL_SHARE, seed: int = 1,
          names: tuple[str, ...] = ("doc_id", "text", "source", "lang")) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and sampled of every row of ``docs``."""
    names = list(names)
    p = probabilities(docs, targets, names, total_share)
    topic_names = np.array([*targets.topic, REST], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, tokens = cell_codes(batch, names, targets)
            chance = p[code]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names[0]).cast(pa.int64()), batch.column(names[2]).cast(pa.string()), batch.column(names[3]).cast(pa.string()),
                 pa.array(topic_names[code % len(topic_names)], pa.string()), pa.array(tokens, pa.int64()), pa.array(chance, pa.float64()),
                 pa.array(draws(batch.column(names[0]), seed) < chance)],
                names=["doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled"])

    return docs.select(*names).mapInArrow(
        run, "doc_id long, source string, lang string, topic string, n_tokens long, probability double, sampled boolean")


def sample(docs: DataFrame, targets: Targets = PRODUCTION, total_share: float = TOTAL_SHARE, seed: int = 1,
           names: tuple[str, ...] = ("doc_id", "text", "source", "lang")) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns."""
    names = list(names)
    p = probabilities(docs, targets, names, total_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, _ = cell_codes(batch, names, targets)
            yield batch.filter(pa.array(draws(batch.column(names[0]), seed) < p[code]))

    return docs.mapInArrow(run, docs.schema)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(documents(spark, sf_dir))
