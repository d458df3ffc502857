"""Operators 3 and 4 against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tokenlens.llm import jaccard_join, repeats
from tokenlens.llm.common import LAST_ID, Scratch
from tokenlens.llm.components import connected_components

from . import messy


def expected_components(rows):
    sets = []
    for r in rows:
        w = messy.words(messy.lower(r[1] or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                lead[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    return sorted(((r[0], len(sets[i]), min(ids[find(i)], key=messy.order)) for i, r in enumerate(rows)), key=repr)


def near_copies(n, seed=3):
    """Chains of edits, a passage in most texts, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    out, text = [], []
    for i in range(n):
        if i % 9 == 0:
            text = [word() for _ in range(rng.choice([4, 12, 60, 150]))]
        text = list(text)
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(len(text))] = word()
        out.append(" ".join(text + (passage if i % 3 else [])))
    return out


def test_passages_spread_over_many_units_are_common(spark, monkeypatch):
    """A passage that no unit holds more than twice is found in all; copies of a text hold it once."""
    monkeypatch.setattr(jaccard_join, "UNIT", 100)
    passage = " ".join(f"p{i}" for i in range(14))
    texts = [f"{passage} " + " ".join(f"w{k}x{i}" for i in range(40)) for k in range(24)]      # 50 shingles, 2 texts a unit
    copies = ["one text and its copies only " + " ".join(f"c{i}" for i in range(20))] * 30
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string").coalesce(1)
    found = jaccard_join.common_columns(jaccard_join.profiles(docs, 5).where("kind = 1"))
    lead = spark.createDataFrame([(0, passage)], "doc_id long, text string")
    columns = jaccard_join.prefixes(lead, np.zeros(0, np.uint64), 5).collect()[0]
    assert columns.n == len(found) == 10 and set(np.array(columns.prefix).astype(np.uint64)) <= set(found)


@pytest.mark.parametrize("least", [50, 3])
def test_components_of_near_copies(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard_join, "LEAST_COMMON", least)  # 3: most columns are common
    rows = list(enumerate(near_copies(150)))
    out = jaccard_join.jaccard_components(messy.simple(spark, [t for _, t in rows]))
    assert messy.bag(out, "doc_id", "n_shingles", "component_id") == expected_components(rows)


def test_components_of_awkward_rows(spark):
    rows = [r for r in messy.rows() if r[0] is not None and r[1] != "another text under a used id"]
    out = jaccard_join.jaccard_components(messy.docs(spark, rows))
    assert messy.bag(out, "doc_id", "n_shingles", "component_id") == expected_components(rows)
    assert jaccard_join.jaccard_components(messy.docs(spark)).count() == len(messy.rows())  # null and reused ids
    kept = jaccard_join.keep_one(messy.docs(spark, rows))
    assert kept.columns == messy.docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in expected_components(rows)})


def expected_kept(rows):
    """(doc_id, text) choices of each component: one of its rows of the smallest id stays."""
    n, texts = len(rows), [messy.words(messy.lower(r[1] or "")) for r in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    held = defaultdict(list)
    for i, r in enumerate(rows):
        held[group[i]].append((r[0], r[1]))
    least = {g: min((d for d, _ in rs), key=messy.order) for g, rs in held.items()}
    return [{(d, t) for d, t in rs if d == least[g]} for g, rs in held.items()]


def test_components_of_shared_and_missing_ids(spark):
    """Texts that share an id, or have none, are vertices of their own."""
    near = near_copies(30, 11)
    rows = [r[:2] for r in messy.rows()] + list(enumerate(near[:15], 1000)) + [(None, t) for t in near[15:]]
    rows += [(7, near[0] + " end"), (1001, near[29]), (None, near[3]), (None, near[20]), (None, " "), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard_join.jaccard_components(frame)
    got = sorted(((None if d == LAST_ID else d, n, None if c == LAST_ID else c) for d, n, c in out.select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == expected_components(rows)
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(frame).collect())
    wanted = expected_kept(rows)
    assert sum(kept.values()) == len(wanted)
    for choices in wanted:
        assert any(kept[c] for c in choices)
    assert all(any(k in choices for choices in wanted) for k in kept)


def test_connected_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 400)] + [(500, 500), (90, 39), (90, 39)]
    rng = random.Random(1)
    names = list(range(501))
    rng.shuffle(names)
    frame = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = {r.vertex: r.component for r in connected_components(frame, Scratch(spark, "test-components")).collect()}
    chain, hub = [names[i] for i in [*range(41), 90]], [names[i] for i in range(100, 400)]
    assert got == {v: min(chain) for v in chain} | {v: min(hub) for v in hub}


def test_repeats_inside_collections():
    rng = np.random.default_rng(5)
    for _ in range(60):
        length, m = int(rng.integers(1, 6)), int(rng.integers(1, 12))
        pieces = [bytes(rng.integers(97, 99, int(rng.integers(0, 14))).astype(np.uint8)) for _ in range(m)]
        pieces[0] += b"\xff\x00a"
        groups, weights, columns = rng.integers(0, 3, m), rng.integers(1, 3, m), rng.integers(-2, 1, m)
        held = Counter()
        for p, g, w, c in zip(pieces, groups, weights, columns):
            for i in range(len(p) - length + 1):
                held[g, c + i, p[i:i + length]] += w
        wanted = [[i for i in range(len(p) - length + 1) if held[g, c + i, p[i:i + length]] > 1] for p, g, c in zip(pieces, groups, columns)]
        got = repeats.repeated_in_collection(pieces, groups, weights, columns, length)
        assert [x.tolist() for x in got] == wanted


def expected_removed(rows, length):
    held, texts = Counter(), [(r[0], (r[1] or "").encode()) for r in rows]
    for _, t in texts:
        for i in range(len(t) - length + 1):
            held[t[i:i + length]] += 1
    out = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if held[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, anchor, group", [(200, 48, 256), (40, 12, 3)])
def test_repeated_strings(spark, length, anchor, group):
    texts = near_copies(60) + ["ab" * 150, "x" * 300, "", "short"] + ["shared " * 9 + t for t in near_copies(20, 8)]
    out = repeats.remove_repeats(messy.simple(spark, texts), length, anchor, group)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in out.collect()), key=repr)
    assert got == expected_removed(list(enumerate(texts)), length)


def test_repeated_strings_of_awkward_rows(spark):
    out = repeats.remove_repeats(messy.docs(spark))
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in out.collect()), key=repr)
    assert got == expected_removed(messy.rows(), 200)


def test_empty_tables(spark):
    assert jaccard_join.jaccard_components(messy.empty(spark)).count() == 0
    assert jaccard_join.keep_one(messy.empty(spark)).count() == 0
    assert repeats.remove_repeats(messy.empty(spark)).count() == 0
