"""Operators 5, 8, 9 and 10 against brute force on awkward rows."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tokenlens.llm import chat_format, exact_dedup, line_dedup, line_frequency

from . import messy


def expected_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(messy.WS, " ", r[1] or "")].append(r[0])
    out = []
    for r in rows:
        t = re.sub(messy.WS, " ", r[1] or "")
        keep = min(groups[t], key=messy.order)
        out.append((r[0], keep, len(groups[t]), r[0] == keep, messy.sha(t)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("capacity, key", [(512, exact_dedup.text_key), (2, exact_dedup.text_key),
                                           (2, lambda t: F.shiftleft(F.crc32(t) % 3, 60)), (1, lambda t: F.lit(5))])
def test_exact_dedup(spark, capacity, key):
    out = exact_dedup.deduplicate(messy.docs(spark), capacity, 6, key)
    assert messy.bag(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected_exact(messy.rows())
    assert messy.is_native(out)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    kept = exact_dedup.keep_first(messy.docs(spark))
    assert kept.columns == messy.docs(spark).columns
    got = Counter(re.sub(messy.WS, " ", r.text or "") for r in kept.collect())
    wanted = {re.sub(messy.WS, " ", r[1] or "") for r in messy.rows()}
    lost = wanted - set(got)
    assert lost <= {re.sub(messy.WS, " ", messy.rows()[7][1]), "another text under a used id"}  # two texts of one id: one row stays
    assert max(got.values()) == 1


@pytest.mark.parametrize("key", [exact_dedup.text_key, lambda t: F.shiftleft(F.crc32(t) % 3, 60), lambda t: F.lit(5)])
def test_exact_dedup_loses_no_text_of_a_shared_id(spark, key):
    """Null ids and reused ids: every text stays once, under the smallest id that it has."""
    data = [r[:2] for r in messy.rows()] + [(None, f"text {i % 5} without an id") for i in range(9)] + [(7, "one"), (2 ** 63 - 1, "one two")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    kept = exact_dedup.keep_first(frame, 2, 6, key).collect()
    wanted = {(keep, sha) for _, keep, _, _, sha in expected_exact(data)}
    assert sorted(((r.doc_id, messy.sha(re.sub(messy.WS, " ", r.text or ""))) for r in kept), key=repr) == sorted(wanted, key=repr)


def test_directory_doubles_only_where_full():
    directory = dict(exact_dedup.grow_directory({0: 10, 1: 10, 8: 1, 15: 1}, 5, 4))
    assert directory[0] != directory[1] and directory[8] == directory[15] and len(directory) == 16
    assert len(set(dict(exact_dedup.grow_directory({}, 5, 4)).values())) == 1


def expected_lines(rows, least=10):
    owner = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            key = messy.lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= least:
                owner[key].add(r[0])
    out = []
    for r in rows:
        lines, kept = (r[1] or "").split("\n"), []
        for line in lines:
            ids = owner.get(messy.lower(line.strip(" \t\n\x0b\x0c\r")))
            if not ids or min(ids, key=messy.order) == r[0]:
                kept.append(line)
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (3, 10)])
def test_line_dedup(spark, batches, fanout):
    out = line_dedup.deduplicate_lines(messy.docs(spark), batches, fanout)
    assert messy.bag(out, "doc_id", "n_lines", "n_dropped", "text") == expected_lines(messy.rows())
    assert messy.is_native(out)


def expected_base(text):
    w = messy.words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    places = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if messy.words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(places)


def test_quality_base_counts(spark):
    out = line_frequency.line_rules(messy.docs(spark))
    got = messy.bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    wanted = []
    for r in messy.rows():
        b = expected_base(r[1])
        wanted.append((r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(wanted, key=repr)
    assert messy.is_native(out)


def test_frequent_lines_deplete(spark):
    body = [" ".join(f"w{i}q{k}" for k in range(60)) for i in range(40)]
    shared = " ".join(f"shared{k}" for k in range(70))
    data = [(i, f"{shared}\n{b}" if i < 30 else b, "a" if i < 35 else "b") for i, b in enumerate(body)]
    data += [(100, shared, "b"), (101, shared + "\n" + shared + "\n" + body[0], "a")]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept, r.n_removed_words) for r in line_frequency.line_rules(frame, min_documents=5, max_share=0.5, min_left=0.4).collect()}
    assert got[0] == (True, 70) and got[34] == (True, 0) and got[101] == (False, 140)
    assert got[100] == (True, 0)  # the line is rare on its host


def test_chat_round_trip(spark):
    probe = "\\o \\b \\\\ <s> [/INST] </s>\nassistant\n"
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", probe), (1, 2, "user", None), (1, 3, "assistant", "bye"), (1, 4, "user", "trailing"),
            (2, 0, None, ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 5, "tool\nkind", "[y]"), (4, None, "assistant", "é" * 3000)]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat_format.expand(frame)
    assert examples.count() == 3 + 1 + 2 + 1 + 1
    for r in examples.collect():
        inside = r.formatted[r.loss_start:r.loss_start + r.loss_length]
        assert not re.search(r"[<\[]", inside)
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    convs = defaultdict(list)
    for c, t, role, text in data:
        convs[c].append(((t is not None, t), role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), messy.sha("".join(f"{a}\n{t}\n" for _, a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), messy.sha(loss))


def test_empty_tables(spark):
    none = messy.empty(spark)
    assert exact_dedup.deduplicate(none).count() == 0 and exact_dedup.keep_first(none).count() == 0
    assert line_dedup.deduplicate_lines(none).count() == 0
    assert line_frequency.line_rules(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.expand(turns)).count() == 0
