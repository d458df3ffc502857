"""Operators 11, 12 and 13: held-out accuracy and brute force."""

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest

from tokenlens.llm import language_id, spelling_variants, token_alignment
from tokenlens.llm.common import documents

from . import messy

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------------------------- operator 11
def test_held_out_languages(spark):
    out = language_id.op11_language_id(spark, SF).toPandas()
    langs = {r[0]: r[1] for r in documents(spark, SF).select("doc_id", "lang").collect()}
    assert len(out) == len(langs)
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    held = out[out.held_out & (out.lang_pred != "und")]
    assert np.mean([langs[i] == p for i, p in zip(held.doc_id, held.lang_pred)]) > 0.97
    sure = held[held.accepted]
    assert len(sure) > 0.9 * len(held)
    assert np.mean([langs[i] == p for i, p in zip(sure.doc_id, sure.lang_pred)]) > 0.98
    assert out.score.between(0, 1).all() and set(out.lang_pred) <= {*langs.values(), "und"}


def test_labels_and_ids_are_no_input(spark):
    docs = documents(spark, SF).limit(200)
    d = language_id.train(documents(spark, SF))
    other = docs.selectExpr("doc_id + 7 AS doc_id", "text", "'xx' AS lang")
    a, b = (messy.bag(language_id.classify(x, d), "lang_pred", "score", "margin") for x in (docs, other))
    assert a == b


def test_training_rows_and_bounds(spark):
    rows = [(i, ("der die das " if i % 2 else "the of and ") * 40, "de" if i % 2 else "en") for i in range(60)]
    rows += [(None, "nullo " * 50, "zz"), (3, "kein " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = language_id.train(docs, dictionary=512)
    assert set(d) == {"de", "en"}                      # null ids and langs train nothing
    assert all(len(x) <= 2 * 257 for x in d.values())
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    only_held = docs.where(docs.doc_id.isin(held))
    assert language_id.train(only_held) == {}
    assert set(language_id.train(docs, max_languages=1)) <= {"de", "en"}
    assert {r.lang_pred for r in language_id.classify(docs.limit(5), {}).collect()} == {"und"}


def test_language_of_awkward_texts(spark):
    texts = [None, "", "  12 345 !!", "²", "a", "ÄÖÜ", "the " * 60000, "中文字"]
    docs = messy.simple(spark, texts)
    out = {r.doc_id: r for r in language_id.classify(docs, {"de": b"der die das und nicht ein", "en": b"the of and to in that"}).collect()}
    assert [out[i].lang_pred == "und" for i in range(8)] == [True, True, True, True, False, False, False, False]
    assert out[6].lang_pred == "en" and not out[0].accepted and out[0].score == 0
    one = language_id.classify(docs, {"en": b"the"}).collect()
    assert {r.margin for r in one if r.lang_pred == "en"} == {1.0}
    assert language_id.classify(messy.docs(spark), {"en": b"the"}).count() == len(messy.rows())
    assert language_id.classify(messy.empty(spark), language_id.train(messy.empty(spark))).count() == 0


# ---------------------------------------------------------------------------------- operator 12
def edits_once(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def expected_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = messy.lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    by_length, near = defaultdict(list), defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for w in n:
        for length in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [x for x in by_length[length] if edits_once(w, x)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_by_brute_force(spark):
    rng = np.random.default_rng(5)
    alphabet = list("abcdeéø÷")
    base = ["".join(rng.choice(alphabet, rng.integers(7, 12))) for _ in range(30)]

    def edited(w):
        k, x = int(rng.integers(len(w))), str(rng.choice(alphabet))
        return [w[:k] + w[k + 1:], w[:k] + x + w[k:], w[:k] + x + w[k + 1:], w[:k].upper() + w[k:]][int(rng.integers(4))]

    rows = []
    for i in range(400):
        words = [w if rng.random() < 0.8 else edited(w) if rng.random() < 0.8 else edited(edited(w)) for w in rng.choice(base, 20)]
        rows.append((i if i % 50 else None, "12 ".join(words[:10]) + "\n" + " ".join(words[10:]) + " abcdefg"))
    rows += [(None, None), (9, ""), (9, "repeated repeated repeate"), (10, "w" * 4000 + " " + "w" * 4000)]
    # a chain of forms: 1000 x aaaaaaaa <- 100 x aaaaaaab <- 10 x aaaaaabb <- ...
    rows += [(500 + k, " ".join([w] * c)) for k, (w, c) in enumerate([("qqqqqqqq", 2300), ("qqqqqqqr", 210), ("qqqqqqrr", 19)])]
    out = spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = expected_variants(rows)
    assert messy.bag(out, *NAMES) == expected
    assert any(r[2] == "qqqqqqqq" and r[1] == "qqqqqqqr" for r in expected)
    assert sum(r[4] > 0 for r in expected) > 50


@pytest.mark.parametrize("small", [True, False])
def test_roots_by_both_joins(spark, monkeypatch, small):
    monkeypatch.setattr(spelling_variants, "MAX_BROADCAST", 10 if small else 0)
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("y", "z")], "word string, form string")
    out = spelling_variants.roots(spelling_variants.Scratch(spark, "t"), forms)
    assert messy.bag(out, "word", "root") == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "d"), ("y", "z")]


def test_variants_of_real_and_awkward_tables(spark):
    rows = [(r[0], r[1]) for r in messy.rows()]
    assert messy.bag(spelling_variants.variants(messy.docs(spark)), *NAMES) == expected_variants(rows)
    assert spelling_variants.variants(messy.empty(spark)).count() == 0
    few = documents(spark, "/root/testdata/sf0.001")
    rows = [(r[0], r[1]) for r in few.select("doc_id", "text").collect()]
    assert messy.bag(spelling_variants.variants(few), *NAMES) == expected_variants(rows)


# ---------------------------------------------------------------------------------- operator 13
def expected_alignment(rows):
    """Whole texts, spans by decoded bytes alone, links as all overlapping ranges."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_path, b_path = token_alignment.tokenizer_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in printable}
    code |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        text, x, y = text or "", [], []
        raw = (" " + text).encode()
        if text:
            x = [(i, bytes(code[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
                 for i in b.encode(text) for p in [b.id_to_piece(i)]]
        if b"".join(t for _, t in x) != raw or b"".join(t for _, t in y) != raw:
            x, y = [], []
        ends = [np.cumsum([len(t) for _, t in z]).tolist() for z in (x, y)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for low, high in zip([0, *cuts], cuts):
            sides = [z[bisect_right(e, low):bisect_right(e, high)] for z, e in zip((x, y), ends)]
            groups.append("|".join(",".join(str(i) for i, _ in side) for side in sides))
        links = []
        for (i, t), e in zip(x, ends[0]):
            first = bisect_right(ends[1], e - len(t))
            for k in range(first, len(y)):
                if ends[1][k] - len(y[k][1]) >= e:
                    break
                links.append((i, y[k][0]))
        counts.update(set(links))
        docs.append((doc_id, len(x), len(y), len(groups), links, messy.sha(";".join(groups)) if x else ""))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted(((d, n, m, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), s)
                   for d, n, m, g, links, s in docs), key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
STRINGS = ["", None, " ", "  ", "a", " a", "a ", "\n", "\n\n", "a\n\nb", "a \n b", "x  \n\n\t y\r\n z", "\t\ttab\tafter tab", "don't we'll 's",
           "héllo wörld € 𝄞!  x y\x1cz\x85", "▁", "a▁b", "<|endoftext|> <s> </s> <unk> <0x0A>", "ünḯ é 한국어 日本語テキスト 🙂🙂👩‍👩‍👧",
           "\x00\x01 ctrl", "a" * 500, "é" * 300, " \n" * 50, "));\r\n  {\r\n}", "x　　y 　 z", "    four   three  two one", "end\n ", "end \n", "٣ ४ ５ ½ ²"]


def test_alignment_by_brute_force(spark):
    texts = STRINGS + [f"{x}{y}" for x in STRINGS if x for y in ("word \n", "\n x", "  ") if x]
    rows = list(enumerate(texts)) + [(3, "repeated id"), (None, "null id"), (None, None)]
    out = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *token_alignment.tokenizer_paths())
    assert messy.bag(out, *COLUMNS) == expected_alignment(rows)


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_alignment_of_real_tables(spark, most):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    out = token_alignment.align(docs, *token_alignment.tokenizer_paths(), max_broadcast=most)
    assert messy.bag(out, *COLUMNS) == expected_alignment(rows)


def test_alignment_of_awkward_tables(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in messy.rows()]
    paths = token_alignment.tokenizer_paths()
    assert messy.bag(token_alignment.align(messy.docs(spark), *paths), *COLUMNS) == expected_alignment(rows)
    assert token_alignment.align(messy.empty(spark), *paths).count() == 0


def test_whole_texts_and_forgotten_chunks(monkeypatch):
    own = token_alignment.Aligner(*token_alignment.tokenizer_paths())
    assert own.chunked
    texts = [t for t in STRINGS if t] * 2
    monkeypatch.setattr(token_alignment, "KEEP", 5)
    kept = [token_alignment._row(x)[:5] for x in own.documents(texts)]
    own.chunked = False
    assert kept == [token_alignment._row(x)[:5] for x in own.documents(texts)]
