"""Operators 1, 2, 6 and 7, and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenlens.llm import mixing, packing, toxicity, warc

from . import messy

BAD = ["fooey", "barfly", "bazooka"]


def labelled(spark, n=900, seed=2):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = [rng.choice(names) for _ in range(rng.choice([20, 60, 200]))]
        if toxic:
            for w in rng.sample(BAD, 2):
                text.insert(rng.randrange(len(text)), w + rng.choice(["", ".", "s"]))
        texts.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def test_toxicity_finds_held_out_texts_and_never_sees_their_labels(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if fold(r.doc_id) == 1]
    assert np.mean([(s >= toxicity.THRESHOLD) == bool(t) for s, t in held]) > 0.95
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, turned)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < toxicity.THRESHOLD}


def test_toxicity_of_awkward_rows(spark):
    docs = messy.docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (4, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(messy.rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    none = toxicity.train(messy.empty(spark), labels.limit(0))
    assert toxicity.score(messy.empty(spark), none).count() == 0


def test_non_negative_risk_learns_from_positives_and_unlabelled_only():
    rng = np.random.default_rng(0)
    pos = [np.unique(np.append(rng.integers(100, 400, 20), [1, 2])).astype(np.int32) for _ in range(200)]
    unl = [np.unique(rng.integers(100, 400, 20)).astype(np.int32) for _ in range(450)] + pos[:50]
    w, bias = toxicity.train_nnpu(pos[50:], unl, 0.1)
    score = lambda rows: toxicity.sigmoid(toxicity.evidence(w, np.concatenate(rows), np.array([len(r) for r in rows])) + bias)
    assert (score(pos[:50]) >= 0.7).all() and (score(unl[:450]) < 0.7).all()


def test_raking_meets_margins():
    rng = np.random.default_rng(4)
    held = rng.integers(0, 1000, (4, 3, 5)).astype(float) * 100
    targets = mixing.Targets({"a": .5, "b": .3, "c": .2}, {"x": .6, "y": .4}, {f"t{i}": .25 for i in range(4)})
    got = mixing.rake(held, targets, 0.3)
    assert (got <= held + 1e-6).all()
    for axis, margin in enumerate(targets):
        others = tuple(i for i in range(3) if i != axis)
        assert np.allclose(got.sum(others) / got.sum(), mixing.shares(margin, held.sum(others)), atol=2e-3)
    held[0] *= 0.01  # too little for its target: taken whole, the others make up for it
    got = mixing.rake(held, targets, 0.5)
    assert (got <= held + 1e-6).all() and np.isclose(got[0].sum(), held[0].sum(), rtol=1e-2)
    assert np.isclose(got[1].sum() / got[2].sum(), 1.5, rtol=1e-2) and np.isclose(got.sum() / held.sum(), 0.5, rtol=1e-2)
    assert not mixing.rake(np.zeros((2, 2, 2)), mixing.Targets({"a": 1}, {"x": 1}, {"t0": 1})).any()


def test_mixing_draws(spark):
    docs = messy.docs(spark)
    rows = mixing.weigh(docs).collect()
    assert len(rows) == len(messy.rows())
    n = {r[0]: len(messy.words(r[1])) for r in messy.rows() if r[0] not in (7, None)}
    assert all(r.n_tokens == n[r.doc_id] for r in rows if r.doc_id in n)
    ids = np.array([r.doc_id for r in rows if r.doc_id is not None])
    drawn = mixing.draws(pa.array(ids), 1)
    assert [bool(x) for x in drawn < np.array([r.probability for r in rows if r.doc_id is not None])] == [r.sampled for r in rows if r.doc_id is not None]
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.sampled for r in rows)
    assert mixing.weigh(messy.empty(spark)).count() == 0
    assert 0.45 < mixing.draws(pa.array(np.arange(20000)), 3).mean() < 0.55


HTML = """<!DOCTYPE html><html lang="de-DE"><head><title>A &amp; B</title><script>x("<p>no</p>")</script></head><body><!-- <p>no</p> -->
<p>One&nbsp;<b>two</b> &lt;three&gt;<br>four</p><a href="/x?a=1&amp;b=2">L</a><a href='http://o.example/y'>M</a><a href="/x?a=1&amp;b=2">again</a>"""


def parse_warc(data):
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4:]
    return out


def test_warc_records_link_back(spark):
    pages = spark.createDataFrame([(1, "http://h.example/d/p", HTML), (2, None, None), (3, "u\r\nX: y", "<script>open <p>never"), (3, "http://[", '<a href="//["></a>')],
                                  "page_id long, url string, html string").withColumn("record", F.lit(1))
    sources = {r.record_id: r for r in warc.responses(pages).collect()}
    records = warc.derive(warc.responses(pages))
    assert records.count() == 8
    parsed = parse_warc(b"".join(bytes(r.record) for r in warc.serialised(records).collect()))
    by_type = defaultdict(dict)
    for fields, block in parsed:
        source = sources[fields["WARC-Refers-To"]]
        assert fields["WARC-Target-URI"] == source.target_uri and fields["WARC-Refers-To-Date"] == source.warc_date
        assert fields["WARC-Source-Payload-Digest"] == warc.digest(bytes(source.body)) and fields["WARC-Block-Digest"] == warc.digest(block)
        assert fields["WARC-Source-Content-Type"] == "text/html; charset=utf-8"
        by_type[fields["WARC-Refers-To"]][fields["WARC-Type"]] = (fields, block)
    for kinds in by_type.values():
        assert kinds["metadata"][0]["WARC-Concurrent-To"] == kinds["conversion"][0]["WARC-Record-ID"]
    first = next(k for k, s in sources.items() if s.page_id == 1)
    assert by_type[first]["conversion"][1].decode() == "A & B\nOne two <three>\nfour\nLMagain\n"
    meta = by_type[first]["metadata"][1].decode().split("\r\n")
    assert meta[0] == "title: A & B" and meta[1] == "language: de-de"
    assert [m for m in meta if m.startswith("outlink")] == ["outlink: http://h.example/x?a=1&b=2", "outlink: http://o.example/y"]
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.word_bpe_path())


def test_word_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(6)
    alphabet = "ab cdE.,'’ \t\n1²½é́ĳİΣςß東京Ⅷ<|>-_\x1c\xa0 ﬁ한각"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|endoftext|>. <|ENDOFTEXT|>", "don't we've o'clock. x.. .y a.b,", "J̌a É é"]
    encoder = packing.WordEncoder(tokenizer, keep=500)  # several generations
    for at in range(0, len(texts), 100):
        got = encoder.block([t.encode() for t in texts[at:at + 100]])
        for text, ids in zip(texts[at:at + 100], got):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, tokenizer):
    rows = packing.pack_documents(messy.docs(spark)).collect()
    wanted = []
    for r in messy.rows():
        ids = ids_of(tokenizer, r[1])
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k:k + 2048], "<u4")
            wanted.append((r[0], k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(wanted, key=repr)
    check_bins(rows, 2048)
    assert packing.pack_documents(messy.empty(spark)).count() == 0


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_best_two_fit_beats_the_greedy_fill():
    assert packing.plan_bins({6: 1, 4: 1, 5: 2}, 10) == [((6, 4), 1), ((5, 5), 1)]
    plan = packing.plan_bins({7: 1, 2: 1, 1: 3}, 10)
    assert sum(bins for _, bins in plan) == 2 or sum(sum(u) * n for u, n in plan) == 12
    # greedy takes 60 + 25; two shorter ones fill the gap of 40 exactly
    assert packing.plan_bins({60: 1, 25: 1, 22: 1, 18: 1}, 100)[0] == ((60, 22, 18), 1)
    rng = np.random.default_rng(1)
    counts = {int(k): int(rng.integers(1, 2000)) for k in rng.choice(np.arange(1, 129), 90, replace=False)}
    plan = packing.plan_bins(counts, 128)
    used = defaultdict(int)
    for bin_, n in plan:
        assert sum(bin_) <= 128
        for length in bin_:
            used[length] += n
    least = max(sum(k * v for k, v in counts.items()) / 128, sum(v for k, v in counts.items() if k > 64))
    assert used == counts and sum(n for _, n in plan) <= 1.03 * least


def test_pipeline_against_its_stages_by_hand(spark, tmp_path):
    from tests.llm.test_similar_texts import expected_components, near_copies

    docs, labels = labelled(spark, 240)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    texts[100:150] = near_copies(50)
    texts[150:160] = texts[100:110]
    table = spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"src{i % 4}", len(t)) for i, t in enumerate(texts)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.train(table, labels)
    clean = {r.doc_id for r in toxicity.score(table, model).collect() if r.score < toxicity.THRESHOLD}
    first = {}
    for i in sorted(clean):
        first.setdefault(re.sub(messy.WS, " ", texts[i]), i)
    rows = [(i, texts[i]) for i in sorted(first.values())]
    kept = sorted({c for _, _, c in expected_components(rows)})
    left = table.where(F.col("doc_id").isin(kept))
    drawn = {r.doc_id for r in mixing.weigh(left).collect() if r.sampled}
    assert {r.doc_id for r in got} == drawn and len(got) >= len(drawn) > 0
    check_bins(got, 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]


def test_the_pipeline_keeps_the_columns(spark):
    docs = messy.docs(spark)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, "").columns == docs.columns


def naive_bins(counts, capacity):
    """One bin after the other, by looking at every unpacked length."""
    left, bins = Counter(counts), []
    while left := +left:
        used, gap = [], capacity
        while fits := [k for k in left if left[k] and k <= gap]:
            used.append(max(fits))
            left[used[-1]] -= 1
            gap -= used[-1]
        if gap and len(used) > 1:
            room, best = gap + used[-1], None
            for x in left:
                for y in left:
                    if x >= y and left[x] and left[y] and (x != y or left[x] > 1) and used[-1] < x + y <= room and (best is None or x + y > sum(best)):
                        best = (x, y)
            if best:
                left[used.pop()] += 1
                used += best
                left.subtract(best)
        bins.append(tuple(sorted(used)))
    return bins


def test_planned_bins_are_those_of_the_naive_method():
    rng = np.random.default_rng(4)
    for size, most in ((8, 5), (30, 3), (40, 60)):
        for _ in range(20):
            counts = {int(k): int(rng.integers(1, most)) for k in rng.choice(np.arange(1, 65), size, replace=False)}
            plan, naive = packing.plan_bins(counts, 64), naive_bins(counts, 64)
            assert sum(n for _, n in plan) == len(naive)
            total = Counter()
            for used, n in plan:
                for k in used:
                    total[k] += n
            assert total == Counter(counts) and all(sum(used) <= 64 for used, _ in plan)


def test_other_tokenizers_encode_whole_texts(spark, tokenizer):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert isinstance(packing.encoder(path), packing.PlainEncoder) and isinstance(packing.encoder(packing.word_bpe_path()), packing.WordEncoder)
    other = Tokenizer.from_file(path)
    texts = ["Upper Case words, and***  spaces\n\n x", "", "é" * 50]
    docs = messy.simple(spark, texts)
    out = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs, path).collect()}
    for i, text in enumerate(texts):
        ids = np.array(other.encode(text, add_special_tokens=False).ids + [packing.END_ID], "<u4")
        assert out[i] == zlib.crc32(ids.tobytes())


def test_rows_that_share_an_id_have_their_own_ranks(spark):
    rows = [(1, "one two three"), (1, "three two ones"), (1, "one two three"), (None, "a b c"), (None, "a b d")] * 3
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(rows)
