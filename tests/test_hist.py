from tokenlens.operators import hist


def _labelled(spark):
    return spark.createDataFrame([
        ("a", 0, 0, 0, 1), ("a", 0, 0, 1, 1), ("a", 0, 2, 0, 5),
        ("b", 1, 0, 3, 0), ("b", 1, 96, 0, 0),
    ], "label string, label_ord int, shard int, sample_index int, token_offset int")


def test_shard_histogram_zero_fills(spark):
    h = {r.shard: r.n_hits for r in hist.shard_histogram(_labelled(spark), 97).collect()}
    assert len(h) == 97 and h[0] == 3 and h[2] == 1 and h[96] == 1 and h[50] == 0


def test_stacked_bases_follow_label_order(spark):
    st = {(r.label, r.shard): (r.n_hits, r.bottom) for r in hist.stacked_histogram(_labelled(spark), 97).collect()}
    assert len(st) == 2 * 97
    assert st[("a", 0)] == (2, 0) and st[("b", 0)] == (1, 2)
    assert st[("a", 96)] == (0, 0) and st[("b", 96)] == (1, 0)


def test_totals_and_headroom(spark):
    lab = _labelled(spark)
    tot = {r.label: r.n_hits for r in hist.hit_totals(lab).collect()}
    assert tot == {"a": 3, "b": 2, None: 5}
    hr = hist.stack_headroom(hist.stacked_histogram(lab, 97)).first()
    assert hr.max_height == 3 and abs(hr.y_limit - 3 * 1.15) < 1e-12
    empty = spark.createDataFrame([], lab.schema)
    assert hist.stack_headroom(hist.stacked_histogram(empty, 95)).first().max_height == 0
    assert hist.shard_count(None) == 95
