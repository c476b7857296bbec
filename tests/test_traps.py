"""Hand fixtures, one trap each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparrowlog.config import Dataset
from sparrowlog.functions import columns as C
from sparrowlog.functions.windows import average_rank, ordinal_rank, scaled_rank, zscore
from sparrowlog.operators import beyond, causal, export, features, metrics, ranker, retrieval, splits

H = causal.HOUR


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def strings(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_counts_are_strictly_before_and_inclusive_below(spark):
    t = 100 * H
    ev = spark.createDataFrame([("x", t - 6 * H - 1), ("x", t - 6 * H), ("x", t - 1), ("x", t), ("x", t + 1), (None, t - 1)], "item string, us long")
    probes = spark.createDataFrame([("x", t), ("x", t), ("y", t), (None, t), ("x", None)], "item string, us long")
    got = causal.causal_counts(probes, ev, "item", {"n6": 6.0, "past": None, "n1": 1.0}).collect()
    assert sorted((r.item or "", r.us or 0, r.n6, r.past, r.n1) for r in got) == sorted([("x", t, 2, 3, 1)] * 2 + [("y", t, 0, 0, 0), ("", t, 0, 0, 0), ("x", 0, 0, 0, 0)])


@pytest.mark.parametrize("bucket", [H // 2, 24 * H])
def test_counts_against_a_full_recount(spark, bucket):
    import random

    r = random.Random(7)
    ev = [(r.choice("abc"), r.randrange(60 * H // 10**6) * 10**6) for _ in range(400)]
    probes = [(r.choice("abcd"), x) for _, x in r.sample(ev, 100)] + [("a", 0)]
    got = causal.causal_counts(spark.createDataFrame(probes, "item string, us long"), spark.createDataFrame(ev, "item string, us long"), "item", {"w": 6.0, "past": None}, bucket=bucket).collect()
    assert len(got) == len(probes)
    for p in got:
        assert p.w == sum(k == p.item and p.us - 6 * H <= x < p.us for k, x in ev)
        assert p.past == sum(k == p.item and x < p.us for k, x in ev)
    assert any(0 < p.w < p.past for p in got)


def test_latest_before(spark):
    ev = spark.createDataFrame([("u", 5), ("u", 9)], "user_id string, us long")
    probes = spark.createDataFrame([("u", 9), ("u", 10), ("u", 5), ("v", 7)], "user_id string, us long")
    assert sorted((r.user_id, r.us, r.last_us) for r in causal.latest_before(probes, ev, "user_id").collect()) == [("u", 5, None), ("u", 9, 5), ("u", 10, 9), ("v", 7, None)]


def test_arrays(spark):
    assert one(spark, C.last_n(strings("a", "b"), 3)) == ["a", "b"]
    assert one(spark, C.last_n(strings("a", "b", "c"), 2)) == ["b", "c"]
    assert one(spark, C.last_n(F.lit(None).cast("array<string>"), 2)) is None
    assert one(spark, C.tokens(F.lit(""))) == [] == one(spark, C.tokens(F.lit(None).cast("string")))
    assert one(spark, C.packed_pairs(F.lit("N1-1 N2-0"))[0]) == ["N1", "N2"] and one(spark, C.packed_pairs(F.lit("N1-1 N2-0"))[1]) == ["N1"]
    assert one(spark, C.jaccard(strings("a", "b"), strings("b", "c"))) == pytest.approx(1 / 3)
    assert one(spark, C.jaccard(strings(), strings("a"))) == one(spark, C.jaccard(F.lit(None).cast("array<string>"), strings("a"))) == 0
    assert one(spark, C.union_keep_order(strings("b", "a", "b"), strings("c", "a"))) == ["b", "a", "c"]
    assert one(spark, ranker.truncate_pad(strings("a"), 3)) == ["", "", "a"]


def test_entities_are_read_leniently(spark):
    for text, want in ((None, []), ("[]", []), ("not json", []), ('[{"Label":"A"},{"X":1},{"Label":""}]', ["A"])):
        assert one(spark, C.entity_labels(F.lit(text).cast("string"))) == want


def test_times(spark):
    assert one(spark, C.clock_12h(F.lit("11/9/2019 12:05:06 AM"))) == dt.datetime(2019, 11, 9, 0, 5, 6)
    assert one(spark, C.decay(F.lit(24.0))) == 0.5 and one(spark, C.decay(F.lit(-3.0))) == 1.0 and one(spark, C.decay(F.lit(None).cast("double"))) == 0.0
    assert one(spark, C.number_or_zero(F.lit(float("nan")))) == 0.0


def ranked(spark, scores, labels=None):
    rows = [(1, i + 1, s, (labels or [0] * len(scores))[i]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "imp int, pos int, score double, label int")


def test_ranks(spark):
    df = ranked(spark, [5.0, 5.0, 1.0, 9.0]).select("pos", average_rank(F.col("score"), "imp").alias("a"), ordinal_rank(F.col("score"), F.col("pos"), "imp").alias("o"))
    assert [(r.a, r.o) for r in df.orderBy("pos").collect()] == [(2.5, 2), (2.5, 3), (1.0, 4), (4.0, 1)]
    assert ranked(spark, [7.0]).select(scaled_rank(F.col("score"), "imp").alias("x")).first().x == 0.5
    assert [r.x for r in ranked(spark, [3.0, 3.0]).select(zscore(F.col("score"), "imp").alias("x")).collect()] == [0.0, 0.0]


def test_the_two_aucs_differ_on_ties(spark):
    a = metrics.list_metrics(ranked(spark, [1.0, 1.0], [1, 0]), "imp").first()
    b = metrics.list_metrics(ranked(spark, [1.0, 1.0], [0, 1]), "imp").first()
    assert (a.auc_midrank, b.auc_midrank) == (0.5, 0.5) and (a.auc_ordinal, b.auc_ordinal) == (1.0, 0.0)
    assert metrics.list_metrics(ranked(spark, [1.0, 2.0], [1, 1]), "imp").count() == metrics.list_metrics(ranked(spark, [1.0, 2.0], [0, 0]), "imp").count() == 0


def test_reciprocal_ranks(spark):
    m = metrics.list_metrics(ranked(spark, [9.0, 8.0, 7.0, 6.0, 5.0], [1, 0, 0, 1, 0]), "imp").first()
    assert (m.mrr, m.mrr_all) == (1.0, 0.625)
    assert m.ndcg_5 == pytest.approx((1 + 1 / 2.321928094887362) / (1 + 1 / 1.584962500721156))


def test_recall_counts_clicks_not_items(spark):
    df = spark.createDataFrame([(["a"], ["a", "a"]), (None, ["a"]), (["b", "a"], ["a"])], "retrieved array<string>, clicked array<string>")
    assert [r.recall_50 for r in metrics.recall_at(df).collect()] == [0.5, 0.0, 1.0]
    assert metrics.hit_rate(df).first().hit_rate == pytest.approx(2 / 3)


def test_diversity_takes_null_as_a_category(spark):
    df = spark.createDataFrame([(1, c) for c in ("a", "a", None, None, "b")] + [(2, "a")], "imp int, category string")
    assert {r.imp: r.diversity for r in beyond.diversity(df, "imp").collect()} == {1: pytest.approx(0.8), 2: 0.0}


def test_overfetch_does_not_refill(spark):
    t = dt.datetime(2024, 1, 1)
    ranked_ = spark.createDataFrame([(1, f"i{k}", k, t) for k in range(1, 601)], "query int, item string, rank int, ts timestamp_ntz")
    dim = spark.createDataFrame([(f"i{k}", t + dt.timedelta(days=1 if k <= 450 else -1)) for k in range(1, 601)], "item string, published_time timestamp_ntz")
    got = retrieval.overfetch(ranked_, dim, "query").orderBy("rank").collect()
    assert len(got) == 150 and (got[0].item, got[0].rank) == ("i451", 1)


def test_category_match_ignores_unknown_categories(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "n"), (2, "a")], "imp int, item string")
    art = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("n", None)], "article_id string, category string")
    hist = spark.createDataFrame([(1, "b"), (1, "b"), (1, "c"), (1, "n"), (1, "gone")], "imp int, item string")
    got = {(r.imp, r.item): r.cat_match for r in features.category_match(pairs, hist, art).collect()}
    assert got == {(1, "a"): pytest.approx(2 / 3), (1, "n"): 0.0, (2, "a"): 0.0}


def test_engagement_counts_nan_as_zero(spark):
    hist = spark.createDataFrame([(1, float("nan"), 10.0), (1, 10.0, None)], "imp int, read_time double, scroll double")
    r = features.engagement(hist).first()
    assert r.user_read == pytest.approx(__import__("math").log1p(5)) and r.user_scroll == 5.0


def test_block_history_never_merges_blocks(spark):
    imps = spark.createDataFrame([("u", "val"), ("u", "test")], "user_id string, split string")
    recs = spark.createDataFrame([("u", "early", 1), ("u", "test", 2)], "user_id string, block string, r int")
    assert {r.split: r.r for r in features.block_history(imps, recs).collect()} == {"val": 1, "test": 2}


def test_forbidden_columns_are_seen_in_plans(spark):
    art = spark.createDataFrame([("a", 5, 3.0)], "article_id string, total_inviews int, score double")
    assert features.forbidden_columns(art.filter("total_inviews > 3").select("article_id")) == ["total_inviews"]
    assert features.forbidden_columns(art.select("article_id", "score")) == []


def test_constant_features_are_an_error(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "bm25 double, emb double")
    with pytest.raises(ValueError, match="bm25"):
        features.require_varied(df)
    assert features.constant_features(df.select("emb")) == []


def test_null_timestamps_are_not_compared(spark):
    t = dt.datetime(2024, 1, 2)
    rows = [(t, None), (t, []), (t, [dt.datetime(2024, 1, 1)]), (t, [t])]
    r = splits.check_history_past(spark.createDataFrame(rows, "timestamp timestamp_ntz, history_timestamps array<timestamp_ntz>")).first()
    assert (r.compared, r.violations) == (2, 1)


def test_splits_are_half_open(spark):
    cfg = Dataset("d", val_start="2024-01-02 00:00:00", test_start="2024-01-03 00:00:00")
    at = [dt.datetime(2024, 1, 1, 23, 59, 59, 999999), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)]
    df = spark.createDataFrame([(x,) for x in at], "ts timestamp_ntz")
    assert [r.s for r in df.orderBy("ts").select(splits.split_of(F.col("ts"), cfg).alias("s")).collect()] == ["train", "val", "test"]


def test_joins_that_must_be_whole(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert splits.require_unique_join(a, b, ["k"]).count() == 2
    for bad in (b.filter("k = 1"), b.union(b)):
        with pytest.raises(ValueError):
            splits.require_unique_join(a, bad, ["k"])
    with pytest.raises(ValueError):
        splits.require_covered(a, b.filter("k = 1"), "k")


def test_validator_tells_faults_apart(spark, tmp_path):
    want = spark.createDataFrame([(1, "10", 2), (2, "11", 3), (3, "12", 1), (4, "13", 2)], "row int, id string, n long")
    got = spark.createDataFrame([(1, "10", [1, 1]), (2, "11", [1, 2]), (4, "12", [1, 2])], "row int, id string, ranks array<int>")
    r = export.validate(got, want).first()
    assert (r.expected, r.found, r.out_of_order, r.wrong_length, r.bad_permutation) == (4, 3, 2, 1, 1)
    scored = ranked(spark, [1.0, 3.0, 2.0])
    export.write_lines(export.rank_lists(scored), str(tmp_path / "out"))
    packed = export.pack(str(tmp_path / "out"), str(tmp_path / "sub"))
    assert export.unpack(packed) == ["1 [3,1,2]"] and export.pack(str(tmp_path / "out"), str(tmp_path / "sub"), smoke=True) != packed


def test_negative_samples_repeat_when_few(spark):
    df = spark.createDataFrame([(1, "c", 1), (1, "n", 0), (2, "c", 1)], "imp int, item string, label int")
    assert [(r.imp, r.negatives) for r in ranker.negative_samples(df).collect()] == [(1, ["n"] * 4)]
