"""The pipeline's stages from a raw nested log to the ranked lists, against a recount in Python."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparrowlog.config import Dataset
from sparrowlog.operators import ranker
from sparrowlog.plans import pipeline

T0 = dt.datetime(2024, 1, 10)
CFG = Dataset("tiny", val_start="2024-01-20 00:00:00", test_start="2024-01-25 00:00:00", pop_window_h=6.0)


@pytest.fixture(scope="module")
def log():
    """Users, their histories by block, articles, and impressions; each item is shown, and some are clicked."""
    r = random.Random(8)
    arts = [(i, f"title {i} word{i % 5}", f"sub {i}", f"body word{i % 7} word{i % 3}", f"c{i % 4}", [f"e{i % 6}", f"e{i % 5}"], T0 - dt.timedelta(hours=7 * i)) for i in range(40)]
    users, imps, hist = range(25), [], {}
    for block, start, days in (("train", T0, 15), ("validation", T0 + dt.timedelta(days=15), 5)):
        for u in users:
            n = r.randrange(0, 6)
            hist[block, u] = [(r.randrange(40), start - dt.timedelta(hours=r.randrange(1, 100)), float(r.randrange(200)), float(r.randrange(100))) for _ in range(n)]
        for _ in range(160):
            shown = r.sample(range(40), r.randrange(2, 7))
            imps.append((block, len(imps), r.choice(users), start + dt.timedelta(minutes=r.randrange(days * 24 * 60)), shown, r.sample(shown, r.choice([0, 1, 1, 1, 2]))))
    return arts, imps, hist


@pytest.fixture(scope="module")
def work(spark, log, tmp_path_factory):
    arts, imps, hist = log
    root = str(tmp_path_factory.mktemp("nested"))
    spark.createDataFrame([(*a, 5, 6, 7.0) for a in arts], "article_id int, title string, subtitle string, body string, category_str string, ner_clusters array<string>, published_time timestamp_ntz, total_inviews int, total_pageviews int, total_read_time float").write.parquet(f"{root}/articles.parquet")
    spark.createDataFrame([(a[0], [math.sin(a[0] + k) for k in range(4)]) for a in arts], "article_id int, vec array<float>").write.parquet(f"{root}/vectors.parquet")
    for block in ("train", "validation"):
        spark.createDataFrame([x[1:] for x in imps if x[0] == block], "impression_id int, user_id int, impression_time timestamp_ntz, article_ids_inview array<int>, article_ids_clicked array<int>").write.parquet(f"{root}/{block}/behaviors.parquet")
        rows = [(u, [x[0] for x in h], [x[1] for x in h], [x[2] for x in h], [x[3] for x in h]) for (b, u), h in hist.items() if b == block]
        spark.createDataFrame(rows, "user_id int, article_id_fixed array<int>, impression_time_fixed array<timestamp_ntz>, read_time_fixed array<float>, scroll_percentage_fixed array<float>").write.parquet(f"{root}/{block}/history.parquet")
    where, vectors = f"{root}/work", f"{root}/vectors.parquet"
    pipeline.split(spark, CFG, root, where)
    pipeline.retrieve(spark, CFG, where)
    pipeline.score(spark, CFG, vectors, where)
    pipeline.fuse(spark, CFG, where)
    pipeline.build(spark, CFG, vectors, where)
    pipeline.train(spark, CFG, where, ranker.Settings(rounds=4, leaves=5, least_rows=5))
    pipeline.submit(spark, CFG, where, f"{where}/prediction")
    return where


def test_features_equal_a_recount(spark, work, log):
    arts, imps, hist = log
    got = {(r.imp, r.item): r for r in spark.read.parquet(f"{work}/features").collect()}
    assert len(got) == sum(len(x[4]) for x in imps)
    category, published = {str(a[0]): a[4] for a in arts}, {str(a[0]): a[6] for a in arts}
    for block, imp, user, t, shown, clicked in imps:
        split = "train" if t < dt.datetime(2024, 1, 20) else "val" if t < dt.datetime(2024, 1, 25) else "test"
        mine, record = hist[block, user], hist["validation" if split == "test" else "train", user]
        for a in shown:
            r = got[imp, str(a)]
            past = [(x, a in x[5]) for x in imps if a in x[4] and x[3] < t]
            since = lambda h: [(x, c) for x, c in past if x[3] >= t - dt.timedelta(hours=h)]
            want = {
                "exp_causal": len(since(6)), "exp_24h": len(since(24)), "pop_causal": sum(c for _, c in since(6)), "pop_24h": sum(c for _, c in since(24)), "n_cands": len(shown), "hist_len": len(mine),
                "age_hours": (t - published[str(a)]).total_seconds() / 3600, "user_read": math.log1p(sum(x[2] for x in record) / len(record)) if record else 0.0, "user_scroll": sum(x[3] for x in record) / len(record) if record else 0.0,
                "cat_match": sum(category[str(x[0])] == category[str(a)] for x in mine) / max(1, len(mine)),
            }
            assert {k: r[k] for k in want} == pytest.approx(want, rel=1e-5, abs=1e-6) and r.split == split and r.label == int(a in clicked)


def test_an_item_shown_once_and_clicked_is_one_exposure(spark, work, log):
    _, imps, _ = log
    shown = sum(len(x[4]) for x in imps)
    _, c, _ = pipeline._grain(spark, work)
    assert c.count() == shown


def test_the_report_has_all_parts(spark, work):
    rows = {(r.system, r.slice): r for r in pipeline.evaluate(spark, CFG, work).collect()}
    assert {s for s, _ in rows} == set(pipeline.SYSTEMS) and {"all", "warm"} <= {x for _, x in rows}
    assert all(r.lo <= r.auc_midrank + 0.2 and r.hi >= r.auc_midrank - 0.2 and 0 <= r.ndcg_10 <= 1 for r in rows.values())
    b = {r.system: r for r in pipeline.evaluate_beyond(spark, CFG, work).collect()}
    assert set(b) == set(pipeline.SYSTEMS) and all(0 < r.coverage <= 1 and r.novelty > 0 and 0 <= r.diversity <= 1 for r in b.values())
    r = {x.slice: x for x in pipeline.evaluate_retrieval(spark, CFG, work).collect()}["all"]
    assert 0 < r.recall_50 <= r.recall_100 <= r.recall_200 <= 1


def test_the_lists_are_written(spark, work, log):
    lines = sorted(r.value for r in spark.read.text(f"{work}/prediction").collect())
    test = [x for x in log[1] if x[3] >= dt.datetime(2024, 1, 25)]
    assert len(lines) == len(test)
    ranks = {int(k): json.loads(v) for k, v in (x.split(" ", 1) for x in lines)}
    assert all(sorted(ranks[x[1]]) == list(range(1, len(x[4]) + 1)) for x in test)
