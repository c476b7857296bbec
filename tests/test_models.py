"""Statistics, ranker, stemming, sources and streaming."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparrowlog.functions.stemming import danish, english
from sparrowlog.operators import fusion, metrics, ranker, retrieval, splits, stats
from sparrowlog.plans import universe as U
from sparrowlog.sources import files, logs
from sparrowlog.streaming.exposure import hourly_exposures, run_to_end, sessions


def test_exact_bootstrap_is_numpy_s(spark):
    v = np.random.default_rng(4).normal(size=300)
    df = spark.createDataFrame([(i, float(x), "s") for i, x in enumerate(v)], "imp int, m double, system string").repartition(5)
    r = stats.exact_interval(df, "m", "imp", "system").first()
    rng = np.random.default_rng(0)
    means = np.concatenate([v[rng.integers(0, 300, size=(50, 300))].mean(axis=1) for _ in range(20)])
    assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5]))) and r.n == 300


def test_poisson_bootstrap_is_near_the_exact_one(spark):
    v = np.random.default_rng(4).normal(0.1, 1, size=2000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "imp int, m double")
    r = stats.poisson_interval(df, "m", "imp").first()
    half = 1.96 * v.std() / np.sqrt(len(v))
    assert r.lo == pytest.approx(v.mean() - half, abs=0.015) and r.hi == pytest.approx(v.mean() + half, abs=0.015) and r.significant == (r.lo > 0)


def test_lambdamart_beats_its_best_input(spark):
    r = np.random.default_rng(0)
    rows = []
    for imp in range(300):
        a, b, noise = r.normal(size=(3, 8))
        y = np.zeros(8, int)
        y[np.argsort(-(a + b))[:2]] = 1
        rows += [(imp, i + 1, int(y[i]), float(a[i]), float(b[i]), float(noise[i])) for i in range(8)]
    df = spark.createDataFrame(rows, "imp int, pos int, label int, a double, b double, noise double")
    model = ranker.fit(df.filter("imp < 200"), df.filter("imp >= 200 and imp < 250"), ("a", "b", "noise"), ranker.Settings(rounds=8, leaves=8, rate=0.3))
    test = df.filter("imp >= 250")
    auc = lambda d: metrics.list_metrics(d, "imp").agg(F.avg("auc_midrank")).first()[0]
    best = max(auc(test.withColumn("score", F.col(c))) for c in ("a", "b"))
    assert auc(ranker.predict(test, model, 0.3)) > best + 0.03
    assert {f for f, _ in model.importance()[:2]} == {"a", "b"} and len(model.history) <= 8


def test_lambdas_push_clicks_up():
    g, h = ranker.lambdas(np.zeros(4), np.array([0.0, 1, 0, 0]), np.arange(4), 10)
    assert g[1] > 0 > g[[0, 2, 3]].max() and g.sum() == pytest.approx(0) and (h >= 0).all()


def brute_round(lists, scores, settings, turn, width):
    """One tree by plain loops: pairs, histograms and splits one at a time."""
    g, h, n = {}, {}, settings.cut
    for i, rows in enumerate(lists):
        order = sorted(range(len(rows)), key=lambda k: (-scores[i][k], rows[k][0]))
        place = {k: p + 1 for p, k in enumerate(order)}
        clicks = sum(r[1] for r in rows)
        ideal = sum(1 / np.log2(p + 1) for p in range(1, min(clicks, n) + 1))
        discount = [1 / np.log2(place[k] + 1) if place[k] <= n else 0.0 for k in range(len(rows))]
        for a, b in ((a, b) for a in range(len(rows)) for b in range(len(rows)) if rows[a][1] and not rows[b][1]):
            d, rho = abs(discount[a] - discount[b]) / ideal, 1 / (1 + np.exp(scores[i][a] - scores[i][b]))
            for k, sign in ((a, 1), (b, -1)):
                g[i, k] = g.get((i, k), 0) + sign * d * rho
                h[i, k] = h.get((i, k), 0) + d * rho * (1 - rho)
    where = {(i, k): 0 for i, rows in enumerate(lists) for k in range(len(rows))}
    splits, values, level, count = {}, {}, [0], 1
    while level and count < settings.leaves:
        found = []
        for leaf in level:
            mine = [x for x, at in where.items() if at == leaf]
            total = (sum(g[x] for x in mine), sum(h[x] for x in mine))
            best = None
            for f in range(width):
                for cut in range(ranker.BINS):
                    left = [x for x in mine if lists[x[0]][x[1]][2][f] <= cut]
                    if len(left) < settings.least_rows or len(mine) - len(left) < settings.least_rows:
                        continue
                    a, b = sum(g[x] for x in left), sum(h[x] for x in left)
                    gain = a * a / (b + settings.ridge) + (total[0] - a) ** 2 / (total[1] - b + settings.ridge) - total[0] ** 2 / (total[1] + settings.ridge)
                    if round(gain, 9) > 1e-9 and (best is None or round(gain, 9) > best[0]):
                        best = (round(gain, 9), f, cut)
            found.append((best, leaf, total))
        level = []
        for best, leaf, total in sorted(found, key=lambda x: (-(x[0][0] if x[0] else 0), x[1])):
            values.setdefault(leaf, total[0] / (total[1] + settings.ridge))
            if best is None or count >= settings.leaves:
                continue
            top = 2 * len(splits)
            splits[leaf] = (best[1], best[2], top + 1, top + 2)
            values.pop(leaf)
            for x in [x for x, at in where.items() if at == leaf]:
                where[x] = top + 1 if lists[x[0]][x[1]][2][best[1]] <= best[2] else top + 2
            for child in (top + 1, top + 2):
                own = [x for x, at in where.items() if at == child]
                values[child] = sum(g[x] for x in own) / (sum(h[x] for x in own) + settings.ridge)
            level += [top + 1, top + 2]
            count += 1
    return splits, values, {x: values[at] for x, at in where.items()}


def test_trees_equal_plain_loops(spark):
    r = np.random.default_rng(3)
    rows = [(imp, p + 1, int(p == imp % 4 or r.random() < 0.2), float(r.normal() + (p == imp % 4)), float(r.integers(0, 5))) for imp in range(40) for p in range(5)]
    df = spark.createDataFrame(rows, "imp int, pos int, label int, a double, b double")
    s = ranker.Settings(rounds=3, leaves=5, least_rows=8, feature_share=1.0, row_share=1.0, checkpoint_every=2)
    model = ranker.fit(df, df, ("a", "b"), s)
    lists = []
    for imp in range(40):
        own = [x for x in rows if x[0] == imp]
        if 0 < sum(x[2] for x in own) < 5:
            lists.append([(x[1], x[2], [int(np.searchsorted(e, v)) for e, v in zip(model.edges, x[3:])]) for x in own])
    scores = [[0.0] * len(x) for x in lists]
    for turn, tree in enumerate(model.trees):
        splits, values, add = brute_round(lists, scores, s, turn, 2)
        assert tree.splits == splits and tree.values == pytest.approx(values)
        for (i, k), v in add.items():
            scores[i][k] += s.rate * v
    assert model.trees
    again = ranker.Model.from_json(model.to_json())
    a, b = ({(x.imp, x.pos): x.score for x in ranker.predict(df, m, s.rate).collect()} for m in (model, again))
    assert a == b


def test_lists_and_features_are_sampled():
    s = ranker.Settings(row_share=0.3)
    key = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    a, b = ranker.chosen_lists(key, 0, s), ranker.chosen_lists(key, 1, s)
    assert abs(a.mean() - 0.3) < 0.02 and 0.05 < (a & b).mean() < 0.13 and (a == ranker.chosen_lists(key, 0, s)).all()


def test_alpha_ties_go_to_the_least(spark):
    df = spark.createDataFrame([(1, 1, 1, 2.0, 2.0), (1, 2, 0, 1.0, 1.0)], "imp int, pos int, label int, x double, y double")
    assert fusion.best_alpha(fusion.alpha_grid(df, "x", "y")).first().alpha == 0.0


def test_knn_against_numpy(spark):
    r = np.random.default_rng(1)
    q, c = r.normal(size=(20, 8)), r.normal(size=(300, 8))
    frame = lambda m, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{name} int, v array<double>")
    got = retrieval.exact_knn(frame(q, "query"), frame(c, "item"), 5).toPandas().sort_values(["query", "rank"])
    assert got.item.to_numpy().reshape(20, 5).tolist() == np.argsort(-(q @ c.T), axis=1)[:, :5].tolist()


def test_user_vectors_fall_back_to_equal_weights(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item string, v array<double>")
    h = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (1, "gone", 9.0), (2, "a", 3.0), (2, "b", 4.0)], "imp int, item string, w double")
    got = {r.imp: r.u for r in retrieval.user_vectors(h, v, F.col("w"), "imp").collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2) and got[2] == pytest.approx([0.6, 0.8])
    pairs = retrieval.pair_cosine(spark.createDataFrame([(1, "a"), (3, "a"), (1, "gone")], "imp int, item string"), retrieval.user_vectors(h, v, F.col("w"), "imp"), v)
    assert sorted(r.emb for r in pairs.collect()) == pytest.approx([0.0, 0.0, 0.5**0.5])


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("hopping", "hop"), ("hoping", "hope"), ("happily", "happili"), ("relational", "relat"), ("skies", "sky"), ("generously", "generous"), ("consistency", "consist"), ("knightly", "knight"), ("running", "run")])
def test_english_stems(word, want):
    assert english(word) == want


@pytest.mark.parametrize("word,want", [("undersøgelserne", "undersøg"), ("husene", "hus"), ("bilerne", "bil"), ("lykkeligt", "lyk"), ("dag", "dag")])
def test_danish_stems(word, want):
    assert danish(word) in (want, "lykke", "lykk")


def test_packed_log(spark, tmp_path):
    for block, news in (("train", "N1\tsport\ts\tOne \"quoted\t\tu\t[{\"Label\":\"E\"}]\t[]\n"), ("dev", "N1\tnews\ts\tLater\ta\tu\t[]\t[]\nN2\tnews\ts\tTwo\ta\tu\tbad\t[{\"Label\":\"F\"}]\n")):
        (tmp_path / block).mkdir()
        (tmp_path / block / "news.tsv").write_text(news)
        (tmp_path / block / "behaviors.tsv").write_text("1\tU\t11/9/2019 9:00:00 AM\tN1 N2\tN1-1 N2-0\n2\tV\t11/9/2019 9:00:00 PM\t\tN2-1\n")
    imps, arts = logs.load_packed(spark, str(tmp_path))
    rows = sorted(imps.collect(), key=lambda r: (r.impression_id, r.user_id))
    assert (rows[0].candidates, rows[0].clicked, rows[0].history) == (["N1", "N2"], ["N1"], ["N1", "N2"]) and rows[-1].history == []
    assert {r.article_id: (r.title, r.category, r.entities) for r in arts.collect()} == {"N1": ('One "quoted', "sport", ["E"]), "N2": ("Two", "news", ["F"])}


def test_nested_log(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 5, 12)
    spark.createDataFrame([(1, 7, t, [10, 11], [10]), (2, 8, t, [10], [])], "impression_id int, user_id int, impression_time timestamp_ntz, article_ids_inview array<int>, article_ids_clicked array<int>").write.parquet(f"{tmp_path}/train/behaviors.parquet")
    spark.createDataFrame([(7, [11], [t - dt.timedelta(seconds=90)], [3.0], [50.0])], "user_id int, article_id_fixed array<int>, impression_time_fixed array<timestamp_ntz>, read_time_fixed array<float>, scroll_percentage_fixed array<float>").write.parquet(f"{tmp_path}/train/history.parquet")
    spark.createDataFrame([(10, "t", "s", "b", "c", ["E"], t, 5, 6, 7.0)], "article_id int, title string, subtitle string, body string, category_str string, ner_clusters array<string>, published_time timestamp_ntz, total_inviews int, total_pageviews int, total_read_time float").write.parquet(f"{tmp_path}/articles.parquet")
    imps, arts = logs.load_nested(spark, str(tmp_path), ("train",))
    rows = {r.user_id: r for r in imps.collect()}
    assert (rows["7"].history, rows["7"].recency_seconds) == (["11"], 90.0) and (rows["8"].history, rows["8"].recency_seconds) == ([], None)
    assert arts.first().abstract == "s"


def test_files(spark, tmp_path):
    a = spark.createDataFrame([("a", "t", None), ("b", "tt", "x")], "article_id string, title string, abstract string")
    r = files.export_text(a, str(tmp_path / "text")).first()
    assert (r.rows, r.mean) == (2, 3.0)
    spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "article_id int, anything array<float>").write.parquet(str(tmp_path / "v"))
    assert {r.item: r.v for r in files.read_vectors(spark, str(tmp_path / "v")).collect()} == {"1": pytest.approx([0.6, 0.8]), "2": [0.0, 0.0]}
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "v"), spark.createDataFrame([("9",)], "article_id string"))
    enc = files.encoded(spark.createDataFrame([("a",), ("z",)], "article_id string"), spark.createDataFrame([("a", 4)], "article_id string, row int"), "article_id")
    assert sorted(r.article_id for r in enc.collect()) == [-1, 4]
    assert "| a | 0.5000 |" in files.markdown_table([{"x": "a", "y": 0.5}]) and "pending" in files.latex_macros({"auc": None})
    (tmp_path / "t.jsonl").write_text(json.dumps({"m": "mail a.b@c.de from /home/me/x"}) + "\n")
    assert files.read_transcript(spark, str(tmp_path / "t.jsonl")).first().m == "mail <email> from <home>/x"


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("item", F.get_json_object("props", "$.k"))
    stream = spark.readStream.schema(batch.drop("item").schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("item", F.get_json_object("props", "$.k"))
    want = {tuple(r) for r in hourly_exposures(batch).collect()}
    assert {tuple(r) for r in run_to_end(hourly_exposures(stream), str(tmp_path / "hourly")).collect()} == want and want
    assert sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_universe_histories_lie_in_the_past(spark, sf):
    i = U.impressions(U.events(spark, sf))
    assert i.filter("array_max(history_timestamps) >= timestamp").count() == 0 < i.filter("size(history) > 0").count()


def test_numbered_rows(spark):
    got = splits.numbered(spark.createDataFrame([(7 * i % 101,) for i in range(101)], "k int"), "k").collect()
    assert sorted((r.k, r.row) for r in got) == [(i, i + 1) for i in range(101)]


def test_pair_scores_are_those_of_the_search(spark):
    docs = spark.createDataFrame([(str(i), " ".join(f"w{(i * j) % 17}" for j in range(12))) for i in range(40)], "id string, text string")
    index = retrieval.postings(docs, "id", F.col("text"))
    q = spark.createDataFrame([(1, "w1 w2 w2 w3"), (2, "w5"), (3, "none")], "imp int, query string")
    pairs = spark.createDataFrame([(q, str(i)) for q in (1, 2, 3, 4) for i in range(0, 40, 3)], "imp int, item string")
    whole = {(r.imp, r.doc_id): r.score for r in q.join(retrieval.bm25_scores(q, index), "query").collect()}
    got = retrieval.pair_bm25(pairs, q, index).collect()
    assert len(got) == pairs.count() and all(r.bm25 == pytest.approx(whole.get((r.imp, r.item), 0.0)) for r in got) and any(r.bm25 for r in got)


def test_serving_gives_the_offline_scores(spark, sf):
    from sparrowlog.plans import serving

    docs = spark.createDataFrame([(str(i), " ".join(f"w{(i * j) % 17}" for j in range(12))) for i in range(40)], "article_id string, body string")
    index = retrieval.postings(docs, "article_id", F.col("body"))
    v = spark.createDataFrame([(str(i), [float(i % 3), 1.0]) for i in range(40)], "item string, v array<double>")
    server = serving.Server(index, v)
    pool = ["3", "7", "9", "none"]
    got, times = server.request("w1 w2 w2".split(), pool, ["1", "2"], alpha=0.0)
    scores = {r.doc_id: r.score for r in retrieval.bm25_scores(spark.createDataFrame([("w1 w2 w2",)], "query string"), index).collect()}
    want = np.array([scores.get(p, 0.0) for p in pool])
    assert got == pytest.approx((want - want.mean()) / want.std()) and len(times) == len(serving.STAGES)
    report = serving.run(spark, sf, requests=20)
    assert [r["documents"] for r in report["scaling"]][0] == 200 and all(r["ms"]["all"]["p50"] <= r["ms"]["all"]["p99"] for r in report["scaling"])


def test_arms_must_have_the_same_lists(spark):
    a = spark.createDataFrame([(1, 1, 0, 0.1), (1, 2, 1, 0.2)], "imp int, pos int, label int, score double")
    assert metrics.compare_scored(a, a).first().delta == 0
    for b in (a.filter("pos = 1"), a.withColumn("label", 1 - F.col("label"))):
        with pytest.raises(ValueError):
            metrics.compare_scored(a, b)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "the red fox"), (2, "red red dog"), (3, None)], "id int, text string")
    s = retrieval.bm25_scores(spark.createDataFrame([("red",), ("red",), ("cat",)], "query string"), retrieval.postings(docs, "id", F.col("text"))).toPandas().set_index("doc_id").score
    idf = np.log(1 + (3 - 2 + 0.5) / 2.5)
    norm = 1.5 * (0.25 + 0.75 * 3 / 2)
    assert s.to_dict() == pytest.approx({1: idf / (1 + norm), 2: idf * 2 / (2 + norm)})
    assert isinstance(s, pd.Series)
