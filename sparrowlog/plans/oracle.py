"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

#: L1 at event, candidate and history grain.
_LOG = """
WITH ev AS (
    SELECT event_id, ts, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item,
           event_type IN ('click', 'purchase') AS click, value AS read_time, CAST(event_id % 101 AS DOUBLE) AS scroll,
           user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS imp
    FROM events
), seen AS (
    SELECT imp, user_id, item, min(ts) AS first, max(CAST(click AS INT)) AS label FROM ev GROUP BY ALL
), cand AS (
    SELECT imp, user_id, item, label, min(first) OVER (PARTITION BY imp) AS ts, epoch_us(min(first) OVER (PARTITION BY imp)) AS us,
           row_number() OVER (PARTITION BY imp ORDER BY first, item) AS pos
    FROM seen
), imps AS (
    SELECT DISTINCT imp, user_id, ts, us FROM cand
), hist0 AS (
    SELECT i.imp, e.item, e.read_time, e.scroll, e.ts AS h_ts, e.us AS h_us, row_number() OVER (PARTITION BY i.imp ORDER BY e.us, e.event_id) AS h, count(*) OVER (PARTITION BY i.imp) AS hist_len
    FROM imps i JOIN ev e ON e.user_id = i.user_id AND e.click AND e.us < i.us
)
"""
_ART = """, art AS (
    SELECT CAST(doc_id AS VARCHAR) AS item, regexp_extract(text, '^[^.\n]*') AS title, text AS body, source AS category, CAST(n_chars AS INT) AS total_inviews,
           list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 12)) AS entities,
           CASE WHEN doc_id % 7 <> 0 THEN make_timestamp(1704067200000000 + doc_id * 21600000000) END AS published
    FROM documents
)
"""
_VEC = """, raw AS (
    SELECT CAST(vec_id AS VARCHAR) AS item, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), vec AS (
    SELECT item, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS v FROM raw
), dims AS (
    SELECT item, unnest(range(len(v))) AS d, unnest(v) AS x FROM vec
)
"""
_SPLIT = "CASE WHEN {t} < TIMESTAMP '2024-01-20' THEN 'train' WHEN {t} < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END"


def _count(hours: float | None, clicks: bool, probe: str = "c") -> str:
    low = "" if hours is None else f" AND e.us >= {probe}.us - {int(hours * 3600)}000000"
    return f"(SELECT count(*) FROM ev e WHERE e.item = {probe}.item AND e.us < {probe}.us{low}{' AND e.click' if clicks else ''})"


def _scored(columns: str) -> str:
    """CTE s: candidates with score columns."""
    return f"{_LOG}, s AS (SELECT c.*, {columns} FROM cand c)"


def _metrics(source: str, by: str = "imp", to: str = "m") -> str:
    """CTE ``to``: per-list metrics of ``source`` (by, pos, label, score)."""
    part = f"PARTITION BY {by}"
    ideal = " + ".join(f"CASE WHEN np >= {i} AND {{k}} >= {i} THEN 1.0::DOUBLE / log2({i} + 1) ELSE 0 END" for i in range(1, 11))
    return f"""
, {to}_r AS (
    SELECT *, row_number() OVER ({part} ORDER BY score DESC, pos) AS r, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part}, score) - 1) / 2.0::DOUBLE AS a FROM {source}
), {to}_g AS (
    SELECT {by}, count(*) AS n, sum(label)::BIGINT AS np, sum(CASE WHEN label = 1 THEN r END)::DOUBLE AS down, sum(CASE WHEN label = 1 THEN a END)::DOUBLE AS up, min(CASE WHEN label = 1 THEN r END) AS f,
           avg(CASE WHEN label = 1 THEN 1.0::DOUBLE / r END) AS mrr_all, sum(CASE WHEN label = 1 AND r <= 5 THEN 1.0::DOUBLE / log2(r + 1) ELSE 0 END) AS d5, sum(CASE WHEN label = 1 AND r <= 10 THEN 1.0::DOUBLE / log2(r + 1) ELSE 0 END) AS d10
    FROM {to}_r GROUP BY {by} HAVING sum(label) > 0 AND sum(label) < count(*)
), {to} AS (
    SELECT {by}, n, np AS n_pos, (np::DOUBLE * (n + 1) - down - np::DOUBLE * (np + 1) / 2) / (np::DOUBLE * (n - np)) AS auc_ordinal, (up - np::DOUBLE * (np + 1) / 2) / (np::DOUBLE * (n - np)) AS auc_midrank,
           1.0::DOUBLE / f AS mrr, mrr_all, d5 / ({ideal.format(k=5)}) AS ndcg_5, d10 / ({ideal.format(k=10)}) AS ndcg_10
    FROM {to}_g
)
"""


_NAMES = ("auc_ordinal", "auc_midrank", "mrr", "mrr_all", "ndcg_5", "ndcg_10")
_ROUNDED = ", ".join(f"round({x}, 6) AS {x}" for x in _NAMES)
_MEANS = ", ".join(f"round(avg({x}), 6) AS {x}" for x in _NAMES)
_POP, _DAY = _count(None, True), _count(24, True)

#: User vectors over rows h (imp, item, w): CTE uv(imp, d, x), unit length.
_USER = """
, um AS (
    SELECT {by}, d, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE avg(x) END AS x FROM h JOIN dims USING (item) GROUP BY {by}, d
), uv AS (
    SELECT {by}, d, x / (sqrt(sum(x * x) OVER (PARTITION BY {by})) + 1e-9) AS x FROM um
)
"""


def _user(rows: str, by: str = "imp") -> str:
    return f"{_LOG}{_VEC}, h AS ({rows}){_USER.format(by=by)}"


_LAST10 = "SELECT imp, item, 1.0::DOUBLE AS w FROM hist0 WHERE h > hist_len - 10"
_READ = "SELECT imp, item, ln(1 + greatest(CASE WHEN isnan(read_time) THEN 0 ELSE coalesce(read_time, 0) END, 0)) AS w FROM hist0"
_COS = ", cs AS (SELECT c.imp, c.item, c.pos, c.label, coalesce(sum(uv.x * dims.x), 0) AS emb FROM cand c LEFT JOIN dims ON dims.item = c.item LEFT JOIN uv ON uv.imp = c.imp AND uv.d = dims.d GROUP BY ALL)"


def _bm25(docs: str, ident: str, text: str) -> str:
    """CTEs of an index: post(term, doc, tf, df, weight)."""
    return f"""
, toks AS (SELECT {ident} AS doc, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}')) AS term FROM {docs})
, tf AS (SELECT term, doc, count(*) AS tf FROM toks GROUP BY ALL), dl AS (SELECT doc, sum(tf) AS dl FROM tf GROUP BY doc), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
, sz AS (SELECT (SELECT count(*) FROM {docs})::DOUBLE AS n, (SELECT sum(dl) FROM dl)::DOUBLE AS total)
, post AS (
    SELECT term, doc, tf, df, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (total / n))) AS weight
    FROM tf JOIN dfs USING (term) JOIN dl USING (doc), sz
)
"""


_BENCH = """
, qt AS (SELECT text AS query, term, count(*) AS qtf FROM (SELECT text, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_\\p{M}]{2,}')) AS term FROM (SELECT DISTINCT text FROM benchmark)) GROUP BY ALL)
, sc AS (SELECT query, doc, sum(qtf * weight) AS score FROM qt JOIN post USING (term) GROUP BY ALL)
, top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sc)
"""
_POOL_QUERY = """
, hq AS (SELECT imp, string_agg(title, ' ' ORDER BY h) AS query FROM hist0 JOIN art USING (item) WHERE h > hist_len - 5 GROUP BY imp)
"""
_POOL = f"""{_POOL_QUERY}
{_bm25("art", "item", "body")}
, qt AS (SELECT imp, term, count(*) AS qtf FROM (SELECT imp, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}')) AS term FROM hq) GROUP BY ALL)
, sc AS (SELECT c.imp, c.item, sum(qtf * weight) AS score FROM cand c JOIN qt ON qt.imp = c.imp JOIN post ON post.doc = c.item AND post.term = qt.term GROUP BY ALL)
, bs AS (SELECT c.imp, c.item, coalesce(score, 0) AS bm25 FROM cand c LEFT JOIN sc ON sc.imp = c.imp AND sc.item = c.item)
"""


def _z(x: str, part: str = "imp") -> str:
    w = f"OVER (PARTITION BY {part})"
    return f"CASE WHEN stddev_pop({x}) {w} < 1e-12 THEN 0.0 ELSE ({x} - avg({x}) {w}) / stddev_pop({x}) {w} END"


_TOP = f"{_scored(_POP + ' AS n')}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY imp ORDER BY n DESC, pos) AS r FROM s) WHERE r <= {{k}})"
_TRAIN = ", tc AS (SELECT item, count(*) AS tn FROM ev WHERE click AND ts < TIMESTAMP '2024-01-20' {more} GROUP BY item)"
_L2 = """
WITH ln AS (
    SELECT l_orderkey AS imp, CAST(l_partkey AS VARCHAR) AS item, CAST(l_returnflag = 'R' AS INT) AS label, l_extendedprice AS price,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos
    FROM lineitem
), cand AS (
    SELECT ln.*, o_orderdate AS ts, epoch_us(o_orderdate) AS us FROM ln JOIN orders ON o_orderkey = imp
), ev AS (SELECT item, us, TRUE AS click FROM cand WHERE label = 1)
"""
_ALPHAS = "(SELECT unnest(range(21)) / 20.0::DOUBLE AS alpha)"
_SWEEP = f"{_scored(f'{_POP} AS pop, {_DAY} AS dayn')}, z AS (SELECT imp, pos, label, {_z('pop')} AS a, {_z('dayn')} AS b FROM s), sw AS (SELECT imp, pos, label, alpha, round(alpha * a + (1 - alpha) * b, 9) AS score FROM z, {_ALPHAS} q)"
_QUALITY = """
, base AS (
    SELECT c.imp, any_value(c.ts) AS ts, (SELECT list(h_ts ORDER BY h) FROM hist0 WHERE hist0.imp = c.imp) AS hts, (SELECT count(*) FROM hist0 WHERE hist0.imp = c.imp) AS hl,
           list(c.item ORDER BY pos) AS cands, list(c.item ORDER BY pos) FILTER (WHERE label = 1) AS clicked
    FROM cand c GROUP BY c.imp
), logs AS (
    SELECT 'as it is' AS log, imp, ts, hts, hl, cands, coalesce(clicked, []) AS clicked, floor((epoch_us(ts) - epoch_us(list_max(hts))) / 1e6) AS since FROM base
    UNION ALL
    SELECT 'poisoned', imp, ts, CASE WHEN imp % 10 = 0 THEN CASE WHEN hts IS NULL THEN NULL ELSE list_append(hts, ts) END ELSE hts END, hl, cands, CASE WHEN imp % 10 = 1 THEN list_append(coalesce(clicked, []), 'no such') ELSE coalesce(clicked, []) END,
           CASE WHEN imp % 10 = 2 AND hl > 0 THEN 0 ELSE floor((epoch_us(ts) - epoch_us(list_max(hts))) / 1e6) END FROM base
)
"""
_RANKS = f"{_scored(_POP + ' AS score')}, rr AS (SELECT imp, pos, row_number() OVER (PARTITION BY imp ORDER BY score DESC, pos) AS r FROM s)"



def _scaled(x: str) -> str:
    """Average rank of x within its list, scaled to 0..1."""
    n = "count(*) OVER (PARTITION BY imp)"
    return f"CASE WHEN {n} = 1 THEN 0.5::DOUBLE ELSE ((rank() OVER (PARTITION BY imp ORDER BY {x}) + (count(*) OVER (PARTITION BY imp, {x}) - 1) / 2.0::DOUBLE) - 1) / ({n} - 1) END"


def _over_max(x: str) -> str:
    return f"{x}::DOUBLE / (max({x}) OVER (PARTITION BY imp) + 1)"


def _feature_sql() -> str:
    """Every feature of every candidate, from the same parts as their own queries."""
    counts = f"{_count(6, True)} AS pop_causal, {_count(24, True)} AS pop_24h, {_count(6, False)} AS exp_causal, {_count(24, False)} AS exp_24h"
    read = _USER.format(by="imp").replace("um AS", "um2 AS").replace("uv AS", "uv2 AS").replace("FROM um", "FROM um2").replace("FROM h JOIN", "FROM h2 JOIN")
    made = {
        "bm25": "bm25", "emb": "emb", "pop_causal": "pop_causal", "pop_rank": _scaled("pop_causal"), "emb_rank": _scaled("emb"), "n_cands": "count(*) OVER (PARTITION BY imp)", "pop_rel_max": _over_max("pop_causal"),
        "pop_24h": "pop_24h", "pop_velocity": "pop_causal::DOUBLE / (pop_24h + 1)", "exp_causal": "exp_causal", "exp_24h": "exp_24h", "exp_velocity": "exp_causal::DOUBLE / (exp_24h + 1)", "exp_rank": _scaled("exp_causal"), "exp_rel_max": _over_max("exp_causal"),
        "age_hours": "coalesce((us - epoch_us(published)) / 3.6e9, -1)", "recency": "CASE WHEN published IS NULL THEN 0 ELSE pow(0.5::DOUBLE, greatest((us - epoch_us(published)) / 3.6e9, 0) / 24.0) END",
        "cat_match": "coalesce(same, 0)::DOUBLE / greatest(coalesce(known, 0), 1)", "hist_len": "coalesce(hl, 0)",
        "ent_overlap": "CASE WHEN len(entities) > 0 AND len(past) > 0 THEN len(list_intersect(entities, past))::DOUBLE / len(list_distinct(list_concat(entities, past))) ELSE 0 END",
        "user_read": "coalesce(rd, 0)", "user_scroll": "coalesce(sr, 0)", "engage_sim": "es",
    }
    return f"""{_user(_LAST10)}{_ART}{_COS}{_POOL}, h2 AS ({_READ}){read}
, ce AS (SELECT c.imp, c.item, coalesce(sum(uv2.x * dims.x), 0) AS es FROM cand c LEFT JOIN dims ON dims.item = c.item LEFT JOIN uv2 ON uv2.imp = c.imp AND uv2.d = dims.d GROUP BY ALL)
, hc AS (SELECT imp, category, count(*) AS same FROM hist0 JOIN art USING (item) WHERE category IS NOT NULL GROUP BY ALL), ht AS (SELECT imp, sum(same) AS known FROM hc GROUP BY imp)
, he AS (SELECT imp, list_distinct(flatten(list(entities))) AS past FROM (SELECT DISTINCT imp, item FROM hist0) JOIN art USING (item) GROUP BY imp)
, hn AS (SELECT imp, count(*) AS hl, ln(1 + greatest(avg(CASE WHEN isnan(read_time) THEN 0 ELSE coalesce(read_time, 0) END), 0)) AS rd, avg(scroll) AS sr FROM hist0 GROUP BY imp)
, wide AS (
    SELECT c.*, {counts}, bm25, emb, es, published, entities, past, same, known, hl, rd, sr
    FROM cand c JOIN bs ON bs.imp = c.imp AND bs.item = c.item JOIN cs ON cs.imp = c.imp AND cs.item = c.item JOIN ce ON ce.imp = c.imp AND ce.item = c.item LEFT JOIN art ON art.item = c.item
    LEFT JOIN hc ON hc.imp = c.imp AND hc.category = art.category LEFT JOIN ht ON ht.imp = c.imp LEFT JOIN he ON he.imp = c.imp LEFT JOIN hn ON hn.imp = c.imp
)
SELECT imp, item, label::BIGINT AS label, {', '.join(f'round((({x})::FLOAT)::DOUBLE, 4) AS {name}' for name, x in made.items())} FROM wide"""


_FEATURES = _feature_sql()
ORACLE: dict[str, str] = {
    "impressions_normalised": f"""{_LOG} SELECT imp AS impression_id, user_id, ts AS "timestamp", string_agg(item, ',' ORDER BY pos) AS candidates, coalesce(string_agg(item, ',' ORDER BY pos) FILTER (WHERE label = 1), '') AS clicked,
        (SELECT count(*) FROM hist0 WHERE hist0.imp = cand.imp) AS hist_len FROM cand GROUP BY imp, user_id, ts""",
    "impressions_split_counts": f"{_LOG} SELECT {_SPLIT.format(t='ts')} AS split, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM imps GROUP BY 1",
    "articles_dedup_keep_first": """WITH u AS (SELECT doc_id AS article_id, text AS title, 0 AS n FROM documents UNION ALL SELECT item_id + 190, text, 1 FROM benchmark)
        SELECT article_id, title FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY n, title) AS r FROM u) WHERE r = 1""",
    "packed_pairs_parse": f"{_L2} SELECT imp, string_agg(item, ',' ORDER BY pos) AS candidates, coalesce(string_agg(item, ',' ORDER BY pos) FILTER (WHERE label = 1), '') AS clicked, count(*) AS n FROM cand GROUP BY imp",
    "json_entities_parse": "SELECT doc_id, CASE WHEN source = lang THEN source WHEN doc_id % 5 <> 0 THEN source || ',' || lang ELSE lang || ',' || source END AS entities, CASE WHEN source = lang THEN 1 ELSE 2 END::BIGINT AS n FROM documents",
    "history_tokens_nonempty": f"{_LOG} SELECT imp AS impression_id, (SELECT count(*) FROM hist0 WHERE hist0.imp = imps.imp) AS n FROM imps",
    "clock_text_parse": "SELECT event_id, strptime(strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p'), '%m/%d/%Y %I:%M:%S %p') AS ts FROM events",
    "recency_seconds": f"{_LOG} SELECT imp AS impression_id, CAST(floor((us - (SELECT max(h_us) FROM hist0 WHERE hist0.imp = imps.imp)) / 1e6) AS DOUBLE) AS recency_seconds FROM imps",
    "latest_click_before": f"{_LOG} SELECT imp, us - (SELECT max(h_us) FROM hist0 WHERE hist0.imp = imps.imp) AS since_us FROM imps",
    "history_last_n": f"{_LOG} SELECT imp AS impression_id, coalesce((SELECT string_agg(item, ',' ORDER BY h) FROM hist0 WHERE hist0.imp = cand.imp AND h > hist_len - 3), '') AS last, string_agg(item, ',' ORDER BY pos) FILTER (WHERE pos <= 2) AS head FROM cand GROUP BY imp",
    "pop_causal_unbounded": f"{_scored(_POP + ' AS n')} SELECT imp, item, n FROM s",
    "pop_causal_6h": f"{_scored(_count(6, True) + ' AS n')} SELECT imp, item, n FROM s",
    "exp_causal_24h": f"{_scored(_count(24, False) + ' AS n')} SELECT imp, item, n FROM s",
    "pop_causal_l2": f"{_L2} SELECT item, sum({_count(24 * 90, True)})::BIGINT AS n, sum({_count(None, True)})::BIGINT AS past FROM cand c GROUP BY item",
    "exposure_features": f"""{_scored(_count(6, False) + ' AS exp_causal, ' + _count(24, False) + ' AS exp_24h')},
        k AS (SELECT *, count(*) OVER (PARTITION BY imp) AS nn, rank() OVER (PARTITION BY imp ORDER BY exp_causal) + (count(*) OVER (PARTITION BY imp, exp_causal) - 1) / 2.0 AS a, max(exp_causal) OVER (PARTITION BY imp) AS top FROM s)
        SELECT imp, item, exp_causal, exp_24h, round(exp_causal / (exp_24h + 1), 6) AS exp_velocity, CASE WHEN nn = 1 THEN 0.5::DOUBLE ELSE round(((a - 1) / (nn - 1))::DOUBLE, 6) END AS exp_rank, round(exp_causal / (top + 1), 6) AS exp_rel_max FROM k""",
    "pop_rank": f"""{_scored(_POP + ' AS n')}, k AS (SELECT *, count(*) OVER (PARTITION BY imp) AS nn, (rank() OVER (PARTITION BY imp ORDER BY n) + (count(*) OVER (PARTITION BY imp, n) - 1) / 2.0)::DOUBLE AS a, max(n) OVER (PARTITION BY imp) AS top, row_number() OVER (PARTITION BY imp ORDER BY n DESC, pos) AS o FROM s)
        SELECT imp, item, CASE WHEN nn = 1 THEN 0.5::DOUBLE ELSE round((a - 1) / (nn - 1), 6) END AS pop_rank, round(n / (top + 1), 6) AS pop_rel_max, a AS average, o AS ordinal FROM k""",
    "age_recency": f"{_LOG}{_ART} SELECT imp, item, coalesce(round((us - epoch_us(published)) / 3.6e9, 6), -1) AS age_hours, CASE WHEN published IS NULL THEN 0 ELSE round(pow(0.5::DOUBLE, greatest((us - epoch_us(published)) / 3.6e9, 0) / 24.0), 6) END AS recency FROM cand LEFT JOIN art USING (item)",
    "cat_match": f"""{_LOG}{_ART}, hc AS (SELECT imp, category, count(*) AS same FROM hist0 JOIN art USING (item) WHERE category IS NOT NULL GROUP BY ALL), ht AS (SELECT imp, sum(same) AS known FROM hc GROUP BY imp)
        SELECT c.imp, c.item, round(coalesce(same, 0)::DOUBLE / greatest(coalesce(known, 0), 1), 6) AS cat_match FROM cand c LEFT JOIN art USING (item) LEFT JOIN hc ON hc.imp = c.imp AND hc.category = art.category LEFT JOIN ht ON ht.imp = c.imp""",
    "ent_overlap": f"""{_LOG}{_ART}, he AS (SELECT imp, list_distinct(flatten(list(entities))) AS past FROM hist0 JOIN art USING (item) GROUP BY imp)
        SELECT c.imp, c.item, round(CASE WHEN len(entities) > 0 AND len(past) > 0 THEN len(list_intersect(entities, past))::DOUBLE / len(list_distinct(list_concat(entities, past))) ELSE 0 END, 6) AS ent_overlap FROM cand c LEFT JOIN art USING (item) LEFT JOIN he ON he.imp = c.imp""",
    "user_engagement": f"{_LOG} SELECT imp, round(ln(1 + greatest(avg(CASE WHEN isnan(read_time) THEN 0 ELSE coalesce(read_time, 0) END), 0)), 6) AS user_read, round(avg(scroll), 6) AS user_scroll FROM hist0 GROUP BY imp",
    "n_cands_hist_len": f"{_LOG} SELECT imp AS impression_id, count(*) AS n_cands, (SELECT count(*) FROM hist0 WHERE hist0.imp = cand.imp) AS hist_len, sum(label)::BIGINT AS n_clicked FROM cand GROUP BY imp",
    "user_vector_mean": f"{_user(_LAST10)} SELECT imp, round(max(x) FILTER (WHERE d = 0), 6) AS u0, round(max(x) FILTER (WHERE d = 1), 6) AS u1, round(max(x) FILTER (WHERE d = 63), 6) AS u63, round(sqrt(sum(x * x)), 5) AS norm FROM uv GROUP BY imp",
    "user_vector_weighted": f"{_user(_READ)} SELECT imp, round(max(x) FILTER (WHERE d = 0), 6) AS u0, round(max(x) FILTER (WHERE d = 1), 6) AS u1, round(max(x) FILTER (WHERE d = 63), 6) AS u63 FROM uv GROUP BY imp",
    "cosine_pool": f"{_user(_LAST10)}{_COS} SELECT imp, item, round(emb, 6) AS emb FROM cs",
    "engage_sim": f"{_user(_READ)}{_COS} SELECT imp, item, round(emb, 6) AS engage_sim FROM cs",
    "knn_exact_topk": f"""{_LOG}{_VEC}, p AS (SELECT a.item AS query, b.item AS item, list_dot_product(a.v, b.v) AS s FROM vec a, vec b), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, item) AS rank FROM p)
        SELECT query, item, round(s, 6) AS score, rank FROM k WHERE rank <= 10""",
    "knn_overfetch_filtered": f"""{_user(_LAST10)}{_ART}, ul AS (SELECT imp, list(x ORDER BY d) AS u FROM uv GROUP BY imp), p AS (SELECT imp, vec.item, list_dot_product(u, v) AS s FROM ul, vec),
        k AS (SELECT *, row_number() OVER (PARTITION BY imp ORDER BY round(s, 9) DESC, item) AS rank FROM p), f AS (SELECT k.imp, k.item, row_number() OVER (PARTITION BY k.imp ORDER BY rank) AS r FROM k JOIN imps USING (imp) LEFT JOIN art ON art.item = k.item WHERE rank <= 600 AND (published IS NULL OR published <= ts))
        SELECT imp AS query, count(*) AS n, md5(string_agg(item, ',' ORDER BY r)) AS items_md5 FROM f WHERE r <= 200 GROUP BY imp""",
    "bm25_postings_stats": f"WITH one AS (SELECT 1){_bm25('documents', 'doc_id', 'text')} SELECT term, max(df) AS df, sum(tf)::BIGINT AS cf, round(max(weight), 6) AS top_weight FROM post GROUP BY term",
    "bm25_topk": f"WITH one AS (SELECT 1){_bm25('documents', 'doc_id', 'text')}{_BENCH} SELECT item_id, doc AS doc_id, round(score, 5) AS score, rank FROM top JOIN benchmark ON text = query WHERE rank <= 20",
    "bm25_pool_scores": f"{_LOG}{_ART}{_POOL} SELECT imp, item, round(bm25, 5) AS bm25 FROM bs",
    "bm25_hit_rate": f"""WITH one AS (SELECT 1){_bm25('documents', 'doc_id', 'text')}{_BENCH}, hit AS (SELECT item_id, coalesce(bool_or(doc IN (item_id, item_id + 40, item_id + 80)), FALSE) AS h FROM benchmark LEFT JOIN top ON query = text AND rank <= 50 GROUP BY item_id)
        SELECT count(*) AS lists, round(avg(CAST(h AS INT)), 6) AS hit_rate FROM hit""",
    "zscore_fusion": f"{_user(_LAST10)}{_ART}{_COS}{_POOL}, j AS (SELECT cs.imp, cs.item, round(emb, 9) AS emb, round(bm25, 9) AS bm25 FROM cs JOIN bs ON bs.imp = cs.imp AND bs.item = cs.item) SELECT imp, item, round(0.6::DOUBLE * ({_z('emb')}) + (1 - 0.6::DOUBLE) * ({_z('bm25')}), 5) + 0.0 AS score FROM j",
    "alpha_sweep": f"{_SWEEP}{_metrics('sw', 'imp, alpha')} SELECT alpha, count(*) AS lists, round(avg(auc_ordinal), 6) AS auc FROM m GROUP BY alpha",
    "alpha_best": f"{_SWEEP}{_metrics('sw', 'imp, alpha')}, b AS (SELECT alpha, round(avg(auc_ordinal), 9) AS auc FROM m GROUP BY alpha) SELECT alpha, round(auc, 6) AS auc FROM b ORDER BY b.auc DESC, alpha LIMIT 1",
    "entity_blend": f"""{_user(_LAST10)}{_ART}{_COS}, he AS (SELECT imp, list_distinct(flatten(list(entities))) AS past FROM hist0 JOIN art USING (item) GROUP BY imp),
        j AS (SELECT cs.imp, cs.item, round(emb, 9) AS emb, round(CASE WHEN len(entities) > 0 AND len(past) > 0 THEN len(list_intersect(entities, past))::DOUBLE / len(list_distinct(list_concat(entities, past))) ELSE 0 END, 9) AS ent FROM cs LEFT JOIN art USING (item) LEFT JOIN he ON he.imp = cs.imp)
        SELECT imp, item, round(0.3::DOUBLE * ({_z('ent')}) + (1 - 0.3::DOUBLE) * ({_z('emb')}), 5) + 0.0 AS score FROM j""",
    "leaky_arm": f"{_scored(_POP + ' AS n')}{_ART}, j AS (SELECT imp, s.item, n::DOUBLE AS n, ln(1 + coalesce(total_inviews, 0)) AS p FROM s LEFT JOIN art USING (item)) SELECT imp, item, round({_z('n')} + {_z('p')}, 5) + 0.0 AS leaky FROM j",
    "feature_table": _FEATURES,
    "leaky_totals": f"{_LOG}{_ART} SELECT imp, c.item, round(ln(1 + coalesce(CASE WHEN CAST(art.item AS INT) % 3 <> 0 THEN total_inviews END, 0)), 6) AS log_total_inviews FROM cand c LEFT JOIN art ON art.item = c.item",
    "block_history": f"""{_LOG}, r AS (SELECT user_id, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 'test' ELSE 'early' END AS block, count(*) AS clicks FROM ev WHERE click GROUP BY ALL), i AS (SELECT *, {_SPLIT.format(t='ts')} AS split, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 'test' ELSE 'early' END AS block FROM imps)
        SELECT imp, split, i.block, clicks FROM i LEFT JOIN r ON r.user_id = i.user_id AND r.block = i.block""",
    "constant_check": f"""{_scored(_count(6, False) + ' AS exp_causal, ' + _count(24, False) + ' AS exp_24h')}, k AS (SELECT *, count(*) OVER (PARTITION BY imp) AS nn, (rank() OVER (PARTITION BY imp ORDER BY exp_causal) + (count(*) OVER (PARTITION BY imp, exp_causal) - 1) / 2.0)::DOUBLE AS a FROM s),
        t AS (SELECT 0.0::DOUBLE AS bm25, NULL::DOUBLE AS emb, exp_causal, exp_24h, CASE WHEN nn = 1 THEN 0.5::DOUBLE ELSE (a - 1) / (nn - 1) END AS exp_rank FROM k)
        SELECT {', '.join(f'count(DISTINCT {c}) <= 1 AS {c}' for c in ('bm25', 'emb', 'exp_causal', 'exp_24h', 'exp_rank'))} FROM t""",
    "bm25_fields_ablation": f"""WITH one AS (SELECT 1){_ART}, tx AS (SELECT item, title AS text FROM art){_bm25("tx", "item", "text")}, a AS (SELECT count(DISTINCT doc) AS docs, count(DISTINCT term) AS terms, count(*) AS postings, round(sum(weight), 3) AS weight, 'title' AS variant FROM post),
        ty AS (SELECT item, title || ' ' || body AS text FROM art){_bm25("ty", "item", "text").replace("toks", "toks2").replace(", tf AS", ", tf2 AS").replace("FROM tf ", "FROM tf2 ").replace("dl AS (", "dl2 AS (").replace("dfs AS (", "dfs2 AS (").replace("FROM dl)", "FROM dl2)").replace("JOIN dfs USING", "JOIN dfs2 USING").replace("JOIN dl USING", "JOIN dl2 USING").replace(", sz AS", ", sz2 AS").replace("USING (doc), sz", "USING (doc), sz2").replace(", post AS", ", post2 AS")}
        SELECT * FROM a UNION ALL SELECT count(DISTINCT doc), count(DISTINCT term), count(*), round(sum(weight), 3), 'title and body' FROM post2""",
    "candidate_pools": f"""{_LOG}{_VEC}{_ART}, p AS (SELECT a.item AS query, b.item AS item, list_dot_product(a.v, b.v) AS s FROM vec a, vec b WHERE CAST(a.item AS INT) % 100 = 0), dense AS (SELECT query, item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, item) AS r FROM p) WHERE r <= 10)
        {_bm25("art", "item", "body")}, qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT title AS query, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}')) AS term FROM (SELECT DISTINCT title FROM art WHERE CAST(item AS INT) % 100 = 0)) GROUP BY ALL),
        sc AS (SELECT query, doc, sum(qtf * weight) AS score FROM qt JOIN post USING (term) GROUP BY ALL), lx AS (SELECT art.item AS query, doc AS item FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS r FROM sc) k JOIN art ON art.title = k.query AND CAST(art.item AS INT) % 100 = 0 WHERE r <= 10)
        SELECT query, count(*) AS pool FROM (SELECT * FROM dense UNION SELECT * FROM lx) GROUP BY query""",
    "retrieval_track": f"""{_LOG}{_ART}{_POOL_QUERY}, cl AS (SELECT imp, ts, list(DISTINCT item) AS clicked FROM cand WHERE label = 1 GROUP BY ALL), ask AS (SELECT * FROM hq JOIN cl USING (imp))
        {_bm25("art", "item", "body")}, qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}')) AS term FROM (SELECT DISTINCT query FROM ask)) GROUP BY ALL),
        sc AS (SELECT query, doc, sum(qtf * weight) AS score FROM qt JOIN post USING (term) GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM sc) WHERE rank <= 600),
        f AS (SELECT imp, doc, row_number() OVER (PARTITION BY imp ORDER BY rank) AS r FROM ask JOIN k USING (query) LEFT JOIN art ON art.item = doc WHERE published IS NULL OR published <= ts),
        n AS (SELECT imp, len(any_value(clicked)) AS n, {', '.join(f'count(DISTINCT doc) FILTER (WHERE r <= {k} AND list_contains(clicked, doc)) AS h{k}' for k in (50, 100, 200))} FROM ask LEFT JOIN f USING (imp) GROUP BY imp)
        SELECT count(*) AS lists, {', '.join(f'round(avg(h{k}::DOUBLE / n), 6) AS recall_{k}' for k in (50, 100, 200))} FROM n""",
    "ranking_metrics": f"{_scored(_DAY + ' AS score')}{_metrics('s')} SELECT imp, n, n_pos, {_ROUNDED} FROM m",
    "auc_summary": f"{_scored(_POP + ' AS score')}{_metrics('s')} SELECT 'pop' AS system, count(*) AS lists, {_MEANS} FROM m",
    "ranking_metrics_l2": f"{_L2}, s AS (SELECT imp, pos, label, price AS score FROM cand){_metrics('s')} SELECT 'price' AS system, count(*) AS lists, {_MEANS} FROM m",
    "recall_at_k": f"{_TOP.format(k=1000000)} SELECT imp, {', '.join(f'round(sum(CASE WHEN label = 1 AND r <= {k} THEN 1 ELSE 0 END)::DOUBLE / sum(label), 6) AS recall_{k}' for k in (1, 2, 5))} FROM top GROUP BY imp HAVING sum(label) > 0",
    "diversity": f"""{_TOP.format(k=10)}{_ART}, q AS (SELECT imp, CASE WHEN CAST(art.item AS INT) % 9 <> 0 THEN category END AS category, count(*) AS c FROM top LEFT JOIN art ON art.item = top.item GROUP BY ALL)
        SELECT imp, round(CASE WHEN sum(c) < 2 THEN 0 ELSE 1 - sum(c * (c - 1))::DOUBLE / (sum(c) * (sum(c) - 1)) END, 6) AS diversity FROM q GROUP BY imp""",
    "novelty": f"{_TOP.format(k=10)}{_TRAIN.format(more='AND CAST(item AS INT) % 10 <> 3')}, t AS (SELECT coalesce(sum(tn), 0)::DOUBLE AS total FROM tc) SELECT imp, round(avg(CASE WHEN tn IS NULL THEN log2(total + 1) ELSE -log2(tn / total) END), 6) AS novelty FROM top LEFT JOIN tc ON tc.item = top.item, t GROUP BY imp",
    "coverage": f"{_TOP.format(k=1)} SELECT {_SPLIT.format(t='ts')} AS split, count(DISTINCT item) AS surfaced, (SELECT count(*) FROM documents) AS size, round(count(DISTINCT item)::DOUBLE / (SELECT count(*) FROM documents), 6) AS coverage FROM top GROUP BY 1",
    "slices_cold_warm": f"""{_LOG}, l AS (SELECT imp, (SELECT count(*) FROM hist0 WHERE hist0.imp = imps.imp) AS hl FROM imps), e AS (SELECT quantile_cont(hl, 0.1) AS edge FROM l)
        SELECT CASE WHEN hl = 0 THEN 'zero_history' WHEN hl <= edge THEN 'cold' ELSE 'warm' END AS slice, count(*) AS n, min(hl) AS lo, max(hl) AS hi FROM l, e GROUP BY 1 HAVING count(*) >= 30""",
    "slices_head_tail": f"""{_LOG}{_TRAIN.format(more='')}, p AS (SELECT imp, coalesce(max(CASE WHEN label = 1 THEN coalesce(tn, 0) END), 0) AS popularity FROM cand LEFT JOIN tc ON tc.item = cand.item GROUP BY imp), e AS (SELECT coalesce(quantile_cont(popularity, 0.8), 0) AS edge FROM p WHERE popularity > 0)
        SELECT CASE WHEN popularity >= edge THEN 'head' ELSE 'tail' END AS slice, count(*) AS n, max(popularity) AS hi FROM p, e GROUP BY 1 HAVING count(*) >= 30""",
    "slice_report": f"{_scored(_DAY + ' AS score')}{_metrics('s')} SELECT {_SPLIT.format(t='ts')} AS slice, count(*) AS lists, round(avg(auc_ordinal), 6) AS auc_ordinal, round(avg(auc_midrank), 6) AS auc_midrank, round(avg(ndcg_10), 6) AS ndcg_10 FROM m JOIN imps USING (imp) GROUP BY 1 HAVING count(*) >= 30",
    "length_quantiles": "SELECT lang, count(*) AS rows, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, round(quantile_cont(length(text), 0.95), 6) AS p95 FROM documents GROUP BY lang",
    "compare_arms": f"{_scored(_POP + ' AS score')}{_metrics('s')}, s2 AS (SELECT c.*, {_DAY} AS score FROM cand c){_metrics('s2', to='m2')} SELECT count(*) AS lists, round(avg(m.auc_midrank), 6) AS a, round(avg(m2.auc_midrank), 6) AS b, round(avg(m2.auc_midrank - m.auc_midrank), 6) AS delta, count(*) FILTER (WHERE m2.auc_midrank - m.auc_midrank > 1e-12) AS better FROM m JOIN m2 USING (imp)",
    "quality_split_order": f"""{_LOG}, q AS (SELECT {_SPLIT.format(t='ts')} AS split, min(ts) AS lo, max(ts) AS hi, count(*) AS n FROM imps GROUP BY 1)
        SELECT split, lo, hi, n, coalesce(lo > max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS follows FROM q""",
    "quality_rows": f"""{_LOG}{_QUALITY}
        SELECT log, 'history_past' AS "check", count(*) FILTER (WHERE len(hts) > 0) AS compared, count(*) FILTER (WHERE list_max(hts) >= ts) AS violations FROM logs GROUP BY log
        UNION ALL SELECT log, 'clicked_subset', count(*) FILTER (WHERE len(clicked) > 0), count(*) FILTER (WHERE len(list_filter(clicked, lambda x: NOT list_contains(cands, x))) > 0) FROM logs GROUP BY log
        UNION ALL SELECT log, 'history_lengths', count(hts), count(*) FILTER (WHERE len(hts) <> hl) FROM logs GROUP BY log
        UNION ALL SELECT log, 'recency_positive', count(since), count(*) FILTER (WHERE since <= 0) FROM logs GROUP BY log""",
    "quality_ids": f"""{_LOG}{_ART}, used AS (SELECT item FROM cand UNION SELECT item FROM hist0), known AS (SELECT item FROM art WHERE CAST(item AS INT) % 20 <> 5)
        SELECT 'ids_resolve' AS "check", count(*) AS compared, count(*) FILTER (WHERE item NOT IN (SELECT item FROM known) OR item = '') AS violations FROM used
        UNION ALL SELECT 'published_after', count(published), count(*) FILTER (WHERE published > (SELECT max(ts) FROM imps)) FROM art""",
    "quality_coverage": f"""{_LOG}, u AS (SELECT DISTINCT item FROM cand), f AS (SELECT item, (SELECT count(*) FROM embeddings WHERE CAST(vec_id AS VARCHAR) = item) > 0 AS f, (SELECT count(*) FROM embeddings WHERE CAST(vec_id AS VARCHAR) = item AND vec_id % 10 <> 0) > 0 AS f9 FROM u)
        SELECT count(*) AS wanted, count(*) FILTER (WHERE f) AS found, count(*) FILTER (WHERE f) >= 0.95 * count(*) AS enough, 'all' AS ids FROM f UNION ALL SELECT count(*), count(*) FILTER (WHERE f9), count(*) FILTER (WHERE f9) >= 0.95 * count(*), 'nine tenths' FROM f""",
    "rank_export": f"{_RANKS} SELECT imp, imp || ' [' || string_agg(r, ',' ORDER BY pos) || ']' AS line FROM rr GROUP BY imp",
    "rank_validate": f"""{_RANKS}, e AS (SELECT imp, count(*) AS n, list(r ORDER BY pos) AS ranks, row_number() OVER (ORDER BY imp) AS row FROM rr GROUP BY imp),
        files AS (SELECT 'good' AS file, row, imp::VARCHAR AS id, imp::VARCHAR AS got, n, ranks FROM e
            UNION ALL SELECT 'bad', row, imp::VARCHAR, CASE WHEN row % 7 = 3 THEN 'no such' ELSE imp::VARCHAR END, n, CASE WHEN row % 7 = 1 AND n > 1 THEN list_concat([ranks[2]], ranks[2:]) WHEN row % 7 = 2 THEN list_append(ranks, 1) ELSE ranks END FROM e)
        SELECT count(id) AS expected, count(got) AS found, count(*) FILTER (WHERE id IS DISTINCT FROM got) AS out_of_order, count(*) FILTER (WHERE len(ranks) <> n) AS wrong_length,
               count(*) FILTER (WHERE len(ranks) = n AND list_sort(ranks) <> range(1, n + 1)) AS bad_permutation, file FROM files GROUP BY file""",
    "sweep_halflife": f"{_LOG}{_ART}, sw AS (SELECT imp, pos, label, hl AS half_life, CASE WHEN published IS NULL THEN 0 ELSE round(pow(0.5::DOUBLE, greatest((us - epoch_us(published)) / 3.6e9, 0) / hl), 9) END AS score FROM cand LEFT JOIN art USING (item), (SELECT unnest([6.0, 24.0, 72.0, 240.0])::DOUBLE AS hl) q){_metrics('sw', 'imp, half_life')} SELECT half_life, count(*) AS lists, round(avg(auc_midrank), 6) AS auc FROM m GROUP BY half_life",
    "sweep_window": f"""{_scored(', '.join(f'{_count(h, True)} AS {w}' for w, h in (('w1', 1), ('w6', 6), ('w24', 24), ('w72', 72), ('past', None))))}, sw AS (SELECT imp, pos, label, win AS "window", CASE win WHEN 'w1' THEN w1 WHEN 'w6' THEN w6 WHEN 'w24' THEN w24 WHEN 'w72' THEN w72 ELSE past END AS score FROM s, (SELECT unnest(['w1', 'w6', 'w24', 'w72', 'past']) AS win) q){_metrics('sw', 'imp, "window"')}
        SELECT "window", count(*) AS lists, round(avg(auc_midrank), 6) AS auc FROM m GROUP BY 1""",
    "sweep_history_n": f"""{_LOG}{_VEC}, h AS (SELECT imp, item, last, 1.0::DOUBLE AS w FROM hist0, (SELECT unnest([1, 5, 10, 50]) AS last) q WHERE h > hist_len - last){_USER.format(by='imp, last')},
        sw AS (SELECT c.imp, c.pos, c.label, uv.last, round(sum(uv.x * dims.x), 7) AS score FROM cand c JOIN dims ON dims.item = c.item JOIN uv ON uv.imp = c.imp AND uv.d = dims.d GROUP BY ALL){_metrics('sw', 'imp, last')} SELECT last, count(*) AS lists, round(avg(auc_midrank), 4) AS auc FROM m GROUP BY last""",
    "sweep_history_weighted": f"""{_LOG}{_VEC}, h AS (SELECT imp, item, last, ln(1 + greatest(CASE WHEN isnan(read_time) THEN 0 ELSE coalesce(read_time, 0) END, 0)) AS w FROM hist0, (SELECT unnest([1, 5, 10, 50]) AS last) q WHERE h > hist_len - last){_USER.format(by='imp, last')},
        sw AS (SELECT c.imp, c.pos, c.label, uv.last, round(sum(uv.x * dims.x), 7) AS score FROM cand c JOIN dims ON dims.item = c.item JOIN uv ON uv.imp = c.imp AND uv.d = dims.d GROUP BY ALL){_metrics('sw', 'imp, last')} SELECT last, count(*) AS lists, round(avg(auc_midrank), 4) AS auc FROM m GROUP BY last""",
    "seeded_sample": "SELECT p_partkey, p_brand FROM part ORDER BY md5(p_partkey || ':13'), p_partkey LIMIT 100",
    "negative_sampling": f"""{_LOG}, pool AS (SELECT imp, list(item ORDER BY md5(imp || ':' || item || ':13'), item) AS pool FROM cand WHERE label = 0 GROUP BY imp),
        f AS (SELECT imp, item, pool, ('0x' || substr(md5(item || ':13'), 1, 15))::BIGINT % len(pool) AS first FROM cand JOIN pool USING (imp) WHERE label = 1)
        SELECT imp, item, list_aggregate(list_transform(range(4), lambda i: pool[((first + i) % len(pool) + 1)::INT]), 'string_agg', ',') AS negatives FROM f""",
    "sweep_scroll": f"{_LOG} SELECT least, round(avg(CAST(scroll >= least AS INT)), 6) AS kept, count(DISTINCT CASE WHEN scroll >= least THEN imp END) AS users FROM hist0, (SELECT unnest([0.0, 25.0, 50.0, 90.0])::DOUBLE AS least) q GROUP BY least",
    "exposure_stream": f"{_LOG} SELECT item, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM ev GROUP BY ALL",
}
