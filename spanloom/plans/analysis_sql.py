"""The SQL of :mod:`.analysis_queries`."""

from ..functions import privacy, scalar

_catalog = {n: (p, label, risk) for n, p, label, risk in privacy.CATALOG}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(name: str) -> str:
    return f"coalesce(len(regexp_extract_all(text, {_lit(privacy.FLAGS + _catalog[name][0])})), 0)"


_redacted = "text"
for _n, (_p, _label, _r) in _catalog.items():
    _redacted = f"regexp_replace({_redacted}, {_lit(privacy.FLAGS + _p)}, '[{_label}]', 'g')"
_points = " + ".join(f"{_count(n)} * {privacy.RISK[_catalog[n][2]]}" for n in _catalog)
_standard = "CASE " + " ".join(f"WHEN s % 61 >= {lo}::DOUBLE AND s % 61 < {hi}::DOUBLE THEN {v}::DOUBLE" for v, lo, hi in scalar.FPS_STANDARDS) + " ELSE s % 61 END"
_record = "concat_ws('|', " + ", ".join(f"length(coalesce({c}::VARCHAR, '')) || ':' || coalesce({c}::VARCHAR, '')" for c in ("event_id", "event_type", "props")) + ")"
_place = lambda key: f"md5('7:' || {key}::VARCHAR)"
_tree = "tree AS (SELECT vec_id // 2 AS parent, vec_id AS child FROM embeddings WHERE vec_id > 1 OR vec_id = 1)"
_age = "(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 1000000 / 3600.0::DOUBLE"

_looped = "edges AS (SELECT vec_id // 2 AS parent, vec_id AS child FROM embeddings WHERE vec_id > 0 AND vec_id // 2 <> vec_id UNION SELECT vec_id, vec_id // 4 FROM embeddings WHERE vec_id % 50 = 0 AND vec_id > 0)"

ORACLE_SQL = {
    "latency_profile_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, " + ", ".join(f"round(quantile_cont(value, {q / 100}), 6) AS p{q}" for q in (50, 90, 95, 99)) + " FROM events GROUP BY event_type",
    "quality_distribution": """WITH j AS (SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), l AS (
      SELECT 'lang' AS dimension, lang AS value FROM j UNION ALL SELECT 'source', source FROM j UNION ALL SELECT 'quality', quality::VARCHAR FROM j UNION ALL SELECT 'toxic', toxic::VARCHAR FROM j)
      SELECT dimension, value, n, round(n / sum(n) OVER (PARTITION BY dimension), 6) AS share FROM (SELECT dimension, value, count(*) AS n FROM l GROUP BY dimension, value)""",
    "quality_cube": "SELECT lang, quality, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, quantile_cont(n_chars, 0.5) AS median_chars FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, quality)",
    "min_sample_warnings": "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) < 10",
    "coverage_full_outer": "SELECT CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'both' WHEN d.doc_id IS NOT NULL THEN 'text' ELSE 'label' END AS side, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL",
    "caption_stats": r"""WITH w AS (SELECT conv_id, length(text) AS chars, regexp_extract_all(lower(text), '\S+') AS w FROM conversations)
      SELECT conv_id, sum(len(w))::BIGINT AS words, len(list_distinct(flatten(list(w))))::INT AS distinct_words, round(avg(chars), 6) AS mean_chars, round(len(list_distinct(flatten(list(w)))) / sum(len(w)), 6) AS diversity FROM w GROUP BY conv_id""",
    "keyword_topk": """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents), n AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
      SELECT lang, word, n, pos::INT AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS pos FROM n) WHERE pos <= 10""",
    "pii_detect_counts": " UNION ALL ".join(f"SELECT '{n}' AS category, sum({_count(n)})::BIGINT AS n FROM documents" for n in _catalog),
    "pii_risk": f"WITH p AS (SELECT doc_id, ({_points})::BIGINT AS points FROM documents) SELECT doc_id, points, CASE WHEN points = 0 THEN 'none' WHEN points < 10 THEN 'low' WHEN points < 50 THEN 'medium' ELSE 'high' END AS level FROM p",
    "pii_redact_plain": f"WITH r AS (SELECT doc_id, {_redacted} AS t FROM documents) SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM r",
    "anonymise": "SELECT event_id, substr(sha256(user_id::VARCHAR), 1, 16) AS user_hash, event_type, true AS anonymised FROM events",
    "question_type": "WITH q AS (SELECT CASE WHEN turn % 8 < 6 THEN list_extract(['what', 'who', 'where', 'when', 'why', 'how'], (turn % 8 + 1)::INT) || ' ' || text WHEN turn % 8 = 6 THEN 'Tell what happens: ' || text ELSE text END AS text FROM conversations) SELECT CASE " + " ".join(f"WHEN starts_with(lower(text), '{w}') THEN '{w}'" for w in scalar.QUESTION_WORDS) + " WHEN contains(lower(text), 'what happens') THEN 'event' ELSE 'other' END AS kind, count(*) AS n FROM q GROUP BY ALL",
    "timecode_suite": f"WITH e AS (SELECT event_id, (epoch_us(ts) % 3600000000) / 1e6::DOUBLE AS s FROM events) SELECT event_id, floor(s * 29.97::DOUBLE)::BIGINT AS floor, ceil(s * 29.97::DOUBLE)::BIGINT AS ceil, round(floor(s)::BIGINT / 29.97::DOUBLE, 6) AS time, {_standard} AS standard FROM e",
    "geometry_suite": """WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS x, (p_retailprice % 100) / 100.0::DOUBLE AS y FROM part),
      i AS (SELECT *, greatest(0, least(x + 0.2::DOUBLE, 0.9::DOUBLE) - greatest(x, 0.4::DOUBLE)) * greatest(0, least(y + 0.3::DOUBLE, 0.9::DOUBLE) - greatest(y, 0.4::DOUBLE)) AS both_ FROM p)
      SELECT p_partkey, round(both_ / (0.2::DOUBLE * 0.3::DOUBLE + 0.25::DOUBLE - both_), 6) AS iou, round(CASE WHEN y > 0 THEN x / y ELSE 0 END, 6) AS aspect,
      CASE WHEN x * y < 0.01 THEN 'tiny' WHEN x * y < 0.05 THEN 'small' WHEN x * y < 0.2 THEN 'medium' WHEN x * y < 0.5 THEN 'large' ELSE 'very_large' END AS band, CASE WHEN y < 0.5 THEN 'top' ELSE 'bottom' END || '_' || CASE WHEN x < 0.5 THEN 'left' ELSE 'right' END AS quadrant FROM i""",
    "priority_decay": f"""WITH e AS (SELECT event_id, value / 500 AS u, {_age} AS age FROM events) SELECT event_id, round((0.5 * u + 0.25) * pow(0.95::DOUBLE, age), 6) AS priority, round(greatest(0.4 * u, 0.01), 6) AS initial, round(u * 0.625 * exp(-age / 24) * 0.875, 6) AS weight FROM e""",
    "fleiss_kappa": """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL), i AS (SELECT sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY l_orderkey), o AS (SELECT avg((sq - n) / (n * (n - 1))::DOUBLE) AS observed FROM i WHERE n > 1),
      h AS (SELECT sum(n * n) / (sum(n) * sum(n))::DOUBLE AS chance FROM (SELECT sum(c) AS n FROM c GROUP BY l_returnflag))
      SELECT round(observed, 6) AS observed, round(chance, 6) AS chance, round((observed - chance) / (1 - chance), 6) AS kappa FROM o, h""",
    "icc": """WITH g AS (SELECT count(*)::DOUBLE AS k, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY l_orderkey), s AS (SELECT count(*) AS n, sum(k) AS total, sum(k * k) AS kk, sum(k * m) AS km, sum(k * m * m) AS kmm, sum(k * v) AS within FROM g),
      q AS (SELECT n, (kmm - km * km / total) / (n - 1) AS msb, within / (total - n) AS msw, (total - kk / total) / (n - 1) AS k0 FROM s)
      SELECT n, round(msb, 6) AS msb, round(msw, 6) AS msw, round((msb - msw) / (msb + (k0 - 1) * msw), 6) AS icc FROM q""",
    "cohen_weighted": """WITH l AS (SELECT floor(l_quantity / 10.001::DOUBLE)::INT AS a, floor(l_discount * 49)::INT AS b FROM lineitem), e AS (SELECT sum(abs(x.a - y.b) / 4.0::DOUBLE * x.n * y.n) AS e FROM (SELECT a, count(*) AS n FROM l GROUP BY a) x, (SELECT b, count(*) AS n FROM l GROUP BY b) y)
      SELECT count(*) AS n, round(1 - avg(abs(a - b) / 4.0::DOUBLE) / (any_value(e) / (count(*) * count(*))), 6) AS kappa FROM l, e""",
    "ttest_and_wilcoxon": """WITH l AS (SELECT l_returnflag, l_quantity - round(l_extendedprice / 2000, 1) AS d FROM lineitem), t AS (SELECT l_returnflag, count(*) AS n, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_pop(d), 6) AS d FROM l GROUP BY ALL),
      r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2.0::DOUBLE AS r FROM l WHERE d <> 0), w AS (SELECT l_returnflag, count(*) AS nonzero, sum(r) FILTER (WHERE d > 0) AS up, sum(r) AS tot FROM r GROUP BY ALL)
      SELECT l_returnflag, n, t, d, nonzero, least(up, tot - up) AS w, round(1 - 2 * least(up, tot - up) / tot, 6) AS effect FROM t JOIN w USING (l_returnflag)""",
    "seed_aggregate": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS std FROM lineitem GROUP BY ALL",
    "ablation_pivot": """SELECT l_returnflag, round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 6) AS "F", round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 6) AS "O" FROM lineitem GROUP BY l_returnflag""",
    "interaction_effect": """WITH c AS (SELECT p_brand, p_type, avg(p_retailprice) AS m FROM part GROUP BY ALL), v AS (SELECT (SELECT var_pop(m) FROM c) AS total, (SELECT var_pop(m) FROM (SELECT avg(m) AS m FROM c GROUP BY p_brand)) AS rows_, (SELECT var_pop(m) FROM (SELECT avg(m) AS m FROM c GROUP BY p_type)) AS cols)
      SELECT round(total, 6) AS total, round(rows_, 6) AS "rows", round(cols, 6) AS "columns", round(greatest(total - rows_ - cols, 0), 6) AS interaction FROM v""",
    "pareto": """WITH p AS (SELECT p_partkey, p_size, floor(p_retailprice / 10)::BIGINT AS price, p_partkey % 7 AS rank FROM part)
      SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.p_size >= p.p_size AND q.price >= p.price AND q.rank >= p.rank AND (q.p_size > p.p_size OR q.price > p.price OR q.rank > p.rank))""",
    "forgetting": "WITH f AS (SELECT user_id, last(value ORDER BY ts, event_id) / nullif(first(value ORDER BY ts, event_id), 0) AS k FROM events GROUP BY user_id) SELECT user_id, round(greatest(1 - k, 0), 6) AS forgetting, round(k, 6) AS retention FROM f",
    "retention_bands": "WITH a AS (SELECT datediff('day', ts::DATE, DATE '2024-01-31') AS d FROM events) SELECT CASE WHEN d <= 7 THEN '7' WHEN d <= 30 THEN '30' WHEN d <= 60 THEN '60' WHEN d <= 90 THEN '90' ELSE 'over' END AS band, count(*) AS n FROM a GROUP BY ALL",
    "retention_prune": "SELECT event_type, count(*) AS n FROM events WHERE datediff('day', ts::DATE, DATE '2024-01-31') <= 10 GROUP BY event_type",
    "ring_buffer_eviction": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos <= 5",
    "health_rates": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS pos FROM events) SELECT event_type, count(*) AS n, round((count(*) - 1) * 60e6 / nullif(max(epoch_us(ts)) - min(epoch_us(ts)), 0), 6) AS per_minute FROM r WHERE pos <= 60 GROUP BY event_type",
    "alert_thresholds": "SELECT event_type AS metric, count(*) AS n FROM events WHERE (event_type = 'error' AND value > 300) OR (event_type = 'view' AND value < 1) GROUP BY event_type",
    "alert_cooldown": """WITH RECURSIVE h AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'error' AND value > 50),
      k(user_id, event_id, s) AS (SELECT user_id, event_id, s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS pos FROM h) WHERE pos = 1
        UNION ALL SELECT user_id, event_id, s FROM (SELECT h.*, row_number() OVER (PARTITION BY h.user_id ORDER BY h.s, h.event_id) AS pos FROM k JOIN h ON h.user_id = k.user_id AND h.s - k.s >= 21600) WHERE pos = 1)
      SELECT user_id, event_id FROM k""",
    "audit_hash_chain": f"""WITH b AS (SELECT user_id, list({_record} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
      SELECT user_id, len(l)::INT AS n, list_reduce(list_prepend('', l), lambda a, x: sha256(a || '|' || x)) AS last FROM b""",
    "audit_verify": "SELECT user_id, pos::INT AS \"at\" FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) WHERE pos % 10 = 9",
    "recover_snapshot_plus_wal": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "dedup_content_hash": "SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY ALL",
    "artifact_versions": "SELECT o_custkey, count(*)::INT AS version FROM orders GROUP BY o_custkey",
    "lineage_cycles": f"WITH RECURSIVE {_looped}, r(start, node) AS (SELECT child, child FROM edges UNION SELECT r.start, e.child FROM r JOIN edges e ON e.parent = r.node) SELECT parent, child FROM edges WHERE (child, parent) IN (SELECT start, node FROM r)",
    "lineage_path": """WITH RECURSIVE up(node, depth) AS (SELECT 37::BIGINT, 0 UNION ALL SELECT node // 2, depth + 1 FROM up WHERE node > 0), back(node, depth) AS (SELECT 401::BIGINT, 0 UNION ALL SELECT node // 2, depth + 1 FROM back WHERE node > 0),
      meet AS (SELECT up.node, up.depth AS a, back.depth AS b FROM up JOIN back USING (node) ORDER BY up.depth + back.depth LIMIT 1)
      SELECT up.depth AS "at", up.node FROM up, meet WHERE up.depth <= a UNION ALL SELECT a + b - back.depth, back.node FROM back, meet WHERE back.depth < b""",
    "lineage_run_subgraph": """WITH RECURSIVE edges AS (SELECT vec_id // 2 AS parent, vec_id AS child FROM embeddings WHERE vec_id > 0), own AS (SELECT vec_id AS node FROM embeddings WHERE vec_id % 7 = 0 AND label = 3),
      up(node) AS (SELECT node FROM own UNION SELECT parent FROM up JOIN edges ON child = node), down(node) AS (SELECT node FROM own UNION SELECT child FROM down JOIN edges ON parent = node), near AS (SELECT node FROM up UNION SELECT node FROM down)
      SELECT parent, child FROM edges WHERE parent IN (SELECT node FROM near) AND child IN (SELECT node FROM near)""",
    "lineage_components": """WITH RECURSIVE edges AS (SELECT vec_id // 2 AS parent, vec_id AS child FROM embeddings WHERE vec_id > 0 AND vec_id % 10 <> 0), both_ways AS (SELECT parent AS a, child AS b FROM edges UNION SELECT child, parent FROM edges),
      r(node, other) AS (SELECT a, a FROM both_ways UNION SELECT node, b FROM r JOIN both_ways ON a = other) SELECT node, min(other) AS component FROM r GROUP BY node""",
    "lineage_insertable": f"WITH {_looped} SELECT parent, child FROM edges WHERE parent < child AND parent IN (SELECT vec_id FROM embeddings)",
    "lineage_validate": f"""WITH RECURSIVE {_looped}, e AS (SELECT * FROM edges WHERE parent % 3 <> 0 OR child % 50 = 0), nodes AS (SELECT vec_id FROM embeddings WHERE vec_id % 11 <> 3), r(start, node) AS (SELECT child, child FROM e UNION SELECT r.start, e.child FROM r JOIN e ON e.parent = r.node)
      SELECT DISTINCT 'missing' AS kind, child AS node FROM e WHERE parent NOT IN (SELECT vec_id FROM nodes) UNION SELECT DISTINCT 'cycle', child FROM e WHERE (child, parent) IN (SELECT start, node FROM r)
      UNION SELECT 'orphan', vec_id FROM nodes WHERE vec_id NOT IN (SELECT parent FROM e) AND vec_id NOT IN (SELECT child FROM e)""",
    "lineage_export": """SELECT '  "' || vec_id // 2 || '" -> "' || vec_id || '";' AS line FROM embeddings WHERE vec_id > 0 UNION ALL SELECT '    ' || vec_id // 2 || ' --> ' || vec_id FROM embeddings WHERE vec_id > 0""",
    "lineage_tree": f"""WITH RECURSIVE {_looped}, r(node, depth, path, circular) AS (SELECT 400::BIGINT, 0, [400::BIGINT], false UNION ALL SELECT e.parent, depth + 1, list_append(path, e.parent), list_contains(path, e.parent) FROM r JOIN edges e ON e.child = r.node WHERE NOT circular)
      SELECT node, depth, array_to_string(path, '-') AS path, circular FROM r""",
    "lineage_descendants": f"WITH RECURSIVE {_tree}, r(start, node, depth) AS (SELECT vec_id, vec_id, 0 FROM embeddings WHERE vec_id % 20 = 0 UNION SELECT start, child, depth + 1 FROM r JOIN tree ON parent = node AND parent <> child) SELECT start, node, depth FROM r WHERE depth > 0",
    "lineage_ancestors": f"WITH RECURSIVE {_tree}, r(start, node, depth) AS (SELECT vec_id, vec_id, 0 FROM embeddings WHERE vec_id % 20 = 0 UNION SELECT start, parent, depth + 1 FROM r JOIN tree ON child = node AND parent <> child) SELECT start, node, depth FROM r WHERE depth > 0",
    "lineage_depth": f"WITH RECURSIVE {_tree}, r(node, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT child, depth + 1 FROM r JOIN tree ON parent = node AND parent <> child) SELECT node, max(depth) AS depth FROM r GROUP BY node",
    "stratified_balance": f"""WITH s AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT lang FROM documents))
      SELECT doc_id, d.lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_place('doc_id')}, doc_id) AS pos FROM documents) d JOIN s ON d.lang = s.lang WHERE pos <= 40 // m + CASE WHEN k < 40 % m THEN 1 ELSE 0 END""",
    "proportional_subset": f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_place('doc_id')}, doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE pos <= greatest(floor(n * 0.1::DOUBLE), 1)",
    "exact_splits": f"SELECT doc_id, CASE WHEN pos <= floor(n * 0.15::DOUBLE) THEN 'test' WHEN pos <= floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_place('doc_id')}, doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)",
    "priority_sample": f"SELECT o_orderkey FROM orders ORDER BY ln(greatest(('0x' || substr({_place('o_orderkey')}, 1, 8))::BIGINT / 4294967296.0::DOUBLE, 1e-12)) / o_totalprice DESC, o_orderkey LIMIT 50",
    "strided_sampling": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos % greatest((SELECT count(*) FROM documents) // 100, 1) = 0",
    "category_rollup": "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "variable_fps_range_join": "WITH s(lo, hi, fps) AS (VALUES (0.0::DOUBLE, 100.0::DOUBLE, 24.0::DOUBLE), (100, 400, 29.97), (400, 800, 60)), e AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 / 3600.0::DOUBLE AS h FROM events) SELECT fps, count(*) AS n, sum(floor(h * fps))::BIGINT AS frames FROM e JOIN s ON h >= lo AND h < hi GROUP BY fps",
    "curriculum_asof_weights": "WITH o AS (SELECT datediff('day', DATE '1992-01-01', o_orderdate::DATE) * 3 AS day FROM orders) SELECT CASE WHEN day >= 5000 THEN 0.1::DOUBLE WHEN day >= 1000 THEN 0.5 ELSE 1 END AS weight, count(*) AS n FROM o WHERE day >= 0 GROUP BY ALL",
    "common_customers_intersect": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
}
