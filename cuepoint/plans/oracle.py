"""The registered queries in SQL, written independently of the plans."""

from __future__ import annotations

_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _knn(source: str, k: int = 10, by: str = "", where: str = "c.vec_id <> q.vec_id") -> str:
    part = f"q.vec_id{by}"
    return f"""SELECT q.vec_id AS query_id, c.vec_id, c.label AS video, {_DOT.format(a="q.embedding", b="c.embedding")} AS sim,
    row_number() OVER (PARTITION BY {part} ORDER BY {_DOT.format(a="q.embedding", b="c.embedding")} DESC, c.vec_id) AS rank
  FROM embeddings q JOIN {source} c ON {where} WHERE q.vec_id % 20 = 0 QUALIFY rank <= {k}"""


def _union(by: str = "", key: str = "", where: str = "c.vec_id <> q.vec_id") -> str:
    frames, spoken = (_knn(f"(SELECT * FROM embeddings WHERE vec_id % 2 = {r})", by=by, where=where) for r in (0, 1))
    return f"""f AS ({frames}), t AS ({spoken}),
u AS (
  SELECT *, row_number() OVER (PARTITION BY query_id{key} ORDER BY side, rank) - 1 AS ord FROM (
    SELECT query_id, video, vec_id, 'frames' AS source, vec_id::DOUBLE AS timestamp, round(sim * 0.4, 4) AS score, 0 AS side, rank FROM f WHERE sim >= 0
    UNION ALL
    SELECT query_id, video, vec_id, 'transcript', vec_id::DOUBLE, round(sim * 0.6, 4), 1, rank FROM t WHERE sim >= 0
  )
)"""


def _dynamic(source: str, threshold: float, tie: str, key: str = "") -> str:
    return f"""SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id{key} ORDER BY score DESC, {tie}) AS place,
      count(*) FILTER (score >= {threshold}) OVER (PARTITION BY query_id{key}) AS above
    FROM {source}
  ) WHERE CASE WHEN above < 2 THEN place <= 2 ELSE score >= {threshold} AND place <= 10 END"""


def _hybrid(by: str = "", key: str = "", where: str = "c.vec_id <> q.vec_id") -> str:
    """Chain of tables that ends in h: union, anchored groups by recursion, best of each, dynamic k."""
    k = "video" if key else "0"
    return f"""WITH RECURSIVE {_union(by, key, where)},
n AS (SELECT *, {k} AS k, row_number() OVER (PARTITION BY query_id, {k} ORDER BY timestamp, ord) AS i FROM u),
g AS (
  SELECT query_id, k, i, timestamp AS anchor, 0 AS grp FROM n WHERE i = 1
  UNION ALL
  SELECT n.query_id, n.k, n.i, CASE WHEN n.timestamp - g.anchor > 30 THEN n.timestamp ELSE g.anchor END, CASE WHEN n.timestamp - g.anchor > 30 THEN g.grp + 1 ELSE g.grp END
  FROM g JOIN n ON n.query_id = g.query_id AND n.k = g.k AND n.i = g.i + 1
),
b AS (
  SELECT n.*, g.grp FROM n JOIN g ON n.query_id = g.query_id AND n.k = g.k AND n.i = g.i
  QUALIFY row_number() OVER (PARTITION BY n.query_id, n.k, g.grp ORDER BY n.score DESC, n.timestamp, n.ord) = 1
),
h AS ({_dynamic("b", 0.15, "grp", key)})"""


_EVENTS = "SELECT event_id, user_id, event_type, value AS timestamp FROM events"

_SCENES = """raw AS (SELECT n * 20.0 AS a, n * 20.0 + ([20.0, 1.5, 15.0, 18.0])[n % 4 + 1] AS b FROM range(25) AS r(n)),
scenes AS (SELECT row_number() OVER (ORDER BY a) - 1 AS scene_id, a::DOUBLE AS a, b::DOUBLE AS b FROM raw WHERE b - a >= 2),
last AS (SELECT max_by(scene_id, scene_id) AS scene_id, max_by(b, scene_id) AS b FROM scenes),
looked AS (
  SELECT e.event_id, e.user_id, e.value AS timestamp, coalesce(min(s.scene_id), max(CASE WHEN e.value = last.b THEN last.scene_id END), -1) AS scene_id
  FROM events e LEFT JOIN scenes s ON s.a <= e.value AND e.value < s.b CROSS JOIN last GROUP BY ALL
)"""

_SEMANTIC = f"""WITH RECURSIVE o AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
s AS (
  SELECT label, i, vec_id, true AS keep, NULL::DOUBLE AS score, v AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT o.label, o.i, o.vec_id, {_DOT.format(a="s.kept", b="o.v")} < 0.1, {_DOT.format(a="s.kept", b="o.v")}, CASE WHEN {_DOT.format(a="s.kept", b="o.v")} < 0.1 THEN o.v ELSE s.kept END
  FROM s JOIN o ON o.label = s.label AND o.i = s.i + 1
)"""

_ADAPTIVE = f"""WITH RECURSIVE o AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, CASE WHEN (vec_id // 40) % 3 = 2 THEN -1 ELSE vec_id // 40 END AS scene, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings
),
s AS (
  SELECT label, i, vec_id, scene, v AS kept, []::DOUBLE[] AS win, true AS keep, NULL::DOUBLE AS score, NULL::DOUBLE AS threshold, false AS reset FROM o WHERE i = 1
  UNION ALL
  SELECT label, i, vec_id, scene, CASE WHEN keep THEN v ELSE kept END, win, keep, score, threshold, reset FROM (
    SELECT *, score < -0.15 OR (score <= 0.15 AND score <= threshold) AS keep FROM (
      SELECT *, list_avg(win) - 0.9 * CASE WHEN len(win) < 2 THEN 0.05 ELSE list_stddev_pop(win) END AS threshold FROM (
        SELECT o.label, o.i, o.vec_id, o.scene, o.v, s.kept, {_DOT.format(a="s.kept", b="o.v")} AS score, o.scene <> s.scene AS reset,
          list_append(CASE WHEN o.scene <> s.scene THEN []::DOUBLE[] ELSE s.win[greatest(len(s.win) - 28, 1):len(s.win)] END, {_DOT.format(a="s.kept", b="o.v")}) AS win
        FROM s JOIN o ON o.label = s.label AND o.i = s.i + 1
      )
    )
  )
)"""


def _as_one(filtered: str) -> str:
    """A filter's tables over all vectors as one recording."""
    return filtered.replace("FROM embeddings", "FROM (SELECT * REPLACE (0 AS label) FROM embeddings)")


_TURNS = """turns AS (
  SELECT conv_id, turn, role, text, coalesce(sum(length(text)) OVER w, 0) / 15 AS a, (coalesce(sum(length(text)) OVER w, 0) + length(text)) / 15 AS b
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""

_MMSS = "printf('%02d:%02d', (floor({s})::BIGINT // 60), floor({s})::BIGINT % 60)"

_RANKING = """r AS (
  SELECT user_id, coalesce(list(value ORDER BY event_id) FILTER (event_type = 'view'), []) AS retrieved, coalesce(list(value ORDER BY event_id) FILTER (event_type = 'purchase'), []) AS relevant
  FROM events GROUP BY user_id
),
c AS (SELECT user_id, retrieved[1:5] AS top, relevant FROM r),
h AS (
  SELECT *, list_transform(top, lambda t: len(list_filter(relevant, lambda g: abs(t - g) <= 10)) > 0) AS hits,
    len(list_distinct(list_filter(relevant, lambda g: len(list_filter(top, lambda t: abs(t - g) <= 10)) > 0))) AS met
  FROM c
),
m AS (
  SELECT user_id, len(top)::INT AS n_retrieved, round(len(list_filter(hits, lambda x: x)) / 5, 4) AS precision_at_k,
    CASE WHEN len(relevant) > 0 THEN round(met / len(relevant), 4) ELSE 0.0 END AS recall_at_k,
    CASE WHEN list_contains(hits, true) THEN round(1.0::DOUBLE / list_position(hits, true), 4) ELSE 0.0 END AS reciprocal_rank,
    list_contains(hits, true) AS hit_at_k
  FROM h
)"""


def _picked(key: str = "") -> str:
    """p: what is left of h by score where re-ranking fails; up to two results stay as they are."""
    return f"""p AS (
  SELECT * FROM (
    SELECT * EXCLUDE (place), CASE WHEN count(*) OVER (PARTITION BY query_id{key}) <= 2 THEN place ELSE row_number() OVER (PARTITION BY query_id{key} ORDER BY score DESC, place) END AS place FROM h
  ) WHERE place <= 5
)"""


def _fallback(key: str = "", rows: str = "p") -> str:
    """w: the text of an answer that couldn't be written, for each question (and video)."""
    clock = _MMSS.format(s="timestamp")
    return f"""x AS (
  SELECT query_id{key}, string_agg('[' || {clock} || '] words at ' || vec_id, chr(10) || chr(10) ORDER BY timestamp, place) FILTER (source = 'transcript') AS context, count(*)::INT AS n_sources, max(score) AS top FROM {rows} GROUP BY ALL
),
y AS (SELECT query_id{key}, string_agg({clock}, ', ' ORDER BY timestamp) AS times FROM (SELECT DISTINCT query_id{key}, timestamp FROM {rows}) GROUP BY ALL),
w AS (SELECT x.*, 'The answer couldn''t be written. Relevant times: ' || times || chr(10) || chr(10) || coalesce(context, '') AS response_text FROM x JOIN y USING (query_id{key}))"""


_OWN = "c.label = q.label"
_EVALUATED = f"""{_hybrid(where=_OWN)}, {_picked()},
l AS (SELECT q.vec_id, q.label, list(p.timestamp ORDER BY p.place) FILTER (p.timestamp IS NOT NULL) AS top FROM embeddings q LEFT JOIN p ON p.query_id = q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
e AS (
  SELECT vec_id, label, coalesce(top, []) AS top, [vec_id + 10.0::DOUBLE, vec_id + 300.0::DOUBLE] AS relevant,
    list_transform(coalesce(top, []), lambda t: abs(t - vec_id - 10) <= 30 OR abs(t - vec_id - 300) <= 30) AS hits FROM l
),
m AS (
  SELECT 'q' || vec_id AS query, label::VARCHAR AS video_hash, len(top)::INT AS n_retrieved, round(len(list_filter(hits, lambda x: x)) / 5, 4) AS precision_at_k,
    round(len(list_filter(relevant, lambda g: len(list_filter(top, lambda t: abs(t - g) <= 30)) > 0)) / 2, 4) AS recall_at_k,
    CASE WHEN list_contains(hits, true) THEN round(1.0::DOUBLE / list_position(hits, true), 4) ELSE 0.0 END AS reciprocal_rank, list_contains(hits, true) AS hit_at_k FROM e
),
a AS (
  SELECT count(*) AS num_queries, round(avg(precision_at_k), 4) AS mean_precision_at_k, round(avg(recall_at_k), 4) AS mean_recall_at_k, round(avg(reciprocal_rank), 4) AS mrr, round(avg(hit_at_k::INT), 4) AS hit_rate_at_k FROM m
),
r AS (SELECT *, CASE WHEN hit_rate_at_k >= 0.8 THEN 'strong' WHEN hit_rate_at_k >= 0.6 THEN 'moderate' ELSE 'weak' END AS band FROM a)"""


def oracle_sql() -> dict[str, str]:
    from .roster import NAMES, REPLIES

    replies = ", ".join(f"({i}, '{r}')" for i, r in enumerate(REPLIES))
    names = ", ".join(f"('{n}')" for n in NAMES)
    return {
        "knn_topk": f"SELECT query_id, rank::INT AS rank, vec_id, round(sim, 6) AS sim FROM ({_knn('embeddings')})",
        "knn_topk_per_video": f"SELECT query_id, video, rank::INT AS rank, vec_id, round(sim, 6) AS sim FROM ({_knn('embeddings', by=', c.label')})",
        "weighted_union": f"WITH {_union()} SELECT query_id, ord::INT AS ord, vec_id, source, timestamp, score FROM u",
        "anchored_dedup": f"""WITH RECURSIVE o AS (SELECT *, ((event_id * 37) % 101)::DOUBLE AS score, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS i FROM ({_EVENTS})),
            g AS (
              SELECT user_id, i, timestamp AS anchor, 0::BIGINT AS grp FROM o WHERE i = 1
              UNION ALL
              SELECT o.user_id, o.i, CASE WHEN o.timestamp - g.anchor > 30 THEN o.timestamp ELSE g.anchor END, CASE WHEN o.timestamp - g.anchor > 30 THEN g.grp + 1 ELSE g.grp END
              FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1
            )
            SELECT o.user_id, g.grp, g.anchor, o.event_id, o.timestamp, o.score FROM o JOIN g ON o.user_id = g.user_id AND o.i = g.i
            QUALIFY row_number() OVER (PARTITION BY o.user_id, g.grp ORDER BY o.score DESC, o.timestamp, o.event_id) = 1""",
        "dynamic_k_threshold": f"WITH {_union()}, k AS ({_dynamic('u', 0.15, 'ord')}) SELECT query_id, place::INT AS place, vec_id, source, score FROM k",
        "dynamic_k_fallback": f"WITH {_union()}, k AS ({_dynamic('u', 0.2, 'ord')}) SELECT query_id, place::INT AS place, vec_id, source, score FROM k",
        "hybrid_search": f"{_hybrid()} SELECT query_id, place::INT AS place, vec_id, source, timestamp, score FROM h",
        "range_search": f"{_hybrid()} SELECT query_id, place::INT AS place, vec_id, timestamp, score, count(*) OVER (PARTITION BY query_id) AS dynamic_k FROM h WHERE timestamp BETWEEN 100 AND 400",
        "cross_video_top": f"""{_hybrid(", c.label", ", video")},
            v AS (SELECT query_id, video, max(score) AS best_score, count(*) AS n_results FROM h GROUP BY ALL HAVING max(score) >= 0.15)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, video)::INT AS place, video, best_score, n_results FROM v QUALIFY place <= 3""",
        "scene_lookup": f"WITH {_SCENES} SELECT event_id, scene_id::INT AS scene_id FROM looked",
        "scene_changes": f"""WITH {_SCENES}, c AS (SELECT user_id, scene_id <> lag(scene_id) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS changed FROM looked)
            SELECT user_id, count(*) AS n_frames, count(*) FILTER (changed) AS n_changes, count(*) FILTER (changed) AS last_run FROM c GROUP BY user_id""",
        "frame_sampling": f"""SELECT user_id, event_id, frame_idx::INT AS frame_idx, round(frame_idx / 2.5::DOUBLE, 3) AS timestamp
            FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) - 1 AS frame_idx FROM ({_EVENTS}))
            WHERE frame_idx >= 5 AND (frame_idx - 5) % 2 = 0 AND frame_idx <= 100""",
        "frame_scan": """SELECT user_id, i::INT AS frame_idx, round(i / 2.5::DOUBLE, 3) AS timestamp, 'user-' || user_id || '@' || i AS picture
            FROM (SELECT user_id, unnest(range(5, count(*) * 10, 2)) AS i FROM events GROUP BY user_id) WHERE i / 2.5 >= 20 AND i < 400""",
        "scene_renumber": f"""WITH e AS (SELECT user_id, timestamp AS a, lead(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS b FROM ({_EVENTS})),
            k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a, b) - 1 AS scene_id, round(a, 3) AS start_sec, round(b, 3) AS end_sec FROM e WHERE b - a >= 2)
            SELECT user_id, scene_id::INT AS scene_id, start_sec, end_sec FROM k
            UNION ALL
            SELECT user_id, 0, 0.0, round(max(value), 3) FROM events WHERE user_id NOT IN (SELECT user_id FROM k) GROUP BY user_id""",
        "rolling_threshold": f"""WITH s AS (SELECT *, 1 - abs(timestamp - lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, event_id)) / 100 AS score FROM ({_EVENTS})),
            w AS (
              SELECT event_id, avg(score) OVER w AS mean, CASE WHEN count(score) OVER w < 2 THEN 0.05 ELSE stddev_pop(score) OVER w END AS std FROM s WHERE score IS NOT NULL
              WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
            )
            SELECT event_id, round(mean, 8) AS mean, round(std, 8) AS std, round(mean - std, 8) AS threshold FROM w""",
        "semantic_filter": f"{_SEMANTIC} SELECT vec_id, keep, round(score, 6) AS score FROM s",
        "adaptive_filter": f"{_ADAPTIVE} SELECT vec_id, keep, round(score, 6) AS score, round(threshold, 6) AS threshold, reset FROM s",
        "semantic_filter_cut": f"{_as_one(_SEMANTIC)} SELECT vec_id, keep, round(score, 6) AS score FROM s",
        "adaptive_filter_cut": f"{_as_one(_ADAPTIVE)} SELECT vec_id, keep, round(score, 6) AS score, round(threshold, 6) AS threshold, reset FROM s",
        "filter_stats": f"""{_SEMANTIC} SELECT label AS video, count(*) AS total_input, count(*) FILTER (keep) AS total_kept, count(*) FILTER (NOT keep) AS total_dropped,
            round(100 * count(*) FILTER (NOT keep) / count(*), 2) AS reduction_pct, round(coalesce(avg(score), 0), 4) AS mean_score, round(coalesce(stddev_pop(score), 0), 4) AS std_score
            FROM s GROUP BY label""",
        "transcript_chunks": f"""WITH {_TURNS}, e AS (SELECT conv_id, max(b) AS e FROM turns GROUP BY conv_id),
            w AS (SELECT conv_id, k * 25.0::DOUBLE AS ws FROM (SELECT conv_id, unnest(range(ceil(e / 25)::BIGINT)) AS k FROM e)),
            p AS (SELECT w.conv_id, w.ws, t.turn, t.a, t.b, t.text FROM w JOIN turns t ON t.conv_id = w.conv_id AND t.a < w.ws + 30 AND t.b > w.ws)
            SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY ws) - 1)::INT AS chunk_id, round(min_by(a, turn), 3) AS start_time,
              round(least(max_by(b, turn), ws + 30), 3) AS end_time, trim(string_agg(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), ' ' ORDER BY turn)) AS text
            FROM p GROUP BY conv_id, ws""",
        "context_budget": f"""WITH {_TURNS}, l AS (SELECT conv_id, turn, a, '[' || {_MMSS.format(s="a")} || '] ' || text AS line FROM turns WHERE text <> ''),
            c AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY a, turn ROWS UNBOUNDED PRECEDING) AS upto FROM l),
            k AS (
              SELECT *, CASE WHEN upto <= 500 THEN line WHEN 500 - (upto - length(line)) > 50 THEN substr(line, 1, (500 - (upto - length(line)))::INT) || '...' END AS piece FROM c
            )
            SELECT conv_id, string_agg(piece, chr(10) || chr(10) ORDER BY a, turn) AS context FROM k WHERE piece IS NOT NULL GROUP BY conv_id""",
        "rerank_gather": f"""WITH {_TURNS}, replies(i, reply) AS (VALUES {replies}),
            n AS (
              SELECT t.conv_id, turn, row_number() OVER p - 1 AS pos, count(*) OVER (PARTITION BY t.conv_id) AS n,
                row_number() OVER (PARTITION BY t.conv_id ORDER BY length(text) % 17 DESC, turn) - 1 AS by_score, trim(regexp_replace(reply, '```(json)?', '', 'g'), chr(10) || ' ') AS reply
              FROM turns t JOIN replies r ON t.conv_id % {len(REPLIES)} = r.i WINDOW p AS (PARTITION BY t.conv_id ORDER BY turn)
            ),
            c AS (SELECT DISTINCT conv_id, n, reply, CASE WHEN json_valid(reply) THEN json_type(reply::JSON) END AS kind, CASE WHEN json_valid(reply) THEN json_type(reply::JSON, '$.selected') END AS inner_kind FROM n),
            x AS (SELECT conv_id, n, generate_subscripts(items, 1) AS nth, unnest(items) AS item FROM (SELECT conv_id, n, json_extract(reply::JSON, '$.selected[*]') AS items FROM c WHERE kind = 'OBJECT' AND inner_kind = 'ARRAY')),
            y AS (
              SELECT conv_id, n, nth, CASE WHEN json_type(item) = 'BOOLEAN' THEN CASE WHEN item::VARCHAR = 'true' THEN 1 ELSE 0 END WHEN json_type(item) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN trunc(item::DOUBLE) END AS v FROM x
            ),
            z AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY nth) AS place, v FROM y WHERE v IS NOT NULL AND v >= 0 AND v < n),
            chosen AS (SELECT n.conv_id, z.place, n.turn FROM z JOIN n ON n.conv_id = z.conv_id AND n.pos = z.v WHERE n.n > 2),
            other AS (
              SELECT n.conv_id, CASE WHEN n.n > 2 AND c.kind = 'ARRAY' THEN n.by_score ELSE n.pos END + 1 AS place, n.turn, n.n,
                CASE WHEN n.n > 2 AND (c.kind IS NULL OR (c.kind = 'OBJECT' AND c.inner_kind IS NOT NULL AND c.inner_kind <> 'ARRAY')) THEN 3 ELSE 5 END AS most
              FROM n JOIN c ON c.conv_id = n.conv_id WHERE n.conv_id NOT IN (SELECT conv_id FROM chosen)
            )
            SELECT conv_id, place::INT AS place, turn FROM chosen WHERE place <= 5
            UNION ALL
            SELECT conv_id, place::INT, turn FROM other WHERE place <= most""",
        "rerank_prompt": f"""WITH {_TURNS}, l AS (
              SELECT conv_id, turn, '#' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ' ' || role || ' at ' || {_MMSS.format(s="a")} || ': ' ||
                CASE WHEN text <> '' THEN substr(text, 1, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END ELSE '(picture only)' END AS line FROM turns
            )
            SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) || chr(10) || 'Reply with JSON {{"selected": [numbers of the 1 to 5 most useful candidates, best first]}}.' AS prompt FROM l GROUP BY conv_id""",
        "eval_metrics": f"WITH {_RANKING} SELECT * FROM m",
        "eval_macro": f"""WITH {_RANKING} SELECT count(*) AS num_queries, round(avg(precision_at_k), 4) AS mean_precision_at_k, round(avg(recall_at_k), 4) AS mean_recall_at_k,
            round(avg(reciprocal_rank), 4) AS mrr, round(avg(hit_at_k::INT), 4) AS hit_rate_at_k,
            CASE WHEN round(avg(hit_at_k::INT), 4) >= 0.8 THEN 'strong' WHEN round(avg(hit_at_k::INT), 4) >= 0.6 THEN 'moderate' ELSE 'weak' END AS band FROM m""",
        "clock_format": """WITH s AS (SELECT event_id, floor(value * 37)::BIGINT AS s FROM events)
            SELECT event_id, printf('%02d:%02d', s // 60, s % 60) AS minutes_clock,
              CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS hours_clock, s::INT AS seconds FROM s""",
        "parse_timestamps": """SELECT event_id, (CASE event_id % 5 WHEN 1 THEN 2 ELSE 1 END)::INT AS n_times, (CASE event_id % 5
              WHEN 0 THEN event_id WHEN 1 THEN 60 + event_id % 60 + round(60 * (event_id % 7) + 26.5, 1) WHEN 2 THEN 3600 + 60 * (event_id % 60) + 5
              WHEN 3 THEN event_id ELSE round(event_id + 0.25, 1) END)::DOUBLE AS total FROM events""",
        "video_hash": """SELECT doc_id, h AS video_hash, h || '_frame_' || lpad(doc_id::VARCHAR, 6, '0') AS frame_id, h || '_chunk_' || CASE WHEN length(doc_id::VARCHAR) < 4 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END AS chunk_id
            FROM (SELECT doc_id, substr(md5(source || '_' || n_chars), 1, 8) AS h FROM documents)""",
        "registry_upsert": """SELECT c_custkey, c_name, round(CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 2 WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS value,
              CASE WHEN c_custkey % 6 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS load_seq FROM customer
            UNION ALL SELECT c_custkey + 10000000, c_name, round(c_acctbal, 2), 1 FROM customer WHERE c_custkey % 10 = 0""",
        "upsert_log": """SELECT c_custkey, c_name,
              round(CASE WHEN c_custkey % 15 = 0 THEN c_acctbal + 3 WHEN c_custkey % 6 = 0 THEN c_acctbal + 2 WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS value,
              CASE WHEN c_custkey % 15 = 0 THEN 3 WHEN c_custkey % 6 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS load_seq
            FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 15 = 0""",
        "registry_rename": """SELECT c_custkey, n AS custom_name, CASE WHEN n <> '' THEN n ELSE c_name END AS display_name
            FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey = 7 THEN 'Lecture seven' WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END AS n FROM customer)""",
        "registry_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)",
        "resume_anti": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "fuzzy_name_match": f"""SELECT wanted, p_partkey, p_name FROM (VALUES {names}) AS w(wanted) JOIN part
              ON p_name = wanted OR contains(regexp_replace(p_name, '\\.[^.]*$', ''), regexp_replace(wanted, '\\.[^.]*$', '')) OR contains(regexp_replace(wanted, '\\.[^.]*$', ''), regexp_replace(p_name, '\\.[^.]*$', ''))
            QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY p_partkey) = 1""",
        "fuzzy_name_table": """WITH p AS (SELECT p_partkey, p_name, regexp_replace(p_name, '\\.[^.]*$', '') AS stem FROM part),
            w AS (
              SELECT substr(p_name, (3 + p_partkey % 4)::INT, (3 + p_partkey % 9)::INT) AS wanted FROM part UNION SELECT p_name || ' take ' || p_partkey || '.mkv' FROM part UNION SELECT p_brand FROM part
            ), ws AS (SELECT wanted, regexp_replace(wanted, '\\.[^.]*$', '') AS stem FROM w),
            s AS (SELECT stem, min(p_partkey) AS first FROM p GROUP BY stem)
            SELECT wanted, min(first) AS p_partkey, min_by(p_name, p_partkey) AS p_name FROM ws JOIN s ON contains(s.stem, ws.stem) OR contains(ws.stem, s.stem) JOIN part ON p_partkey = first GROUP BY wanted""",
        "answer_assembly": f"""{_hybrid()}, a AS (
              SELECT query_id, array_to_string(list_sort(list_distinct(list(vec_id))), ',') AS timestamps,
                array_to_string((list('f' || vec_id ORDER BY place) FILTER (source = 'frames'))[1:5], ',') AS keyframe_paths,
                array_to_string(list('t' || vec_id ORDER BY place) FILTER (source = 'transcript'), ',') AS transcript_used, count(*)::INT AS n_sources FROM h GROUP BY query_id
            )
            SELECT query_id, timestamps, coalesce(keyframe_paths, '') AS keyframe_paths, coalesce(transcript_used, '') AS transcript_used, n_sources FROM a""",
        "answer_view": f"""{_hybrid()}, lc AS (
              SELECT *, CASE WHEN timestamp >= 3600 THEN printf('%d:%02d:%02d', timestamp::BIGINT // 3600, timestamp::BIGINT // 60 % 60, timestamp::BIGINT % 60) ELSE {_MMSS.format(s="timestamp")} END AS clock FROM h
            ),
            lt AS (SELECT query_id, string_agg(clock, ', ' ORDER BY timestamp) AS times FROM (SELECT DISTINCT query_id, timestamp, clock FROM lc) GROUP BY query_id)
            SELECT query_id::VARCHAR AS query, 'about ' || query_id AS response_text, any_value(times) AS times, coalesce(array_to_string((list('f' || vec_id ORDER BY place) FILTER (source = 'frames'))[1:5], ', '), '') AS keyframe_paths,
              string_agg(source || ' at ' || clock || ' (' || round(score::DECIMAL(18, 9), 2)::DECIMAL(18, 2) || ')', ', ' ORDER BY place) AS sources
            FROM lc JOIN lt USING (query_id) GROUP BY query_id""",
        "search_response": f"""{_hybrid()}, c AS (SELECT query_id, count(*) FILTER (source = 'frames') AS frame_candidates, count(*) FILTER (source = 'transcript') AS transcript_candidates FROM u GROUP BY query_id),
            k AS (SELECT query_id, count(*) AS dynamic_k FROM h GROUP BY query_id)
            SELECT q.vec_id AS query_id, coalesce(frame_candidates, 0) AS frame_candidates, coalesce(transcript_candidates, 0) AS transcript_candidates, coalesce(dynamic_k, 0) AS dynamic_k
            FROM embeddings q LEFT JOIN c ON c.query_id = q.vec_id LEFT JOIN k ON k.query_id = q.vec_id WHERE q.vec_id % 20 = 0""",
        "score_lists": f"{_SEMANTIC} SELECT label AS video, coalesce(string_agg(round(score * 10000)::BIGINT::VARCHAR, ',' ORDER BY vec_id), '') AS scores FROM s GROUP BY label",
        "answer_gate": f"{_hybrid(', c.label', ', video')} SELECT query_id, video, count(*) AS n_results, max(score) AS best_score FROM h GROUP BY ALL HAVING max(score) >= 0.2",
        "answer_fallback": f"""{_hybrid()}, fl AS (SELECT query_id, place, timestamp, '[' || {_MMSS.format(s="timestamp")} || '] words at ' || vec_id AS line FROM h WHERE source = 'transcript'),
            fc AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY timestamp, place) AS context FROM fl GROUP BY query_id),
            ft AS (SELECT query_id, string_agg({_MMSS.format(s="timestamp")}, ', ' ORDER BY timestamp) AS times FROM (SELECT DISTINCT query_id, timestamp FROM h) GROUP BY query_id),
            fn AS (SELECT query_id, count(*)::INT AS n FROM h GROUP BY query_id)
            SELECT q.query_id, CASE WHEN fn.n IS NULL THEN 'No part of the recording seems to answer this question. Another wording may help.'
              ELSE 'The answer couldn''t be written. Relevant times: ' || ft.times || chr(10) || chr(10) || coalesce(fc.context, '') END AS response_text, coalesce(fn.n, 0)::INT AS n_sources
            FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT -1) q LEFT JOIN fn ON fn.query_id = q.query_id LEFT JOIN ft ON ft.query_id = q.query_id LEFT JOIN fc ON fc.query_id = q.query_id""",
        "shown_images": f"""WITH {_union()}, p AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM u WHERE source = 'frames')
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n)::INT AS place, 'f' || vec_id AS path FROM p WHERE n <= 5 AND vec_id % 4 <> 0 QUALIFY place <= 3""",
        "library_listing": """WITH o AS (SELECT *, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS place FROM orders)
            SELECT o_orderkey, place, strftime(o_orderdate, '%Y-%m-%d') AS day, (place - 1) % 3 AS grid_column,
              CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE floor(o_totalprice / 10000)::BIGINT || '%' END AS reduction FROM o""",
        "ask_video": f"{_hybrid(where='c.label = 3 AND q.vec_id % 60 <> 0')}, {_picked()}, {_fallback()}"
        """ SELECT q.vec_id AS query_id, coalesce(response_text, 'No part of the recording seems to answer this question. Another wording may help.') AS response_text, coalesce(n_sources, 0)::INT AS n_sources
            FROM embeddings q LEFT JOIN w ON w.query_id = q.vec_id WHERE q.vec_id % 20 = 0 AND q.vec_id % 60 <> 0""",
        "ask_library": f"""{_hybrid(", c.label", ", video", "true")},
            v AS (
              SELECT query_id, video, max(score) AS best_score FROM h GROUP BY ALL HAVING max(score) >= 0.15
            ),
            o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, video % 3 DESC, video::VARCHAR) AS video_place FROM v QUALIFY video_place <= 3),
            {_picked(", video")}, s AS (SELECT p.* FROM p JOIN o USING (query_id, video)), {_fallback(", video", "s")}
            SELECT query_id, video::VARCHAR AS video_hash, video_place::INT AS video_place, best_score, response_text, n_sources FROM w JOIN o USING (query_id, video) WHERE top >= 0.2""",
        "evaluate_queries": f"{_EVALUATED} SELECT * FROM m",
        "evaluate_report": f"{_EVALUATED} SELECT *, 5::INT AS k, num_queries::INT AS n_results FROM r",
        "summary_lines": f"""{_EVALUATED} SELECT '  ' || query || ': P ' || precision_at_k || ', R ' || recall_at_k AS line FROM m
            UNION ALL SELECT 'mean P ' || mean_precision_at_k || ', mean R ' || mean_recall_at_k || ', MRR ' || mrr || ', hit rate ' || hit_rate_at_k || ' (' || band || ')' FROM r""",
        "video_duration": "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN round(n_chars / ((doc_id % 4) * 7.5::DOUBLE), 6) ELSE 0.0 END::DOUBLE AS duration_sec FROM documents",
        "registry_lookup": "SELECT c_custkey, c_mktsegment AS video_hash FROM customer WHERE c_mktsegment = 'BUILDING'",
        "collection_sizes": """SELECT label || '_' || kind AS name, label::VARCHAR AS video_hash, kind, count(*) AS rows
            FROM (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 'frames' ELSE 'transcript' END AS kind FROM embeddings) GROUP BY label, kind""",
        "unit_vectors": """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7)) AS v FROM embeddings),
            u AS (SELECT vec_id, v, nullif(sqrt(list_inner_product(v, v)), 0) AS n FROM v)
            SELECT vec_id, round(list_inner_product(v, v) / (n * n), 6) AS length, round(v[1] / n, 6) AS first FROM u""",
        "static_links": "SELECT page_id, 'app/static/videos/' || string_split(url, '/')[-1] AS link FROM pages",
        "asked_queries": "SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0 AND turn % 5 <> 1 AND regexp_matches(text, '\\S')",
        "pending_videos": """SELECT source, false AS forced, count(*) AS videos FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source
            UNION ALL SELECT source, true, count(*) FROM documents GROUP BY source""",
        "registry_register": """SELECT c_custkey AS video_hash, CASE WHEN c_custkey % 3 = 0 THEN c_name || '.mp4' ELSE c_name END AS video_name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END AS custom_name,
              CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS total_chunks FROM customer
            UNION ALL SELECT c_custkey + 10000000, c_name, '', 3 FROM customer WHERE c_custkey % 10 = 0""",
        "annotate_resumed": """WITH o AS (SELECT 0 AS late, doc_id AS pos, 'q' || doc_id % 50 AS query, 1 AS t, '' AS notes FROM documents WHERE source = 'src1'),
            g AS (SELECT 1 AS late, doc_id AS pos, 'q' || doc_id % 60 AS query, (doc_id % 60) * 60 + 5 + doc_id % 7 AS t, 'n' AS notes FROM documents WHERE source = 'src2'),
            a AS (SELECT * FROM o UNION ALL SELECT * FROM g WHERE query NOT IN (SELECT query FROM o))
            SELECT '/lecture.mp4' AS video_path, '2024-02-02T00:00:00' AS annotated_at, 30.0::DOUBLE AS timestamp_tolerance_sec, count(*)::INT AS total_annotations,
              string_agg(query || '@' || t || notes, ',' ORDER BY late, pos) AS entries FROM a HAVING count(*) > 0""",
        "shown_annotations": """WITH t AS (SELECT doc_id, source, unnest([n_chars, floor(doc_id * 61.5)::BIGINT]) AS s, unnest([1, 2]) AS i FROM documents)
            SELECT doc_id::VARCHAR AS query, string_agg(CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END, ', ' ORDER BY i) AS times, source AS notes
            FROM t GROUP BY doc_id, source""",
        "library_view": """WITH o AS (
              SELECT o_orderkey AS n, o_orderpriority, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE '' END AS d FROM orders
            )
            SELECT n::VARCHAR AS video_hash, row_number() OVER (ORDER BY d DESC, n::VARCHAR) AS place, (row_number() OVER (ORDER BY d DESC, n::VARCHAR) - 1) % 3 AS grid_column,
              CASE WHEN n % 4 = 0 AND o_orderpriority <> '' THEN o_orderpriority ELSE 'v' || n || '.mp4' END AS name, substr(d, 1, 10) AS day,
              CASE WHEN n % 7 = 0 THEN 'N/A' ELSE (n % 100)::VARCHAR END AS total_keyframes, (n % 50)::VARCHAR AS total_chunks, CASE WHEN n % 7 = 0 THEN 'N/A' ELSE (n % 90) || '%' END AS ssim_reduction,
              (n % 33) || '%' AS clip_reduction, 'app/static/videos/v.mp4' AS url FROM o""",
        "frame_ssim": """WITH f AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor((x + 1) * 127.5)) AS v FROM embeddings),
            g AS (SELECT vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM f),
            x AS (SELECT vec_id, unnest(u) AS a, unnest(v) AS b FROM g WHERE u IS NOT NULL),
            s AS (SELECT vec_id, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM x GROUP BY vec_id)
            SELECT g.vec_id, round((2 * ma * mb + 2.55 ** 2) * (2 * c + 7.65 ** 2) / ((ma * ma + mb * mb + 2.55 ** 2) * (va + vb + 7.65 ** 2)), 6) AS ssim FROM g LEFT JOIN s ON s.vec_id = g.vec_id""",
        "gray_levels": """WITH f AS (SELECT vec_id, list_transform(embedding[1:63]::DOUBLE[], lambda x: floor((x + 1) * 127.5)) AS v FROM embeddings),
            p AS (SELECT vec_id, i, round_even(v[3 * i + 1] * 0.114::DOUBLE + v[3 * i + 2] * 0.587::DOUBLE + v[3 * i + 3] * 0.299::DOUBLE, 0)::INT AS y FROM f, range(21) AS r(i))
            SELECT vec_id, string_agg(printf('%02x', y), '' ORDER BY i) AS shades FROM p GROUP BY vec_id""",
        "prompt_images": f"""WITH {_union()}, q AS (SELECT DISTINCT query_id FROM u),
            i AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM u WHERE source = 'frames'),
            a AS (
              SELECT query_id, 0 AS part, 0 AS n, 'text' AS kind, 'Answer from the excerpts of this recording only, and name the times that you rely on.' AS value, NULL::INT AS n_bytes FROM q
              UNION ALL SELECT query_id, 1, 0, 'text', 'c' || query_id, NULL FROM q WHERE query_id % 40 = 0
              UNION ALL SELECT query_id, 2, n, 'image', 'f' || vec_id, length(vec_id::VARCHAR) FROM i WHERE n <= 5 AND vec_id % 4 <> 0
              UNION ALL SELECT query_id, 3, 0, 'text', 'Question: q' || query_id, NULL FROM q
            )
            SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY part, n) - 1)::INT AS n, kind, value, coalesce(n_bytes, 0)::INT AS n_bytes FROM a""",
        "keyframe_paths": "SELECT doc_id, 'keyframes/' || source || '/' || printf('frame_%06d_t%.2f.jpg', doc_id % 1000, n_chars / 7) AS frame_path FROM documents",
    }
