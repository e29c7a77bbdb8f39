"""DuckDB SQL of the queries that read back what was written, and of those that run kernels and stages."""

from __future__ import annotations

from html.entities import html5

from . import sql as S
from .sql import SQL

_ODD = {0: 0xFFFD, 128: 0x20AC}


def references(x: str) -> str:
    """Each reference by its name or number, piece by piece; numbers that HTML reads in another way are those that the queries have."""
    pattern = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in html5.items() if "'" not in k) + "}"
    bare = "|".join(sorted((k for k in html5 if k[-1] != ";"), key=lambda k: -len(k)))
    number = "CAST(CASE WHEN regexp_matches(t, '^&#[xX]') THEN CAST('0x' || regexp_extract(t, '[0-9a-fA-F]+', 0) AS BIGINT) ELSE CAST(regexp_extract(t, '[0-9]+', 0) AS BIGINT) END AS INTEGER)"
    odd = " ".join(f"WHEN {number} = {n} THEN chr({c})" for n, c in _ODD.items())
    named = f"coalesce({names}[substr(t, 2)], {names}[regexp_extract(t, '^&({bare})', 1)] || substr(t, 2 + len(regexp_extract(t, '^&({bare})', 1))), t)"
    one = f"CASE WHEN t[1:2] = '&#' THEN CASE {odd} WHEN {number} > 1114111 THEN chr(65533) ELSE chr({number}) END ELSE {named} END"
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{pattern}'), list_append(list_transform(regexp_extract_all({x}, '{pattern}'), lambda t: {one}), '')), lambda z: z[1] || z[2]), '')"


SQL["markup_references"] = f"""
SELECT p_partkey, {references("x")} AS text FROM (
  SELECT p_partkey, p_name || ['&eacute;', '&amp;lt;', '&notit;', '&copy', '&nosuch;', '&#169;', '&#xA9;', '&#128;', '&#0;', '&#x110000;', '&CounterClockwiseContourIntegral;', '& x', '&#;', '&ampx'][p_partkey % 14 + 1]
    || '&#' || (p_partkey + 200) || ';&#x' || printf('%X', p_partkey + 8000) || '; end' AS x FROM part)
"""
_markup = "regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '>>+', ' ', 'g')"
SQL["markup_clean"] = f"SELECT page_id, {S.norm(references('x'))} AS text FROM (SELECT page_id, {_markup} AS x FROM pages)"
SQL["caption_files"] = f"""
SELECT conv_id AS item_id, turn * 700 + (turn * 700 * 11 % 1000) / 1000.0::DOUBLE AS start, turn * 700 + 90 + ((turn * 700 + 90) * 11 % 1000) / 1000.0::DOUBLE AS "end",
       {S.norm("'é’''¬it; ' || text")} AS text FROM conversations
"""
SQL["casefold_text"] = """
SELECT p_partkey, lower(p_name) || ' ' || ['strasse', 'œuvre', 'fin', 'σοφοσ', 'i̇i', 's', 'ss'][p_partkey % 7 + 1] AS text FROM part
"""

_sound = """s AS (
  SELECT vec_id AS item_id, CASE WHEN vec_id % 6 = 0 THEN list_transform(embedding, lambda v: 0.0::DOUBLE) ELSE list_transform(embedding, lambda v: round(v::DOUBLE * 1000)) END AS x,
         CASE WHEN vec_id % 2 = 1 THEN 2 ELSE 1 END AS c, CASE WHEN vec_id % 2 = 1 THEN 5 ELSE 9 END AS n, vec_id % 10 = 9 AS other FROM embeddings
), f AS (SELECT *, unnest(range(n)) AS k FROM s), g AS (SELECT *, x[k * 8 * c + 1:(k + 1) * 8 * c] AS p FROM f),
m AS (SELECT *, CASE WHEN c = 1 THEN p ELSE list_transform(range(len(p) // 2), lambda i: (p[2 * i + 1] + p[2 * i + 2]) / 2) END AS q FROM g),
r AS (SELECT item_id, CAST(k AS INTEGER) AS frame_idx, other, CASE WHEN len(q) > 0 THEN sqrt(list_sum(list_transform(q, lambda v: v * v)) / len(q) + 1e-8) ELSE 0 END AS energy FROM m)"""
SQL["audio_rms"] = f"WITH {_sound} SELECT item_id, frame_idx, round(energy, 6) AS energy FROM r"
SQL["audio_joined"] = f"""
WITH {_sound}, q AS (SELECT item_id, quantile_cont(energy, 0.55) FILTER (energy > 0) AS lo, quantile_cont(energy, 0.95) FILTER (energy > 0) AS hi FROM r WHERE NOT other GROUP BY item_id),
h AS (SELECT item_id, frame_idx, energy >= lo AS a, greatest(0.0, least(1.0, energy / hi)) AS e FROM r JOIN q USING (item_id) WHERE NOT other UNION ALL SELECT item_id, frame_idx, true, 1.0 FROM r WHERE other)
SELECT v.vec_id AS item_id, CAST(v.k AS INTEGER) AS frame_idx, coalesce(a, false) AS audio_active, round(coalesce(e, 0.0), 6) AS audio_energy
FROM (SELECT vec_id, unnest(range(10)) AS k FROM embeddings) v LEFT JOIN h ON h.item_id = v.vec_id AND h.frame_idx = v.k
"""
SQL["clip_sharpness"] = f"""
WITH {S._vec}, l AS (
  SELECT item_id, list_transform(range(0, 64), lambda i: p[{S._mirror("i // 8 - 1")} * 8 + i % 8 + 1] + p[{S._mirror("i // 8 + 1")} * 8 + i % 8 + 1] + p[i // 8 * 8 + {S._mirror("i % 8 - 1")} + 1] + p[i // 8 * 8 + {S._mirror("i % 8 + 1")} + 1] - 4 * p[i + 1]) AS l
  FROM (SELECT item_id, list_transform(v, lambda x: round(x * 100)) AS p FROM v)
) SELECT item_id, round(avg(list_var_pop(l)), 3) AS sharpness FROM l GROUP BY item_id
"""
_lips = """p AS (
  SELECT vec_id, vec_id % 23 = 0 OR vec_id % 29 = 0 AS bad, list_transform(range(1, 5), lambda i: 40 + embedding[i]::DOUBLE * 90) AS x, list_transform(range(5, 9), lambda i: 30 + embedding[i]::DOUBLE * 60) AS y FROM embeddings
), b AS (SELECT *, list_min(x) AS lx, list_max(x) AS hx, list_min(y) AS ly, list_max(y) AS hy FROM p)"""
SQL["mouth_geometry"] = f"""
WITH {_lips}, o AS (SELECT *, NOT bad AND lx >= 0 AND ly >= 0 AND hx < 80 AND hy < 60 AND hx - lx >= 8 AND hy - ly >= 3 AS ok FROM b)
SELECT vec_id, CASE WHEN ok THEN round(list_avg(x) / 80, 7) END AS g0, CASE WHEN ok THEN round(list_avg(y) / 60, 7) END AS g1, CASE WHEN ok THEN round((hx - lx) / 80, 7) END AS g2, CASE WHEN ok THEN round((hy - ly) / 60, 7) END AS g3 FROM o
"""
SQL["mouth_shape"] = f"""
WITH {_lips}, w AS (SELECT *, greatest(hx - lx, 1.0) AS w, list_avg(x) AS mx, list_avg(y) AS my FROM b WHERE NOT bad)
SELECT vec_id, round(abs(y[2] - y[1]) / w, 7) AS opening, round((x[1] - mx) / w, 7) AS x0, round((y[1] - my) / w, 7) AS y0, round((x[4] - mx) / w, 7) AS x3, round((y[4] - my) / w, 7) AS y3 FROM w
"""
SQL["detection_boxes"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, CASE WHEN vec_id % 2 = 0 THEN 480 ELSE 320 END AS w, CASE WHEN vec_id % 2 = 0 THEN 60 ELSE 240 END AS h, CASE WHEN vec_id % 2 = 0 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS up FROM embeddings),
d AS (SELECT *, unnest(range(0, 32, 4)) AS i FROM v),
b AS (SELECT vec_id, i, up, greatest(0, trunc(v[i + 1] * 2 * w)) AS x1, greatest(0, trunc(v[i + 2] * h)) AS y1, least(w, trunc((v[i + 1] * 2 + abs(v[i + 3])) * w)) AS x2, least(h, trunc((v[i + 2] + v[i + 4] * 3) * h)) AS y2 FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS place FROM b WHERE x2 > x1 AND y2 > y1)
SELECT vec_id, CAST(place AS INTEGER) AS place, CAST(trunc(x1 * up) AS INTEGER) AS x1, CAST(trunc(y1 * up) AS INTEGER) AS y1, CAST(trunc(x2 * up) AS INTEGER) AS x2, CAST(trunc(y2 * up) AS INTEGER) AS y2 FROM k WHERE place < 3
"""
SQL["landmark_frames"] = """
WITH m AS (SELECT vec_id // 40 AS item_id, vec_id % 40 AS at, embedding[1]::DOUBLE AS x FROM embeddings),
c AS (SELECT * FROM (SELECT DISTINCT item_id FROM m), (VALUES ('000000', 0, 5), ('000001', 12, 20), ('000002', 28, 25)) v(segment_id, o, n)),
s AS (SELECT *, unnest(range(n)) AS k FROM c)
SELECT s.item_id, segment_id, CAST(k AS INTEGER) AS frame_idx, round(x, 7) AS x FROM s LEFT JOIN m ON m.item_id = s.item_id AND m.at = o + k
"""
SQL["single_face"] = """
SELECT vec_id // 20 AS clip, max(CASE WHEN vec_id % 7 = 0 THEN -1 WHEN vec_id // 20 % 3 = 0 THEN vec_id % 2 ELSE label % 3 END) <= 1 AS single FROM embeddings GROUP BY 1
"""
SQL["carried_box"] = """
WITH b AS (SELECT vec_id // 20 AS clip, vec_id AS frame_idx, CASE WHEN vec_id % 4 = 1 THEN vec_id END AS spot, list_transform(embedding[1:4], lambda v: CAST(trunc(abs(v::DOUBLE) * 200) AS INTEGER)) AS v FROM embeddings),
l AS (SELECT clip, frame_idx, max(spot) OVER (PARTITION BY clip ORDER BY frame_idx) AS spot FROM b),
w AS (SELECT l.*, b.v[1] AS x1, b.v[2] AS y1, b.v[1] + b.v[3] + 10 AS x2, b.v[2] + b.v[4] + 10 AS y2, CAST(trunc((b.v[3] + 10) * 0.18::DOUBLE) AS INTEGER) AS px, CAST(trunc((b.v[4] + 10) * 0.18::DOUBLE) AS INTEGER) AS py FROM l LEFT JOIN b ON b.frame_idx = l.spot)
SELECT clip, frame_idx, CASE WHEN spot IS NOT NULL THEN greatest(0, x1 - px) END AS x1, CASE WHEN spot IS NOT NULL THEN greatest(0, y1 - py) END AS y1, CASE WHEN spot IS NOT NULL THEN least(150, x2 + px) END AS x2, CASE WHEN spot IS NOT NULL THEN least(120, y2 + py) END AS y2 FROM w
"""
SQL["scene_log_times"] = "SELECT DISTINCT user_id, round(CAST(CAST(round(value, 4) AS DECIMAL(20, 4)) AS DOUBLE), 3) AS time FROM events"
SQL["source_file"] = """
WITH l AS (
  SELECT row_number() OVER (ORDER BY 'list' || page_id % 2, page_id) AS line_no, page_id % 4 AS m, url || CASE WHEN page_id % 8 = 3 THEN '?list=1' ELSE '' END AS url FROM pages
)
SELECT CAST(line_no AS INTEGER) AS line_no, CASE m WHEN 0 THEN 'video' WHEN 1 THEN 'playlist' ELSE 'auto' END AS mode, url, m = 1 OR (m = 3 AND (contains(url, 'list=') OR contains(url, '/playlist'))) AS playlist FROM l WHERE m <> 2
"""
SQL["playlist_entries"] = """
WITH o AS (SELECT o_custkey AS item_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS position, CAST(o_orderkey AS VARCHAR) AS entry FROM o WHERE i <= 4 AND o_orderkey % 3 <> 0
"""
SQL["local_files"] = "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS item_id, item_id AS title"
for _k in ("record_files", "published_lines"):
    SQL[_k] = SQL["manifest_flat"]
SQL["published_table"] = S._manifest + "SELECT * REPLACE (nullif(video_path, '') AS video_path, nullif(visual_quality_reasons, '') AS visual_quality_reasons, CASE WHEN accepted THEN 'True' ELSE 'False' END AS accepted) FROM mf"
SQL["shared_pull"] = S._manifest + "SELECT 'ada-l' AS contributor, quality_status, count(*) AS n FROM mf WHERE quality_status IN ('review', 'rejected') GROUP BY ALL"
SQL["kernel_rows"] = """
WITH e AS (SELECT vec_id AS k, round(embedding[1]::DOUBLE, 3) AS v FROM embeddings)
SELECT k, k % 5 <> 0 AS ok, CASE WHEN k % 5 = 0 THEN 'ValueError: bad ' || k END AS error, CASE WHEN k % 5 <> 0 THEN 4 END AS n, CASE WHEN k % 5 <> 0 THEN round(v + 1 + 1 + v * 2, 6) END AS total FROM e
"""
SQL["kernel_retry"] = """
SELECT vec_id AS k, vec_id % 5 <> 0 OR vec_id % 3 <> 0 AS ok, CASE WHEN vec_id % 15 = 0 THEN 'ValueError: bad ' || vec_id || ' | none' END AS error,
       CASE WHEN vec_id % 5 = 0 AND vec_id % 3 <> 0 THEN -1.0::DOUBLE WHEN vec_id % 5 <> 0 AND round(embedding[1]::DOUBLE, 3) < 0 THEN round(embedding[1]::DOUBLE, 3) END AS second FROM embeddings
"""
SQL["fetched_items"] = "SELECT CAST(o_custkey AS VARCHAR) AS url, CAST(o_orderkey AS VARCHAR) AS item_id, 'raw/' || o_orderkey || '/source.mp4' AS stored FROM orders WHERE o_custkey % 9 <> 0 AND o_orderkey % 4 <> 0"
SQL["clip_intervals"] = f"""
SELECT item_id, segment_id, 'n/' || item_id || '.mp4' AS source, printf('%.3f', start) AS start, printf('%.3f', CASE WHEN item_id % 5 = 0 THEN 0.01::DOUBLE ELSE greatest(0.01, "end" - start) END) AS duration, 'clips/' || item_id || '/' || segment_id || '/source.mp4' AS video_path FROM ({SQL["segments_merged"]})
"""
SQL["rejected_files"] = S._gate + "SELECT 'clips/' || item_id || '/000000/' || f AS path FROM g, (VALUES ('source.mp4'), ('audio.wav'), ('active_speaker.mp4'), ('mouth.mp4'), ('transcript.txt')) v(f) WHERE q = 'rejected'"
SQL["landmark_kernel"] = """
SELECT s_suppkey AS k, s_suppkey % 3 <> 1 AS ok, CASE s_suppkey % 3 WHEN 1 THEN 'AssertionError: broken' END AS error, CAST(CASE s_suppkey % 3 WHEN 0 THEN -1 WHEN 2 THEN s_suppkey END AS INTEGER) AS first, CASE WHEN s_suppkey % 3 = 2 THEN (s_suppkey + 1)::DOUBLE END AS x FROM supplier
"""
SQL["stage_rows"] = "SELECT n_name AS item_id, CASE WHEN n_nationkey % 2 <> 0 THEN 1 ELSE 2 END AS run FROM nation WHERE n_nationkey % 2 <> 0 OR n_nationkey % 5 <> 0"
SQL["stage_statuses"] = """
SELECT n_name AS item_id, 'work' AS stage, CASE WHEN n_nationkey % 10 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n_nationkey % 10 = 0 THEN 'no ' || n_nationkey END AS error FROM nation
"""
SQL["failure_summary"] = """
WITH s AS (SELECT n_name AS name, n_nationkey % 6 <> 0 AS ok, 'lost' AS error FROM nation UNION ALL SELECT r_name, r_regionkey <> 2, NULL FROM region)
SELECT count(*) FILTER (NOT ok) AS failed, string_agg('- ' || name || ': ' || coalesce(error, ''), chr(10) ORDER BY '- ' || name || ': ' || coalesce(error, '')) FILTER (NOT ok) AS details, count(*) FILTER (ok) AS good FROM s
"""
SQL["settings_flat"] = """
SELECT * FROM (VALUES ('language', 'en'), ('segmentation.max_gap_seconds', '0.65'), ('segmentation.pad_seconds', '0.12'), ('segmentation.min_words', '4'), ('segmentation.min_duration', '2.0'),
  ('segmentation.scene_cut_threshold', '0.3'), ('segmentation.subtitle_end_pad_seconds', '0.6'), ('segmentation.split_on_scene_cut', 'True'), ('segmentation.max_duration', '12.0'), ('captions.languages', 'en,de'),
  ('captions.use_manual', 'True'), ('captions.use_automatic', 'True'), ('quality.min_sharpness', '5.0'), ('quality.min_face_coverage', '0.8'), ('quality.min_asr_confidence', '0.72'), ('quality.min_active_speaker_score', '0.18')) v(name, value)
"""
SQL["settings_choices"] = """
SELECT * FROM (VALUES ('first_of', 'kept'), ('device', 'mps'), ('device_named', 'cpu'), ('selectors', 'b,a'), ('voiceover', 'True'), ('no_voiceover', 'False'), ('statuses', 'rejected,accepted')) v(name, value)
"""
_routed = (
    SQL["segments_merged"]
    .replace("FROM events\n), c AS", "FROM events WHERE user_id % 3 <> 1 OR user_id % 2 = 0\n), c AS")
    .replace("least(value / 491.7::DOUBLE, coalesce(CASE WHEN event_id % 2 = 0 THEN value / 403.3::DOUBLE END, 1.0)) AS p", "0 AS p")
)
SQL["transcript_route"] = f"""
SELECT CASE WHEN item_id % 3 = 0 THEN 'youtube_manual_subtitles' ELSE 'whisper' END AS transcript_source, count(DISTINCT item_id) AS items, count(*) AS segments, CAST(sum(word_count) AS BIGINT) AS words FROM ({_routed}) GROUP BY ALL
"""

# Boxes of a clip are put into tracks frame by frame, and in a frame track by track in the order in which they began.
SQL["face_tracks"] = f"""
WITH RECURSIVE {S._vec}, b AS MATERIALIZED (
  SELECT item_id AS clip, frame_idx % 20 AS k, CAST(trunc(v[1] * 60 + 300) AS INTEGER) AS ax, CAST(trunc(v[2] * 60 + 200) AS INTEGER) AS ay, CAST(trunc(v[3] * 60 + 50) AS INTEGER) + CAST(label AS INTEGER) * 90 AS bx, CAST(trunc(v[4] * 60 + 90) AS INTEGER) AS by_ FROM v
), walk AS (
  SELECT clip, CAST(-1 AS BIGINT) AS k, CAST([] AS STRUCT(x INTEGER, y INTEGER)[]) AS last, CAST([] AS STRUCT(t INTEGER, x INTEGER, y INTEGER)[]) AS got FROM (SELECT DISTINCT clip FROM b)
  UNION ALL
  SELECT clip, k, s.last, s.got FROM (
    SELECT w.clip, b.k, {{step}} AS s FROM walk w JOIN b ON b.clip = w.clip AND b.k = w.k + 1
  )
)
SELECT clip, CAST(g.t AS INTEGER) AS track, k AS frame_idx, g.x AS x1, g.y AS y1, g.x + 100 AS x2, g.y + 120 AS y2 FROM (SELECT clip, k, unnest(got) AS g FROM walk)
"""


def _step() -> str:
    """A frame of two boxes against the tracks: a fold over the tracks, each taking the free box that overlaps it most, then new tracks of what is free."""
    over = lambda p, x, y: f"(greatest(0, 100 - abs({p}.x - {x})) * greatest(0, 120 - abs({p}.y - {y})) / (24000 - greatest(0, 100 - abs({p}.x - {x})) * greatest(0, 120 - abs({p}.y - {y}))))"
    p = "w.last[i]"
    o1, o2 = f"CASE WHEN a.f1 THEN {over(p, 'b.ax', 'b.ay')} ELSE -1 END", f"CASE WHEN a.f2 THEN {over(p, 'b.bx', 'b.by_')} ELSE -1 END"
    second = f"({o2}) >= ({o1})"
    best = f"greatest({o1}, {o2}) >= 0.25"
    box = f"CASE WHEN {second} THEN {{'x': b.bx, 'y': b.by_}} ELSE {{'x': b.ax, 'y': b.ay}} END"
    start = "{'f1': true, 'f2': true, 'last': CAST([] AS STRUCT(x INTEGER, y INTEGER)[]), 'got': CAST([] AS STRUCT(t INTEGER, x INTEGER, y INTEGER)[]), 'i': 0}"
    fold = f"""list_reduce(list_transform(range(1, len(w.last) + 1), lambda i: {{'f1': true, 'f2': true, 'last': CAST([] AS STRUCT(x INTEGER, y INTEGER)[]), 'got': CAST([] AS STRUCT(t INTEGER, x INTEGER, y INTEGER)[]), 'i': CAST(i AS INTEGER)}}),
      lambda a, e: CASE WHEN {best} THEN {{'f1': a.f1 AND ({second}), 'f2': a.f2 AND NOT ({second}), 'last': list_append(a.last, {box}), 'got': list_append(a.got, {{'t': e.i - 1, 'x': ({box}).x, 'y': ({box}).y}}), 'i': e.i}}
        ELSE {{'f1': a.f1, 'f2': a.f2, 'last': list_append(a.last, {p}), 'got': a.got, 'i': e.i}} END, {start})""".replace("w.last[i]", "w.last[e.i]")
    add = lambda s, free, x, y: f"CASE WHEN {s}.{free} THEN {{'f1': {s}.f1, 'f2': {s}.f2, 'last': list_append({s}.last, {{'x': {x}, 'y': {y}}}), 'got': list_append({s}.got, {{'t': CAST(len({s}.last) AS INTEGER), 'x': {x}, 'y': {y}}}), 'i': 0}} ELSE {s} END"
    one = f"list_transform([{fold}], lambda s: {add('s', 'f1', 'b.ax', 'b.ay')})"
    return f"list_transform({one}, lambda s: {add('s', 'f2', 'b.bx', 'b.by_')})[1]"


SQL["face_tracks"] = SQL["face_tracks"].replace("{step}", _step())
