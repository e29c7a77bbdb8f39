"""DuckDB SQL of the queries."""

from __future__ import annotations

from ..config import CHECKS
from ..operators.verdict import METRICS

SQL: dict[str, str] = {}


def norm(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' +([,.!?;:])', '\1', 'g')"


def sentence_dedup(x: str) -> str:
    """Sentences whose key differs from the one before, or has nothing in it."""
    parts = f"list_transform(regexp_extract_all({x}, '[^!?.]+[!?.]?'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g')))"
    key = lambda s: f"regexp_replace(replace(lower({norm(s)}), 'ß', 'ss'), '^[.!?]+|[.!?]+$', '', 'g')"
    keys = f"list_transform({parts}, lambda s: {key('s')})"
    kept = f"list_transform(list_filter(list_zip({parts}, {keys}, list_concat([''], {keys})[:-2]), lambda z: z[2] = '' OR z[2] <> z[3]), lambda z: z[1])"
    return f"CASE WHEN len(regexp_extract_all({x}, '[^!?.]+[!?.]?')) = 0 THEN {norm(x)} ELSE {norm(f'array_to_string({kept}, chr(32))')} END"


def safe_id(x: str) -> str:
    clean = f"trim(regexp_replace({x}, '[^0-9A-Za-z._-]+', '_', 'g'), '._-')"
    return f"CASE WHEN {clean} <> '' THEN left({clean}, 100) ELSE left(sha1({x}), 16) END"


def slug(x: str) -> str:
    clean = f"trim(regexp_replace(lower(trim({x})), '[^0-9a-z._-]+', '-', 'g'), '-._')"
    return f"CASE WHEN {clean} <> '' THEN {clean} ELSE 'unknown' END"


TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"

SQL["caption_dedup"] = f"""
WITH w AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations),
p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM w WHERE len(w) > 0),
o AS (SELECT *, coalesce(list_max(list_filter(range(1, least(len(p), len(w)) + 1), lambda k: p[len(p) - k + 1:len(p)] = w[1:k])), 0) AS o FROM p)
SELECT conv_id AS item_id, turn AS ordinal, {norm("array_to_string(w[o + 1:len(w)], ' ')")} AS text FROM o WHERE o < len(w)
"""

SQL["cue_words"] = f"""
WITH w AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations),
x AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM w)
SELECT conv_id AS item_id, turn AS cue, CAST(k AS INTEGER) AS position, word, round(turn * 4.0::DOUBLE + k * (4.0::DOUBLE / n), 3) AS start, round(turn * 4.0::DOUBLE + (k + 1) * (4.0::DOUBLE / n), 3) AS "end",
       CASE WHEN conv_id % 2 = 0 THEN 0.82::DOUBLE ELSE 1.0::DOUBLE END AS probability, 'subtitle' AS timing_source FROM x
"""

SQL["vtt_parse"] = f"""
WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role, regexp_replace(text, '\\s+', ' ', 'g') AS x FROM conversations)
SELECT conv_id AS item_id, CAST(i AS INTEGER) AS ordinal, turn * 400 + (turn * 400 * 7 % 1000) / 1000.0::DOUBLE AS start, turn * 400 + 300 + ((turn * 400 + 300) * 7 % 1000) / 1000.0::DOUBLE AS "end",
       {norm("x || ' & more'")} AS text FROM b
"""

SQL["normalize_text"] = f"SELECT doc_id, {norm('text')} AS text FROM documents"
SQL["sentence_dedup"] = f"SELECT doc_id, {sentence_dedup('text')} AS text FROM documents"

SQL["safe_id"] = f"""
SELECT page_id, {safe_id("url")} AS id FROM pages
UNION ALL SELECT page_id, {safe_id("x")} FROM (SELECT p_partkey AS page_id, '--' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END || '__' AS x FROM part)
"""
SQL["slug"] = f"""
SELECT id, {slug("x")} AS slug FROM (SELECT c_custkey AS id, ' ' || c_name || '  ' || c_mktsegment || '-_' AS x FROM customer
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CASE WHEN n_nationkey % 6 = 0 THEN '?!' ELSE n_name END FROM nation)
"""

SQL["source_modes"] = """
WITH l AS (SELECT 'list' || page_id % 2 AS file, CAST(page_id AS INTEGER) AS line_no, page_id % 4 AS m, url || CASE WHEN page_id % 8 = 3 THEN '?list=1' ELSE '' END AS url FROM pages WHERE page_id % 4 <> 2)
SELECT file, line_no, CASE m WHEN 0 THEN 'video' WHEN 1 THEN 'playlist' ELSE 'auto' END AS mode, url, m = 1 OR (m = 3 AND (contains(url, 'list=') OR contains(url, '/playlist'))) AS playlist FROM l
"""
_two = """
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'video ' ELSE '' END AS mode, regexp_replace(url, '\\?.*|#.*', '') AS url FROM pages),
a AS (SELECT * FROM p WHERE page_id % 2 = 0), b AS (SELECT DISTINCT url FROM p WHERE page_id % 10 = 0 OR page_id % 2 = 1)
"""
SQL["source_anti_dedup"] = _two + "SELECT 'a' AS file, CAST(page_id AS INTEGER) AS line_no, mode || url AS raw FROM a WHERE url NOT IN (SELECT url FROM b)"
SQL["source_skipped"] = _two + "SELECT count(*) AS skipped FROM a WHERE url IN (SELECT url FROM b)"


def segment_sql(low: float, high: float, gap: float, min_words: int, *, cuts: bool, strict: bool) -> str:
    """Two recursive walks: over the words of an item, then over its groups."""
    h = "epoch_us(ts) / 3.6e9::DOUBLE - 473352.0::DOUBLE"
    between = lambda x, y, i: f"EXISTS (SELECT 1 FROM c WHERE c.item_id = {i} AND {x} <= c.t AND c.t <= {y})" if cuts else "false"
    merge = "false" if strict else f"(g.ze - g.sa < {low} OR g.n < {min_words}) AND g.ze - m.ms <= {high} AND NOT {between('m.me', 'g.sa', 'g.item_id')}"
    limit = lambda f, cond, none: f"(SELECT {f}(t) FROM c WHERE c.item_id = m.item_id AND {cond})" if cuts else none
    return f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT user_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type || CASE WHEN event_id % 4 = 0 THEN '.' WHEN event_id % 9 = 0 THEN '?' ELSE '' END AS word,
         {h} AS s, {h} + 0.5 AS e, least(value / 491.7::DOUBLE, coalesce(CASE WHEN event_id % 2 = 0 THEN value / 403.3::DOUBLE END, 1.0)) AS p, user_id % 3 = 0 AS sub FROM events
), c AS MATERIALIZED (SELECT user_id AS item_id, {h} + 0.25 AS t FROM events WHERE event_type = 'error'),
x AS MATERIALIZED (SELECT *, lag(e) OVER v AS pe, regexp_matches(lag(word) OVER v, '[.!?]$') AS sb FROM w WINDOW v AS (PARTITION BY item_id ORDER BY i)),
y AS MATERIALIZED (SELECT *, {between('x.pe', 'x.e', 'x.item_id')} AS crosses FROM x),
walk AS (
  SELECT item_id, i, 1 AS g, s AS gs FROM y WHERE i = 1
  UNION ALL
  SELECT y.item_id, y.i, CASE WHEN {{close}} THEN r.g + 1 ELSE r.g END, CASE WHEN {{close}} THEN y.s ELSE r.gs END
  FROM walk r JOIN y ON y.item_id = r.item_id AND y.i = r.i + 1
), gs AS MATERIALIZED (
  SELECT item_id, g, min(i) AS a, max(i) AS z, arg_min(s, i) AS sa, arg_max(e, i) AS ze, count(*) AS n FROM walk JOIN y USING (item_id, i) GROUP BY item_id, g
), merged AS (
  SELECT item_id, g, 0 AS m, sa AS ms, ze AS me FROM gs WHERE g = 1
  UNION ALL
  SELECT g.item_id, g.g, CASE WHEN {merge} THEN m.m ELSE m.m + 1 END, CASE WHEN {merge} THEN m.ms ELSE g.sa END, g.ze FROM merged m JOIN gs g ON g.item_id = m.item_id AND g.g = m.g + 1
), m AS MATERIALIZED (
  SELECT item_id, m, arg_min(y.s, i) AS ra, arg_max(y.e, i) AS rz, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS txt, sum(p) / count(*) AS conf, bool_or(sub) AS sub
  FROM merged JOIN gs USING (item_id, g) JOIN y USING (item_id) WHERE y.i BETWEEN a AND z GROUP BY item_id, m
), d AS (
  SELECT *, greatest(0.0, ra - 0.12, coalesce({limit('max', 'c.t <= m.ra', 'NULL')}, 0.0)) AS s0, least(rz + pad, coalesce({limit('min', 'c.t >= m.rz', 'NULL')}, rz + pad)) AS e0
  FROM (SELECT *, CASE WHEN sub THEN 0.6 ELSE 0.12 END AS pad FROM m) m WHERE n >= {min_words}
)
SELECT item_id, printf('%06d', CAST(m AS INTEGER)) AS segment_id, round(s0, 3) AS start, round(e0, 3) AS "end", round(e0 - s0, 3) AS duration, {sentence_dedup(f"({norm('txt')})")} AS text, CAST(n AS INTEGER) AS word_count, round(conf, 5) AS asr_confidence
FROM d WHERE e0 - s0 >= {low} AND e0 - s0 <= {high} + 0.12 + pad
""".replace("{close}", f"(y.crosses OR y.e - r.gs > {high} OR ({str(strict).lower()} AND y.sb) OR ((y.sb OR y.s - y.pe > {gap}) AND y.pe - r.gs >= {low}))")


SQL["segments_greedy"] = segment_sql(0.0, 72.0, 6.0, 1, cuts=False, strict=False)
SQL["segments_merged"] = segment_sql(12.0, 72.0, 6.0, 2, cuts=False, strict=False)
SQL["segments_strict"] = segment_sql(12.0, 72.0, 6.0, 2, cuts=True, strict=True)
SQL["segments_cut"] = segment_sql(12.0, 72.0, 6.0, 2, cuts=True, strict=False)
SQL["segments_intro_reindex"] = f"""SELECT * REPLACE (printf('%06d', CAST(row_number() OVER (PARTITION BY item_id ORDER BY segment_id) - 1 AS INTEGER)) AS segment_id) FROM ({SQL["segments_cut"]}) WHERE start >= 200"""

SQL["asr_confidence"] = """
WITH s AS (
  SELECT CAST(user_id AS VARCHAR) AS item_id, event_type AS word, value, CASE WHEN event_id % 11 <> 0 THEN value + 1 END AS e, value / 200 AS ns,
         greatest(0.0, least(1.0, 1 + coalesce(nullif(CASE WHEN event_id % 13 = 0 THEN 0.0 WHEN event_id % 17 <> 0 THEN -value / 100 END, 0.0), -99.0) / 4)) AS conf FROM events
), w AS (SELECT item_id, count(*) AS words, round(avg(least(value / 500, conf)), 8) AS asr_confidence FROM s WHERE ns <= 0.45 AND e IS NOT NULL GROUP BY item_id)
SELECT item_id, count(*) AS segments, round(avg(conf), 8) AS confidence, any_value(words) AS words, any_value(asr_confidence) AS asr_confidence FROM s LEFT JOIN w USING (item_id) GROUP BY item_id
"""

_frames = """f AS MATERIALIZED (
  SELECT user_id AS item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx, value > 12 AS visible, event_type = 'error' AS cut, event_type = 'signup' AS unstable,
         value / 2000 AS mm, value / 20000 AS ms, event_id % 100 / 20000.0::DOUBLE AS mo, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS energy FROM events
)"""
_audio = """q AS (SELECT item_id, quantile_cont(energy, 0.55) FILTER (energy > 0) AS lo, nullif(quantile_cont(energy, 0.95) FILTER (energy > 0), 0) AS sc FROM f GROUP BY item_id),
au AS MATERIALIZED (SELECT item_id, frame_idx, coalesce(energy >= lo, false) AS audio_active, CASE WHEN sc IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, energy / sc)) END AS audio_energy FROM f JOIN q USING (item_id))"""
_runs = """r AS (SELECT item_id, run, count(*) FILTER (NOT visible) AS n FROM (SELECT *, sum(CAST({v} AS INTEGER)) OVER (PARTITION BY item_id ORDER BY frame_idx) AS run, {v} AS visible FROM {t}) GROUP BY item_id, run)"""
_corr = "CASE WHEN count(*) FILTER ({c}) >= 3 AND coalesce(stddev_pop({x}) FILTER ({c}), 0) > 1e-6 AND coalesce(stddev_pop({y}) FILTER ({c}), 0) > 1e-6 THEN covar_pop({x}, {y}) FILTER ({c}) / (stddev_pop({x}) FILTER ({c}) * stddev_pop({y}) FILTER ({c})) ELSE 0 END"
_metrics = f"""WITH {_frames}, {_audio},
h AS MATERIALIZED (
  SELECT f.item_id, f.frame_idx, s.visible, f.cut, s.unstable, s.mm, s.ms, s.mo, audio_active, audio_energy FROM f JOIN f s ON s.item_id = f.item_id AND s.frame_idx = f.frame_idx - f.frame_idx % 5 JOIN au ON au.item_id = f.item_id AND au.frame_idx = f.frame_idx
), {_runs.format(v="visible", t="h0").replace("h0", "(SELECT item_id, frame_idx, visible FROM h)").replace("SELECT *, sum", "SELECT item_id, frame_idx, sum")},
met AS MATERIALIZED (
  SELECT item_id, avg(CAST(visible AS INTEGER)) AS mouth_visible_ratio, avg(CAST(cut AS INTEGER)) AS scene_cut_ratio,
    coalesce(count(*) FILTER (audio_active AND visible AND mm < 0.018) / nullif(count(*) FILTER (audio_active AND visible), 0), 1.0) AS static_speech_ratio,
    coalesce(count(*) FILTER (audio_active AND visible AND (ms >= 0.0035 OR mo >= 0.0025)) / nullif(count(*) FILTER (audio_active AND visible), 0), 0.0) AS speech_mouth_motion_ratio,
    {_corr.format(c="visible AND audio_energy > 0", x="audio_energy", y="ms")} AS lip_sync_correlation,
    {_corr.format(c="visible AND audio_energy > 0", x="audio_energy", y="mo")} AS mouth_opening_correlation,
    any_value(longest) / 25.0::DOUBLE AS max_missing_run_seconds,
    coalesce(count(*) FILTER (unstable AND visible) / nullif(count(*) FILTER (visible), 0), 1.0) AS unstable_landmark_ratio
  FROM h JOIN (SELECT item_id, max(n) AS longest FROM r GROUP BY item_id) USING (item_id) GROUP BY item_id
)"""
_names = METRICS
SQL["frame_sampled_metrics"] = _metrics + "SELECT item_id, " + ", ".join(f"round({n}, 7) AS {n}" for n in _names) + " FROM met"
SQL["missing_run"] = f"WITH {_frames}, {_runs.format(v='visible', t='f').replace('SELECT *, sum', 'SELECT item_id, frame_idx, sum')} SELECT item_id, max(n) AS longest FROM r GROUP BY item_id"
SQL["audio_activity"] = f"WITH {_frames}, {_audio} SELECT item_id, frame_idx, audio_active, round(audio_energy, 8) AS audio_energy FROM au"
SQL["lip_sync_corr"] = f"""SELECT l_suppkey, round({_corr.format(c="true", x="l_quantity", y="s")}, 6) AS r, round({_corr.format(c="true", x="l_extendedprice", y="l_quantity")}, 6) AS rp
FROM (SELECT *, CASE WHEN l_suppkey % 10 = 0 THEN 1.0::DOUBLE ELSE l_discount END AS s FROM lineitem) GROUP BY l_suppkey"""

_vec = "v AS MATERIALIZED (SELECT vec_id // 20 AS item_id, vec_id AS frame_idx, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
_dist = "sqrt(greatest(0.0, 1 - list_sum(list_transform(list_zip(p, h), lambda z: sqrt(z[1] * z[2]))) / nullif(sqrt(list_sum(p) * list_sum(h)), 0)))"
_lagged = "l AS (SELECT *, lag(h) OVER (PARTITION BY item_id ORDER BY frame_idx) AS p FROM h)"
SQL["scene_cut_flags"] = f"WITH {_vec}, h AS (SELECT *, list_transform(v, lambda x: greatest(x, 0.0)) AS h FROM v), {_lagged} SELECT item_id, frame_idx, coalesce({_dist} >= 0.7, false) AS cut FROM l"
SQL["hist_distance"] = f"WITH {_vec}, h AS (SELECT *, list_transform(v, lambda x: abs(x)) AS h FROM v), {_lagged} SELECT frame_idx, CASE WHEN p IS NOT NULL THEN round({_dist}, 7) END AS distance FROM l"
SQL["landmark_jump"] = f"""
WITH {_vec}, s AS (
  SELECT item_id, frame_idx, CASE WHEN frame_idx % 15 <> 0 THEN v[1:4] END AS geo, v[6] AS opening, list_transform(v[7:14], lambda x: floor(x * 100)) AS gray, v[17:20] AS sx, v[21:24] AS sy,
         frame_idx % 15 <> 0 AND frame_idx % 25 <> 0 AS ok FROM v WHERE frame_idx % 5 = 0
), l AS (
  SELECT *, ok AND coalesce(lag(ok) OVER w, false) AS two, lag(geo) OVER w AS pgeo, lag(opening) OVER w AS pop, lag(gray) OVER w AS pgray, lag(sx) OVER w AS psx, lag(sy) OVER w AS psy FROM s WINDOW w AS (PARTITION BY item_id ORDER BY frame_idx)
), m AS (
  SELECT item_id, frame_idx AS at, ok AS visible, coalesce(sqrt(list_sum(list_transform(list_zip(geo, pgeo), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) > 0.3, false) AS unstable,
         CASE WHEN two THEN list_sum(list_transform(list_zip(gray, pgray), lambda z: abs(z[1] - z[2]))) / 8 / 255.0::DOUBLE ELSE 0 END AS mm,
         CASE WHEN two THEN list_sum(list_transform(range(1, 5), lambda i: sqrt((sx[i] - psx[i]) * (sx[i] - psx[i]) + (sy[i] - psy[i]) * (sy[i] - psy[i])))) / 4 ELSE 0 END AS ms, CASE WHEN two THEN abs(opening - pop) ELSE 0 END AS mo FROM l
)
SELECT v.item_id, v.frame_idx, visible, unstable, round(mm, 8) AS mouth_motion, round(ms, 8) AS mouth_shape_motion, round(mo, 8) AS mouth_opening_motion FROM v LEFT JOIN m ON m.item_id = v.item_id AND m.at = v.frame_idx - v.frame_idx % 5
"""
_mirror = lambda x: f"(CASE WHEN {x} < 0 THEN -({x}) WHEN {x} >= 8 THEN 14 - ({x}) ELSE {x} END)"
SQL["laplacian_sharpness"] = f"""
WITH {_vec}, l AS (
  SELECT frame_idx, list_transform(range(0, 64), lambda i: p[{_mirror("i // 8 - 1")} * 8 + i % 8 + 1] + p[{_mirror("i // 8 + 1")} * 8 + i % 8 + 1] + p[i // 8 * 8 + {_mirror("i % 8 - 1")} + 1] + p[i // 8 * 8 + {_mirror("i % 8 + 1")} + 1] - 4 * p[i + 1]) AS l
  FROM (SELECT frame_idx, list_transform(v, lambda x: x * 100) AS p FROM v)
) SELECT frame_idx, round(list_var_pop(l), 5) AS sharpness FROM l
"""
SQL["speaker_scores"] = """
WITH s AS (SELECT vec_id, CASE WHEN vec_id % 19 = 0 THEN [] WHEN vec_id % 2 = 0 THEN list_transform(embedding, lambda x: x::DOUBLE * 12 + 1) ELSE list_transform(embedding, lambda x: abs(x)::DOUBLE * 1.5) END AS x FROM embeddings),
p AS (SELECT vec_id, CASE WHEN len(list_filter(x, lambda y: y < 0 OR y > 1)) > 0 THEN list_transform(x, lambda y: 1 / (1 + exp(-greatest(-30.0, least(30.0, y))))) ELSE x END AS p FROM s),
r AS (SELECT vec_id, len(p) AS n, CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda y: y >= 0.6)) / len(p) ELSE 0 END AS r, coalesce(list_avg(p), 0) AS m, coalesce(list_max(p), 0) AS x FROM p),
v AS (SELECT *, CASE WHEN n = 0 THEN 'rejected' WHEN r >= 0.65 THEN 'accepted' WHEN r >= 0.4 THEN 'review' ELSE 'rejected' END AS st FROM r)
SELECT vec_id, round(r, 5) AS speaking_ratio, round(m, 5) AS mean_probability, round(x, 5) AS max_probability, st AS speaker_status,
       CASE st WHEN 'review' THEN 'borderline_on_screen_speaker' WHEN 'rejected' THEN 'no_on_screen_active_speaker' END AS speaker_reason FROM v
"""
_iou = lambda a, b: f"(greatest(0, least({a}.x, {b}.x) + 100 - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y, {b}.y) + 120 - greatest({a}.y, {b}.y)))"
SQL["iou_pairs"] = f"""
WITH {_vec}, b AS (
  SELECT item_id AS clip, frame_idx % 20 AS frame_idx, {{'x': CAST(trunc(v[1] * 60 + 300) AS INTEGER), 'y': CAST(trunc(v[2] * 60 + 200) AS INTEGER)}} AS a, {{'x': CAST(trunc(v[3] * 60 + 50) AS INTEGER) + label * 90, 'y': CAST(trunc(v[4] * 60 + 90) AS INTEGER)}} AS c FROM v
), l AS (SELECT *, lag(a) OVER (PARTITION BY clip ORDER BY frame_idx) AS p FROM b)
SELECT clip, frame_idx, round({_iou("p", "a")} / greatest(1, 24000 - {_iou("p", "a")}), 8) AS same, round({_iou("p", "c")} / greatest(1, 24000 - {_iou("p", "c")}), 8) AS other FROM l WHERE p IS NOT NULL
"""
SQL["track_select"] = """
WITH e AS (SELECT vec_id // 20 AS clip, label AS track, CASE WHEN vec_id % 5 <> 0 THEN abs(embedding[1])::DOUBLE END AS motion FROM embeddings),
n AS (SELECT clip, count(*) AS frames FROM e GROUP BY clip),
s AS (SELECT clip, track, coalesce(avg(motion), 0) * least(1.0, count(*) / any_value(frames) / 0.8) AS score, count(*) / any_value(frames) AS coverage FROM e JOIN n USING (clip) GROUP BY clip, track)
SELECT clip, track, round(score, 5) AS score, round(coverage, 5) AS coverage FROM s QUALIFY row_number() OVER (PARTITION BY clip ORDER BY score DESC, coverage DESC, track) = 1
"""

_loose = {"mouth_visible_ratio": "mouth_visible_ratio + 0.3", "scene_cut_ratio": "scene_cut_ratio / 30", "unstable_landmark_ratio": "unstable_landmark_ratio / 4", "static_speech_ratio": "static_speech_ratio / 4", "lip_sync_correlation": "lip_sync_correlation - 0.9"}


def _every(at: int, verify: bool) -> str:
    return " AND ".join(f"{c[0]} {'>=' if c[1] == 'high' else '<='} {c[at]}" for c in CHECKS if verify or not c[5])


def _judged(verify: bool) -> str:
    why = "list_filter([" + ", ".join(f"CASE WHEN NOT ({c[0]} {'>=' if c[1] == 'high' else '<='} {c[2]}) THEN '{c[4]}' END" for c in CHECKS if verify or not c[5]) + "], lambda x: x IS NOT NULL)"
    intro = """, CASE WHEN start < 15 THEN 'voiceover_intro_window' WHEN st = 'review' THEN 'voiceover_review_rejected' END AS why""" if verify else ", NULL AS why"
    return (
        _metrics
        + ", mm2 AS (SELECT item_id, "
        + ", ".join(f"round({_loose.get(n, n)}, 7) AS {n}" for n in _names)
        + f""" FROM met WHERE item_id % 9 <> 0), cl AS (
  SELECT user_id AS item_id, (count(*) % 40)::DOUBLE AS start, 0.6::DOUBLE + count(*) % 30 / 60 AS asr, CASE WHEN user_id % 20 = 7 THEN 0.5 ELSE 1.0 END AS cov, max(value) / 5 AS sharp, user_id % 13 <> 0 AS face FROM events GROUP BY user_id
), j0 AS (
  SELECT cl.*, mm2.* EXCLUDE (item_id), CASE WHEN mm2.item_id IS NULL THEN 'rejected' WHEN {_every(2, verify)} THEN 'accepted' WHEN {_every(3, verify)} THEN 'review' ELSE 'rejected' END AS st, CASE WHEN mm2.item_id IS NULL THEN ['empty_video'] ELSE {why} END AS re FROM cl LEFT JOIN mm2 ON mm2.item_id = cl.item_id
), j1 AS (SELECT *{intro} FROM j0), j AS MATERIALIZED (SELECT * REPLACE (CASE WHEN why IS NOT NULL THEN 'rejected' ELSE st END AS st, CASE WHEN why IS NOT NULL THEN list_append(re, why) ELSE re END AS re) FROM j1)
"""
    )


SQL["verdict_status"] = _judged(False) + "SELECT item_id, st AS visual_status, round(coalesce(mouth_visible_ratio, 0.0), 5) AS mouth_visible_ratio, round(coalesce(scene_cut_ratio, 1.0), 5) AS scene_cut_ratio, round(coalesce(static_speech_ratio, 1.0), 5) AS static_speech_ratio FROM j"
SQL["verdict_reasons"] = _judged(True) + "SELECT item_id, st AS visual_status, array_to_string(re, '|') AS reasons FROM j"
_gate = (
    _judged(False)
    + """, g0 AS (SELECT * REPLACE (CASE WHEN st <> 'rejected' AND NOT face THEN 'rejected' ELSE st END AS st, CASE WHEN st <> 'rejected' AND NOT face THEN list_append(re, 'auto_avsr_no_face') ELSE re END AS re) FROM j),
g AS (SELECT *, CASE WHEN asr < 0.72 OR cov < 0.8 OR st = 'rejected' OR sharp < 18 THEN 'rejected' WHEN st = 'review' THEN 'review' ELSE 'accepted' END AS q FROM g0)
"""
)
_path = "CASE WHEN q = 'rejected' THEN '' ELSE 'clips/' || item_id || '/source.mp4' END"
SQL["final_gate"] = _gate + f"SELECT item_id, q AS quality_status, q = 'accepted' AS accepted, array_to_string(re, '|') AS reasons, round(CASE WHEN st = 'rejected' THEN 0.0 ELSE sharp END, 6) AS sharpness, {_path} AS video_path FROM g"
_manifest = (
    _gate
    + f""", mf AS (SELECT CAST(item_id AS VARCHAR) AS item_id, '000000' AS segment_id, {_path} AS video_path, CAST(NULL AS VARCHAR) AS mouth_path, start, url AS source_url, {safe_id("url")} AS title, q AS quality_status, CAST(NULL AS VARCHAR) AS talknet_status,
  round(coalesce(mouth_visible_ratio, 0.0), 5) AS mouth_visible_ratio, round(coalesce(scene_cut_ratio, 1.0), 5) AS scene_cut_ratio, array_to_string(re, '|') AS visual_quality_reasons, q = 'accepted' AS accepted FROM g LEFT JOIN pages ON page_id = item_id)
"""
)
SQL["manifest_flat"] = _manifest + "SELECT * FROM mf"
for _s in ("accepted", "review", "rejected"):
    SQL[f"manifest_{_s}"] = _manifest + f"SELECT * FROM mf WHERE quality_status = '{_s}'"
SQL["inspect_head"] = _manifest + "SELECT CASE WHEN accepted THEN 'ACCEPT' ELSE 'REJECT' END AS verdict, item_id, segment_id, start, start + 5 AS \"end\", left('text of ' || source_url || source_url, 70) AS text FROM mf ORDER BY item_id, segment_id LIMIT 12"
SQL["push_selection"] = _manifest + "SELECT 'manifests/**' AS path UNION ALL SELECT 'clips/' || item_id || '/' || segment_id || '/' || f FROM mf, (VALUES ('metadata.json'), ('transcript.txt'), ('audio.wav'), ('mouth.mp4')) v(f) WHERE quality_status IN ('accepted', 'review')"
SQL["pull_contributor"] = f"""
SELECT {slug("n_name")} AS contributor, CASE o_orderstatus WHEN 'F' THEN 'accepted' ELSE 'review' END AS status, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL
"""
_log = """WITH l AS (SELECT CAST(user_id AS VARCHAR) AS item_id, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 5 = 0 THEN 'failed' ELSE 'done' END AS status, CAST(event_id AS VARCHAR) AS detail, ts FROM events),
s AS (SELECT item_id, stage, status, detail FROM l QUALIFY row_number() OVER (PARTITION BY item_id, stage ORDER BY ts DESC, status DESC) = 1)
"""
SQL["stage_latest"] = _log + "SELECT * FROM s"
SQL["stage_pending"] = _log + "SELECT DISTINCT item_id FROM l WHERE item_id NOT IN (SELECT item_id FROM s WHERE stage = 'click' AND status = 'done' AND CAST(item_id AS INTEGER) % 8 <> 0)"
SQL["caption_choice"] = """
WITH e AS (SELECT doc_id // 3 AS item_id, source < 'src3' AS auto, lang, doc_id, CASE n_chars % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'vtt' ELSE 'ttml' END AS ext, CASE WHEN doc_id % 7 <> 0 THEN 'u' || doc_id END AS url FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY auto, CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, CASE ext WHEN 'vtt' THEN 0 ELSE 1 END, doc_id) AS k FROM e WHERE url IS NOT NULL AND ext <> 'ttml' AND lang IN ('de', 'fr', 'en'))
SELECT i.item_id, lang AS language, url, ext, CASE WHEN auto THEN 'automatic' WHEN NOT auto THEN 'manual' END AS kind FROM (SELECT DISTINCT doc_id // 3 AS item_id FROM documents) i LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (item_id)
"""
SQL["file_pick"] = """
WITH f AS (SELECT source AS item_id, ['mp4', 'mkv', 'mp4.part', 'webm', 'txt'][doc_id % 5 + 1] AS x, doc_id, n_chars AS size FROM documents)
SELECT item_id, 'f' || doc_id || '.' || x AS path, size FROM f WHERE x IN ('mp4', 'mkv', 'webm') QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY x = 'mp4' DESC, size DESC, 'f' || doc_id || '.' || x) = 1
"""
