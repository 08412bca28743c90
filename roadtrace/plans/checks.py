"""DuckDB SQL for the rows of the library's queries, written apart from the Spark plans."""

from __future__ import annotations

from roadtrace.operators.datasets import ADVICE
from roadtrace.schemas import DETECTION_CLASSES, VIOLATION_NAMES
from roadtrace.sources.adapters import with_tables as over

SQL: dict[str, str] = {}
#: The key under which the queries' plates are pseudonyms.
SECRET = "a study's own secret"

_PAD = SECRET.encode().ljust(64, b"\0")
_INNER, _OUTER = (bytes(b ^ x for b in _PAD).hex() for x in (0x36, 0x5C))
_PSEUDONYM = f"CASE WHEN license_plate <> '' THEN 'PLATE-' || upper(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(license_plate))))[1:10]) END"

# Tracks: rows with position, size, class and centre; their segments; their ends.
_TRACKS = """, tr0 AS (SELECT d.*, (bbox_x1 + bbox_x2) / 2 AS cx, (bbox_y1 + bbox_y2) / 2 AS cy, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_no, id) - 1 AS pos,
  count(*) OVER (PARTITION BY video_id, track_id) AS n FROM detections d WHERE track_id IS NOT NULL),
cls AS (SELECT video_id, track_id, class_name AS track_class FROM (SELECT video_id, track_id, class_name, row_number() OVER (PARTITION BY video_id, track_id ORDER BY count(*) DESC, class_name) AS k FROM tr0 GROUP BY video_id, track_id, class_name) WHERE k = 1),
tr AS (SELECT * FROM tr0 JOIN cls USING (video_id, track_id)),
veh AS (SELECT * FROM tr WHERE track_class IN ('vehicle', 'motorcycle')),
seg AS (SELECT * FROM (SELECT video_id, track_id, track_class, n, pos, cx AS x1, cy AS y1, lead(cx) OVER w AS x2, lead(cy) OVER w AS y2, timestamp_ms AS ms1, lead(timestamp_ms) OVER w AS ms2, lead(frame_no) OVER w AS frame_no
  FROM tr WINDOW w AS (PARTITION BY video_id, track_id ORDER BY pos)) WHERE x2 IS NOT NULL),
ends AS (SELECT video_id, track_id, track_class AS class_name, n, first(frame_no ORDER BY pos) AS start_frame, last(frame_no ORDER BY pos) AS end_frame, first(timestamp_ms ORDER BY pos) AS start_ms, last(timestamp_ms ORDER BY pos) AS end_ms FROM tr GROUP BY ALL),
rates AS (SELECT id AS video_id, CASE WHEN fps <> 0 THEN fps ELSE 30 END AS fps FROM videos),
speeds AS (SELECT video_id, track_id, meters_per_px, CASE WHEN ms > 0 THEN px * meters_per_px / (ms / 1000.0) * 3.6 ELSE 0 END AS kmh FROM (SELECT video_id, track_id, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS px, max(ms2) - min(ms1) AS ms FROM seg WHERE track_class IN ('vehicle', 'motorcycle') GROUP BY ALL) JOIN calibrations USING (video_id) WHERE meters_per_px > 0)"""
_T = ("detections", "videos", "calibrations")


def _tracks(query: str, *more: str) -> str:
    return over(f"{_TRACKS}{query}", *_T, *more)


def _crossing(y: float) -> str:
    """First crossing of the horizontal line from x = 0 to 1000 at y: strictly, by segments of vehicles."""
    return f""", hit AS (SELECT video_id, track_id, min(pos) + 1 AS pos FROM seg WHERE track_class IN ('vehicle', 'motorcycle') AND (y1 - {y}) * (y2 - {y}) < 0
  AND x1 + (x2 - x1) * ({y} - y1) / (y2 - y1) > 0 AND x1 + (x2 - x1) * ({y} - y1) / (y2 - y1) < 1000 GROUP BY ALL),
crossed AS (SELECT h.video_id, h.track_id, tr.frame_no FROM hit h JOIN tr USING (video_id, track_id, pos))"""


_OUT = " SELECT video_id, '{}' AS violation_type, track_id, start_ms, end_ms, {} AS confidence, evidence FROM "
_MS = "CAST(floor({} * 1000 / fps) AS INT)"

SQL["build_tracks"] = _tracks(" SELECT video_id, track_id, track_class, count(*) AS n, CAST(sum(pos * frame_no) AS BIGINT) AS order_sum FROM tr GROUP BY ALL")
SQL["track_summary"] = _tracks(" SELECT *, end_ms - start_ms AS duration_ms FROM ends")
SQL["track_segments"] = _tracks(" SELECT video_id, track_id, count(*) AS n, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 3) AS path_px, CAST(sum(frame_no) AS BIGINT) AS frames FROM seg GROUP BY ALL")
SQL["detections_by_frame"] = over(" SELECT video_id, frame_no, count(*) AS n, string_agg(class_name, ',' ORDER BY id) AS classes FROM detections GROUP BY ALL", "detections")
SQL["consecutive_runs"] = over(
    """, f AS (SELECT DISTINCT video_id, class_name, frame_no FROM detections),
g AS (SELECT *, CASE WHEN frame_no - lag(frame_no) OVER (PARTITION BY video_id, class_name ORDER BY frame_no) > 3 THEN 1 ELSE 0 END AS new FROM f),
h AS (SELECT *, sum(new) OVER (PARTITION BY video_id, class_name ORDER BY frame_no) AS run FROM g)
SELECT video_id, class_name, min(frame_no) AS run_start, max(frame_no) AS run_end, count(*) AS n_frames FROM h GROUP BY video_id, class_name, run""",
    "detections",
)
SQL["first_crossing"] = _tracks(f"{_crossing(250.5)} SELECT * FROM crossed")
SQL["rule_red_light_running"] = _tracks(
    f"""{_crossing(250.5)}, red AS (SELECT DISTINCT video_id, frame_no FROM detections WHERE class_name = 'traffic_light_red'),
mid AS (SELECT c.video_id, c.track_id, min(veh.pos) AS p FROM crossed c JOIN red USING (video_id, frame_no) JOIN veh USING (video_id, track_id, frame_no) GROUP BY ALL),
e AS (SELECT a.video_id, a.track_id, string_agg(frame_no, ',' ORDER BY pos) AS evidence FROM mid a JOIN veh USING (video_id, track_id) WHERE abs(pos - p) <= 2 GROUP BY ALL)"""
    + _OUT.format("red_light_running", "0.85::DOUBLE")
    + "e JOIN ends USING (video_id, track_id)"
)
SQL["rule_wrong_direction"] = _tracks(
    """, mot AS (SELECT video_id, track_id, n, atan2(last(y2 ORDER BY pos) - first(y1 ORDER BY pos), last(x2 ORDER BY pos) - first(x1 ORDER BY pos)) AS h FROM seg WHERE track_class IN ('vehicle', 'motorcycle') GROUP BY ALL),
mean AS (SELECT video_id, atan2(sum(sin(h)), sum(cos(h))) AS p FROM mot GROUP BY ALL HAVING count(*) >= 3),
d AS (SELECT video_id, track_id, atan2(y2 - y1, x2 - x1) - p + pi() AS a FROM seg JOIN mean USING (video_id) WHERE track_class IN ('vehicle', 'motorcycle')),
s AS (SELECT video_id, track_id, avg(CASE WHEN abs(abs(a - floor(a / (2 * pi())) * 2 * pi() - pi()) - pi()) < pi() / 3 THEN 1.0 ELSE 0 END) AS share FROM d GROUP BY ALL HAVING share >= 0.8),
e AS (SELECT video_id, track_id, share, string_agg(frame_no, ',' ORDER BY pos) AS evidence FROM s JOIN veh USING (video_id, track_id) WHERE pos % greatest(1, n // 3) = 0 GROUP BY ALL)"""
    + _OUT.format("wrong_direction", "round(least(0.95, share), 4)")
    + "e JOIN ends USING (video_id, track_id) WHERE end_ms - start_ms >= 2000"
)
SQL["rule_no_helmet"] = _tracks(
    """, bare AS (SELECT * FROM tr m WHERE track_class = 'motorcycle'
  AND EXISTS (SELECT 1 FROM detections p WHERE p.video_id = m.video_id AND p.frame_no = m.frame_no AND p.class_name = 'person' AND (p.bbox_x1 + p.bbox_x2) / 2 BETWEEN m.bbox_x1 AND m.bbox_x2 AND (p.bbox_y1 + p.bbox_y2) / 2 < m.cy)
  AND NOT EXISTS (SELECT 1 FROM detections p WHERE p.video_id = m.video_id AND p.frame_no = m.frame_no AND p.class_name = 'helmet' AND
   (SELECT CASE WHEN i > 0 THEN i / ((p.bbox_x2 - p.bbox_x1) * (p.bbox_y2 - p.bbox_y1) + (m.bbox_x2 - m.bbox_x1) * (m.bbox_y2 - m.bbox_y1) - i) ELSE 0 END FROM (SELECT greatest(0, least(p.bbox_x2, m.bbox_x2) - greatest(p.bbox_x1, m.bbox_x1)) * greatest(0, least(p.bbox_y2, m.bbox_y2) - greatest(p.bbox_y1, m.bbox_y1)) AS i)) >= 0.1)),
f AS (SELECT DISTINCT video_id, track_id, frame_no FROM bare),
g AS (SELECT *, CASE WHEN frame_no - lag(frame_no) OVER (PARTITION BY video_id, track_id ORDER BY frame_no) > 3 THEN 1 ELSE 0 END AS new FROM f),
h AS (SELECT *, sum(new) OVER (PARTITION BY video_id, track_id ORDER BY frame_no) AS run FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY b - a DESC, a) AS k FROM (SELECT video_id, track_id, run, min(frame_no) AS a, max(frame_no) AS b FROM h GROUP BY ALL)),
best AS (SELECT * FROM r JOIN rates USING (video_id) WHERE k = 1 AND (b - a + 1) / fps >= 2),
e AS (SELECT video_id, track_id, a, b, array_to_string(list(bare.frame_no ORDER BY bare.frame_no)[1:5], ',') AS evidence FROM best JOIN bare USING (video_id, track_id) WHERE bare.frame_no BETWEEN a AND b GROUP BY ALL)
SELECT e.video_id, 'no_helmet' AS violation_type, e.track_id, x.timestamp_ms AS start_ms, y.timestamp_ms AS end_ms, 0.8::DOUBLE AS confidence, evidence FROM e
 JOIN tr x ON x.video_id = e.video_id AND x.track_id = e.track_id AND x.frame_no = a JOIN tr y ON y.video_id = e.video_id AND y.track_id = e.track_id AND y.frame_no = b"""
)
SQL["rule_illegal_parking"] = _tracks(
    """, far AS (SELECT video_id, track_id, max(sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) AS far, max(CASE WHEN pos = n // 2 THEN cx END) AS px, max(CASE WHEN pos = n // 2 THEN cy END) AS py
  FROM (SELECT *, avg(cx) OVER w AS mx, avg(cy) OVER w AS my FROM tr WHERE track_class = 'vehicle' WINDOW w AS (PARTITION BY video_id, track_id)) GROUP BY ALL)
SELECT video_id, 'illegal_parking' AS violation_type, track_id, start_ms, end_ms, 0.9::DOUBLE AS confidence, start_frame || ',' || end_frame AS evidence FROM far JOIN ends USING (video_id, track_id)
 WHERE far <= 5 AND end_ms - start_ms >= 60000 AND px > 600 AND px < 700 AND py > 250 AND py < 450"""
)
SQL["rule_illegal_overtaking"] = _tracks(f"{_crossing(350.5)}, e AS (SELECT video_id, track_id, frame_no::VARCHAR AS evidence FROM crossed)" + _OUT.format("illegal_overtaking", "0.7::DOUBLE") + "e JOIN ends USING (video_id, track_id)")
SQL["rule_speeding"] = _tracks(" SELECT video_id, 'speeding' AS violation_type, track_id, start_ms, end_ms, 0.75::DOUBLE AS confidence, start_frame || ',' || end_frame AS evidence FROM speeds JOIN ends USING (video_id, track_id) WHERE kmh > 80")
SQL["track_speeds"] = _tracks(" SELECT video_id, track_id, round(kmh, 3) AS kmh FROM speeds")
# A line is clipped to a box by the range of its parameter between the box's edges.
_CLIP = """CASE WHEN (dx = 0 AND (lx < x1 OR lx > x2)) OR (dy = 0 AND (ly < y1 OR ly > y2)) THEN 0 ELSE sqrt(dx * dx + dy * dy) * greatest(0,
 least(1, CASE WHEN dx <> 0 THEN greatest((x1 - lx) / dx, (x2 - lx) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((y1 - ly) / dy, (y2 - ly) / dy) ELSE 1 END)
 - greatest(0, CASE WHEN dx <> 0 THEN least((x1 - lx) / dx, (x2 - lx) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((y1 - ly) / dy, (y2 - ly) / dy) ELSE 0 END)) END"""
SQL["rule_lane_keeping"] = _tracks(
    f""", pairs AS (SELECT v.video_id, v.track_id, v.pos, v.bbox_x1 AS x1, v.bbox_y1 AS y1, v.bbox_x2 AS x2, v.bbox_y2 AS y2, l.bbox_x1 AS lx, l.bbox_y1 AS ly, l.bbox_x2 - l.bbox_x1 AS dx, l.bbox_y2 - l.bbox_y1 AS dy
  FROM veh v JOIN detections l ON l.video_id = v.video_id AND l.frame_no = v.frame_no AND l.class_name IN ('lane_line_solid', 'lane_line_dashed')
  UNION ALL SELECT video_id, track_id, pos, bbox_x1, bbox_y1, bbox_x2, bbox_y2, 0, 350.5::DOUBLE, 1000, 0 FROM veh),
lay AS (SELECT video_id, track_id, pos, max({_CLIP}) AS on_line FROM pairs GROUP BY ALL),
st AS (SELECT v.*, coalesce(on_line, 0) > 0.15::DOUBLE * least(greatest(1, bbox_x2 - bbox_x1), greatest(1, bbox_y2 - bbox_y1)) AS straddles FROM veh v LEFT JOIN lay USING (video_id, track_id, pos)),
il AS (SELECT *, sum(CASE WHEN straddles THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, track_id ORDER BY pos) AS island FROM st),
r AS (SELECT video_id, track_id, first(frame_no ORDER BY pos) AS a, last(frame_no ORDER BY pos) AS z FROM il WHERE straddles GROUP BY video_id, track_id, island)
SELECT video_id, 'lane_keeping' AS violation_type, track_id, {_MS.format("a")} AS start_ms, {_MS.format("z")} AS end_ms, round(least(0.95, (z - a + 1) / fps / 4), 4) AS confidence, a || ',' || (a + z) // 2 || ',' || z AS evidence
FROM r JOIN rates USING (video_id) WHERE (z - a + 1) / fps >= 2"""
)
SQL["rule_unsafe_following"] = _tracks(
    f""", c AS (SELECT video_id, track_id, floor(avg(cx) / 60) AS bucket, min(frame_no) AS f0, first(id ORDER BY pos) AS id0, kmh, meters_per_px AS mpp FROM veh JOIN speeds USING (video_id, track_id) WHERE n >= 2 GROUP BY ALL),
sh AS (SELECT f.video_id, f.track_id AS ft, l.track_id AS lt, l.bucket AS lb, l.f0 AS lf, l.id0 AS li, a.frame_no AS fr, abs(a.cx - b.cx) AS dx, a.bbox_y2 AS fb, b.bbox_y2 AS bb, greatest(0, a.bbox_y1 - b.bbox_y2) * f.mpp AS gap, greatest(0.5::DOUBLE, f.kmh / 3.6 - l.kmh / 3.6) AS rel, f.kmh
  FROM c f JOIN c l ON f.video_id = l.video_id AND f.track_id <> l.track_id AND abs(f.bucket - l.bucket) <= 1 JOIN veh a ON a.video_id = f.video_id AND a.track_id = f.track_id JOIN veh b ON b.video_id = l.video_id AND b.track_id = l.track_id AND b.frame_no = a.frame_no WHERE f.kmh >= 15),
p AS (SELECT video_id, ft, lt, lb, lf, li, list_sort(list(dx))[count(*) // 2 + 1] AS mdx, list_sort(list(fb))[count(*) // 2 + 1] AS mf, list_sort(list(bb))[count(*) // 2 + 1] AS ml, count(*) AS k, list_sort(list(fr) FILTER (gap / rel < 2 OR gap < 0.5::DOUBLE * kmh)) AS bad FROM sh GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY p.video_id, ft ORDER BY lb, lf, li) AS o FROM p JOIN rates USING (video_id) WHERE k >= 2 AND mdx <= 60 AND mf > ml AND len(bad) > 0 AND (bad[-1] - bad[1] + 1) / fps >= 2)
SELECT video_id, 'unsafe_following' AS violation_type, ft AS track_id, {_MS.format("bad[1]")} AS start_ms, {_MS.format("bad[-1]")} AS end_ms, round(least(0.9, 0.55::DOUBLE + (bad[-1] - bad[1] + 1) / fps / 10), 4) AS confidence, bad[1] || ',' || bad[len(bad) // 2 + 1] || ',' || bad[-1] AS evidence FROM q WHERE o = 1"""
)
SQL["clip_segment_length"] = over(f" SELECT * FROM (SELECT id, round({_CLIP}, 4) AS on_line FROM (SELECT id, bbox_x1 AS x1, bbox_y1 AS y1, bbox_x2 AS x2, bbox_y2 AS y2, 0 AS lx, 350.5::DOUBLE AS ly, 1000 AS dx, 0 AS dy FROM detections)) WHERE on_line > 0", "detections")
SQL["point_in_polygon"] = over(" SELECT video_id, class_name, count(*) AS n FROM detections WHERE (bbox_x1 + bbox_x2) / 2 >= 600 AND (bbox_x1 + bbox_x2) / 2 < 700 AND (bbox_y1 + bbox_y2) / 2 >= 250 AND (bbox_y1 + bbox_y2) / 2 < 450 GROUP BY ALL", "detections")
SQL["bbox_functions"] = over(
    """, box AS MATERIALIZED (SELECT id, video_id, frame_no, class_name, bbox_x1 AS x1, bbox_y1 AS y1, bbox_x2 AS x2, bbox_y2 AS y2, (bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1) AS area
  FROM detections WHERE class_name IN ('motorcycle', 'person', 'helmet')),
bike AS MATERIALIZED (SELECT * FROM box WHERE class_name = 'motorcycle'), other AS MATERIALIZED (SELECT * FROM box WHERE class_name <> 'motorcycle'),
pair AS MATERIALIZED (SELECT a.*, b.id AS o_id, b.area AS oarea, (b.x1 + b.x2) / 2 AS ox, (b.y1 + b.y2) / 2 AS oy,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i FROM bike a JOIN other b ON a.video_id = b.video_id AND a.frame_no = b.frame_no)
SELECT id, o_id, round(CASE WHEN i > 0 THEN i / (area + oarea - i) ELSE 0 END, 6) AS iou, round(area, 3) AS area, ox BETWEEN x1 AND x2 AND oy < (y1 + y2) / 2 AS above,
 ox BETWEEN x1 AND x2 AND oy BETWEEN y1 AND y2 AS inside FROM pair""",
    "detections",
)
SQL["track_geometry"] = _tracks(
    """, m AS (SELECT video_id, track_id, count(*) AS n, avg(cx) AS mx, avg(cy) AS my, first(cx ORDER BY pos) AS ax, first(cy ORDER BY pos) AS ay, last(cx ORDER BY pos) AS zx, last(cy ORDER BY pos) AS zy FROM tr GROUP BY ALL),
d AS (SELECT video_id, track_id, max(sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) AS far FROM tr JOIN m USING (video_id, track_id) GROUP BY ALL),
p AS (SELECT video_id, track_id, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS px FROM seg GROUP BY ALL)
SELECT video_id, track_id, n, round(coalesce(px, 0), 3) AS path_px, round(sqrt((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)), 3) AS moved_px, round(mx, 3) AS mx, round(my, 3) AS my, far <= 5 AS stationary FROM m JOIN d USING (video_id, track_id) LEFT JOIN p USING (video_id, track_id)"""
)

# Aggregations and calendars.
_MOMENT = ", m AS (SELECT v.*, recorded_at + to_seconds(CAST(start_ms / 1000 AS BIGINT)) AS moment FROM violations v JOIN videos ON videos.id = v.video_id WHERE recorded_at IS NOT NULL)"
_V = ("violations", "videos")
SQL["kpis"] = over(" SELECT (SELECT count(*) FROM videos) AS videos, (SELECT count(*) FROM violations) AS violations, round((SELECT count(*) FROM violations) / (SELECT count(*) FROM videos), 4) AS per_video", *_V)
SQL["videos_by_source"] = over(" SELECT coalesce(source_type, 'other') AS source, count(*) AS n FROM videos GROUP BY 1", "videos")
SQL["violations_by_type"] = over(" SELECT violation_type, count(*) AS n FROM violations GROUP BY 1", "violations")
SQL["violations_by_review_status"] = over(" SELECT review_status, count(*) AS n FROM violations GROUP BY 1", "violations")
SQL["violations_by_hour"] = over(f"{_MOMENT} SELECT hour(moment) AS hour, count(*) AS n FROM m GROUP BY 1", *_V)
SQL["violations_by_weekday"] = over(f"{_MOMENT} SELECT (dayofweek(moment) + 6) % 7 AS weekday, count(*) AS n FROM m GROUP BY 1", *_V)
SQL["violations_heatmap"] = over(f"{_MOMENT} SELECT w.w AS weekday, h.h AS hour, count(m.id) AS n FROM range(7) w(w) CROSS JOIN range(24) h(h) LEFT JOIN m ON (dayofweek(moment) + 6) % 7 = w AND hour(moment) = h GROUP BY ALL", *_V)
SQL["violations_over_time"] = over(f"{_MOMENT} SELECT strftime(moment, '%Y-%m-%d') AS day, count(*) AS n FROM m GROUP BY 1", *_V)
SQL["violations_without_time"] = over(" SELECT count(*) AS n FROM violations WHERE video_id IN (SELECT id FROM videos WHERE recorded_at IS NULL)", *_V)
SQL["library_totals"] = over(" SELECT count(*) AS videos, coalesce(sum(duration_sec), 0) AS duration_sec FROM videos", "videos")
SQL["study_build"] = over(
    f"{_MOMENT} SELECT 'by_type' AS part, violation_type AS key, count(*) AS n FROM violations GROUP BY 2 UNION ALL SELECT 'by_hour', hour(moment)::VARCHAR, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'by_weekday', ((dayofweek(moment) + 6) % 7)::VARCHAR, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'by_status', review_status, count(*) FROM violations GROUP BY 2", *_V
)

# Listings.
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VIOLATION_NAMES.items())
SQL["list_videos"] = over(" SELECT id, filename, source_type, duration_sec, status, codec FROM videos WHERE contains(lower(filename), 'clip_1') ORDER BY imported_at DESC, id DESC LIMIT 25", "videos")
SQL["video_details"] = over(" SELECT id, filename, filepath, source_type, duration_sec, width, height, codec, status FROM videos", "videos")
SQL["videos_by_status"] = over(" SELECT id FROM videos WHERE status IN ('imported', 'prelabeled')", "videos")
SQL["detections_of_video"] = over(" SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_no, id) AS place, id, frame_no, class_name, track_id, round(confidence, 4) AS confidence FROM detections", "detections")
SQL["list_violations"] = over(f" SELECT v.id, filename, violation_type, CASE violation_type {_NAMES} ELSE violation_type END AS type_name, start_ms, license_plate, review_status FROM violations v JOIN videos ON videos.id = v.video_id WHERE violation_type = 'speeding' ORDER BY v.id DESC LIMIT 100", *_V)
SQL["list_violations_editable"] = over(" SELECT v.id, video_id, coalesce(filename, '—') AS filename, violation_type, start_ms, end_ms, coalesce(license_plate, '') AS license_plate, coalesce(source, 'auto') AS source, coalesce(v.notes, '') AS notes, review_status FROM violations v LEFT JOIN videos w ON w.id = v.video_id ORDER BY v.id DESC LIMIT 500", *_V)
SQL["violation_for_edit"] = over(" SELECT id, video_id, violation_type, start_ms, end_ms, license_plate, notes, review_status FROM violations", "violations")
SQL["count_violations"] = over(" SELECT count(*) AS n FROM violations WHERE violation_type = 'lane_keeping' AND review_status = 'confirmed'", "violations")
SQL["violation_evidence"] = over(" SELECT v.id, filepath, (u.p - 1)::INTEGER AS pos, v.f[u.p] AS frame_no FROM (SELECT *, [id % 40, id % 40 + 3, id % 40 + 9] AS f FROM violations WHERE id % 11 <> 0) v CROSS JOIN (SELECT unnest([1, 2, 3]) AS p) u JOIN videos ON videos.id = v.video_id", *_V)
SQL["evidence_decode"] = over(" SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE replace(replace(evidence_frames, '[', ''), ']', '') END AS frames FROM violations", "violations")
SQL["fps_or_default"] = over(" SELECT id, CASE WHEN id % 8 = 0 OR fps IS NULL OR fps = 0 THEN 30 ELSE fps END AS fps FROM videos", "videos")
SQL["video_summaries"] = over(" SELECT id, filename, (SELECT count(*) FROM detections d WHERE d.video_id = v.id) AS n_detections, (SELECT count(*) FROM violations x WHERE x.video_id = v.id) AS n_violations FROM videos v", *_V, "detections")

# Sources.
SQL["analysis_summary"] = over(" SELECT video_id, count(*) AS n_detections, count(DISTINCT frame_no) AS n_frames FROM detections GROUP BY 1", "detections")
SQL["import_classify"] = over(
    """, f AS (SELECT '/in/' || id || '.mp4' AS path, file_hash AS hash, id % 31 = 0 AS failed FROM hashes), k AS (SELECT '/in/' || CASE WHEN id % 2 = 0 THEN id ELSE -id END || '.mp4' AS path, file_hash AS hash FROM hashes WHERE id % 17 = 0)
SELECT CASE WHEN failed THEN 'failed' WHEN path IN (SELECT path FROM k) THEN 'skipped' WHEN hash IN (SELECT hash FROM k) OR EXISTS (SELECT 1 FROM f g WHERE g.hash = f.hash AND g.path < f.path) THEN 'duplicate' ELSE 'imported' END AS outcome, count(*) AS n FROM f GROUP BY 1""",
    "hashes",
)
SQL["probe_to_metadata"] = over(
    " SELECT filepath AS path, CASE WHEN g THEN duration_sec END AS duration_sec, CASE WHEN g THEN 1280 END AS width, CASE WHEN g THEN 720 END AS height, CASE WHEN g THEN 'h264' END AS codec, CASE WHEN g THEN CASE WHEN id % 3 = 0 THEN 25 ELSE id / 2 END END AS fps, CASE WHEN g THEN round(id::DOUBLE * 1000003 / 1048576, 2) END AS file_size_mb, CASE WHEN g THEN '2024-03-01 08:00' END AS recorded FROM (SELECT *, id % 8 <> 0 AS g FROM videos)",
    "videos",
)
_CLASS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in DETECTION_CLASSES.items())
SQL["detections_from_frames"] = over(
    f""" SELECT video_id, CAST(frame_no * 3 AS INT) AS frame_no, CAST(floor(1000 * (frame_no * 3) / CASE WHEN fps <> 0 THEN fps ELSE 30 END) AS INT) AS timestamp_ms,
 CASE d.id % 15 {_CLASS} ELSE (d.id % 15)::VARCHAR END AS class_name, track_id, round(confidence, 4) AS confidence,
 round(bbox_x1, 3) AS x1, round(bbox_y1, 3) AS y1, round(bbox_x2, 3) AS x2, round(bbox_y2, 3) AS y2 FROM detections d JOIN videos v ON v.id = video_id""",
    "detections",
    "videos",
)
SQL["analyze_batch"] = over(" SELECT video_id, count(*) AS n FROM detections WHERE video_id NOT IN (SELECT video_id FROM detections WHERE video_id % 9 = 0 AND frame_no = 2 GROUP BY 1 HAVING count(*) > 1) GROUP BY 1", "detections")
SQL["detections_replace"] = over(" SELECT video_id, id, frame_no, class_name FROM detections WHERE video_id % 3 <> 0 OR (frame_no < 5 AND video_id % 2 = 0)", "detections")
SQL["detections_replaced"] = over(
    """ SELECT v.id AS video_id, CASE WHEN v.id % 3 = 0 THEN 'prelabeled' ELSE status END AS status, d.id, frame_no, class_name, round(bbox_x1, 3) AS x1
 FROM videos v LEFT JOIN (SELECT * FROM detections WHERE video_id % 3 <> 0 OR (frame_no < 5 AND video_id % 2 = 0)) d ON d.video_id = v.id""",
    "detections",
    "videos",
)
SQL["videos_insert"] = over(" SELECT '/media/clip_' || id || '.mp4' AS filepath, 'clip_' || id || '.mp4' AS filename, 'imported' AS status, true AS has_id FROM hashes WHERE '/media/clip_' || id || '.mp4' NOT IN (SELECT filepath FROM videos)", "videos", "hashes")
_MESSY = ", z AS (SELECT *, id % 5 AS k, CASE WHEN id % 7 = 0 THEN 'island' ELSE zone_type END AS t FROM zones), p AS (SELECT *, CASE k WHEN 0 THEN '1.0,2.0;5.0,6.0' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '1.0,2.0' ELSE CASE zone_type WHEN 'stop_line' THEN '0.0,250.5;1000.0,250.5' WHEN 'lane_line_solid' THEN '0.0,350.5;1000.0,350.5' ELSE '600.0,250.0;700.0,250.0;700.0,450.0;600.0,450.0' END END AS points FROM z)"
SQL["zones_parse"] = over(f"{_MESSY} SELECT id, points FROM p", "zones")
SQL["zones_validate"] = over(f"{_MESSY}, q AS (SELECT *, CASE WHEN points = '' THEN 0 ELSE len(string_split(points, ';')) END AS c FROM p) SELECT CASE WHEN t = 'island' THEN 'unknown type' WHEN c < CASE WHEN t = 'no_parking' THEN 3 ELSE 2 END THEN 'too few points' ELSE 'good' END AS reason, count(*) AS n FROM q GROUP BY 1", "zones")
SQL["zones_upsert"] = over(" SELECT zone_type, count(*) AS n FROM zones WHERE video_id % 3 <> 0 OR zone_type = 'stop_line' GROUP BY 1", "zones")
SQL["calibration_compute"] = over(
    """ SELECT id AS video_id, CASE WHEN reason IS NULL THEN round((5.0::DOUBLE / (id % 50) + 0.2) / 2, 6) END AS meters_per_px, reason FROM
 (SELECT id, CASE WHEN id % 7 = 0 THEN 'needs a distance for each pair' WHEN id % 11 = 0 THEN 'distances must be positive' WHEN id % 50 = 0 THEN 'points coincide' END AS reason FROM videos)""",
    "videos",
)
SQL["calibration_upsert"] = over(" SELECT video_id, meters_per_px FROM calibrations", "calibrations")
SQL["constraint_breaks"] = over(
    """, a AS (SELECT id, filepath, source_type FROM videos UNION ALL SELECT id + 1000000, CASE WHEN id % 20 = 0 THEN filepath ELSE filepath || 'x' END, CASE WHEN id % 3 = 0 THEN 'film' ELSE source_type END FROM videos WHERE id % 10 = 0)
SELECT id, CASE WHEN source_type NOT IN ('dashcam', 'cctv', 'social', 'other') THEN 'unknown source_type' ELSE 'repeated filepath' END AS reason FROM a WHERE source_type NOT IN ('dashcam', 'cctv', 'social', 'other') OR filepath IN (SELECT filepath FROM a GROUP BY 1 HAVING count(*) > 1)""",
    "videos",
)

# Lamps by the video: two bright ones, or a large one, glare; a small one, coloured ones, and day do not. The box leaves the picture of 460 rows.
SQL["rule_high_beam_misuse"] = over(
    """, g AS (SELECT video_id, min(frame_no) AS a, max(frame_no) AS z, list_sort(list(frame_no))[1:5] AS f, CASE WHEN any_value(fps) <> 0 THEN any_value(fps) ELSE 30 END AS fps FROM detections JOIN (SELECT id, fps FROM videos) v ON v.id = video_id
  WHERE track_id = 1 AND video_id % 4 = 0 AND (video_id // 4) % 4 IN (0, 3) AND frame_no % 5 = 0 AND floor(bbox_y1) + 48 <= 460 GROUP BY 1)
SELECT video_id, 'high_beam_misuse' AS violation_type, 1 AS track_id, CAST(floor(a * 1000 / fps) AS INT) AS start_ms, CAST(floor(z * 1000 / fps) AS INT) AS end_ms, round(least(0.75, 0.55::DOUBLE + (z - a + 1) / fps / 20), 4) AS confidence, array_to_string(f, ',') AS evidence FROM g WHERE (z - a + 1) / fps >= 2""",
    "detections",
    "videos",
)

# Rules together, readiness.
_RULES = [k for k in SQL if k.startswith("rule_")]
SQL["run_rules"] = " UNION ALL BY NAME ".join(f"SELECT * FROM ({SQL[k]})" for k in _RULES)
SQL["run_rules_isolated"] = (
    "SELECT rule, 'ok' AS status, NULL::VARCHAR AS condition, n AS violations, CASE WHEN n > 0 THEN videos END AS videos, starts FROM ("
    + " UNION ALL ".join(f"SELECT '{k[5:]}' AS rule, count(*) AS n, count(DISTINCT video_id) AS videos, CAST(sum(start_ms) AS BIGINT) AS starts FROM ({SQL[k]})" for k in _RULES)
    + ") UNION ALL SELECT 'no_such_column', 'failed', 'UNRESOLVED_COLUMN.WITH_SUGGESTION', 0, NULL, NULL UNION ALL SELECT 'failing_rows', 'failed', 'USER_RAISED_EXCEPTION', 0, NULL, NULL"
)
SQL["rule_gating"] = " UNION ALL BY NAME ".join(f"SELECT * FROM ({SQL[k]})" for k in ("rule_speeding", "rule_unsafe_following", "rule_high_beam_misuse"))
_READY = """, i AS (SELECT id FROM videos UNION ALL SELECT id + 100000 FROM videos),
r AS (SELECT id, id IN (SELECT video_id FROM detections) AS has_detections, id IN (SELECT video_id FROM detections WHERE track_id IS NOT NULL) AS has_tracks, id IN (SELECT video_id FROM calibrations) AS has_calibration, id IN (SELECT id FROM videos WHERE width IS NOT NULL) AS has_video_file,
 CASE WHEN id <= 100000 THEN 'lane_line_solid,no_parking,stop_line' ELSE '' END AS zone_types FROM i)"""
SQL["readiness"] = over(f"{_READY} SELECT * FROM r", "videos", "detections", "calibrations")
SQL["detectors_blocked"] = over(
    _READY
    + """, n AS (SELECT * FROM (VALUES ('red_light_running', 'tracks'), ('red_light_running', 'stop_line'), ('wrong_direction', 'tracks'), ('no_helmet', 'tracks'), ('illegal_parking', 'tracks'), ('illegal_parking', 'no_parking'), ('illegal_overtaking', 'tracks'), ('illegal_overtaking', 'lane_line_solid'), ('lane_keeping', 'tracks'), ('speeding', 'tracks'), ('speeding', 'calibration'), ('unsafe_following', 'tracks'), ('unsafe_following', 'calibration'), ('high_beam_misuse', 'tracks'), ('high_beam_misuse', 'video_file')) t(rule, need)),
b AS (SELECT id, rule, string_agg(need, ',' ORDER BY need) AS missing FROM r, n WHERE NOT CASE need WHEN 'tracks' THEN has_tracks WHEN 'calibration' THEN has_calibration WHEN 'video_file' THEN has_video_file ELSE contains(zone_types, need) END GROUP BY ALL)
SELECT rule, missing, count(*) AS n FROM b GROUP BY ALL""",
    "videos",
    "detections",
    "calibrations",
)

# Texts, hashes, plates, duplicates.
SQL["phash_distance"] = over(
    " SELECT a.id, CASE WHEN regexp_full_match(a.phash, '[0-9a-f]{64}') AND regexp_full_match(b.phash, '[0-9a-f]{64}') THEN CAST(list_sum([bit_count(xor(('0x' || a.phash[i:i+7])::UBIGINT, ('0x' || b.phash[i:i+7])::UBIGINT))::BIGINT for i in range(1, 65, 8)]) AS BIGINT) END AS bits FROM hashes a JOIN hashes b ON b.id = a.id + 1", "hashes"
)
_CELLNAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VIOLATION_NAMES.items() if k != "speeding")
SQL["cells_names_moments"] = over(f" SELECT id, CASE WHEN notes LIKE '=%' THEN '''' || notes ELSE notes END AS notes, CASE violation_type {_CELLNAMES} ELSE violation_type END AS name, strftime(created_at + to_seconds(CAST(start_ms / 1000 AS BIGINT)), '%Y-%m-%d %H:%M') AS moment FROM violations", "violations")
_EXACT = "SELECT b.representative, a.id AS duplicate FROM hashes a JOIN (SELECT file_hash, min(id) AS representative FROM hashes GROUP BY 1) b USING (file_hash) WHERE a.id > b.representative"
SQL["exact_duplicates"] = over(f" {_EXACT}", "hashes")
_PLATE = "trim(regexp_replace(regexp_replace(translate(upper(raw_text), '٠١٢٣٤٥٦٧٨٩أ', '0123456789ا'), '[^0-9A-Z ابحدرسصطعقكلمنهوي]', '', 'g'), ' +', ' ', 'g'))"
SQL["plate_texts"] = over(
    f" SELECT DISTINCT read_id, video_id, trim(translate(raw_text, '٠١٢٣٤٥٦٧٨٩أ', '0123456789ا')) AS arabic, {_PLATE} AS plate, length(regexp_replace({_PLATE}, '[^0-9]', '', 'g')) BETWEEN 3 AND 4 AND length(regexp_replace({_PLATE}, '[0-9 ]', '', 'g')) BETWEEN 2 AND 4 AS looks FROM plate_reads", "plate_reads"
)
_VOTE = f""", g AS (SELECT video_id, track_id, text, count(*) AS n, avg(confidence) AS c FROM (SELECT *, {_PLATE} AS text FROM {{}}) WHERE text <> '' AND confidence >= 0.3::DOUBLE GROUP BY ALL),
won AS (SELECT video_id, track_id, text, c AS confidence, n AS reads FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY n DESC, c DESC, text) AS k FROM g) WHERE k = 1)"""
_BEST = ", best AS (SELECT video_id, track_id, image, raw_text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id, image ORDER BY confidence DESC, raw_text) AS k FROM plate_reads) WHERE k = 1)"
# Means are equal in whatever order their rows are summed: decimals, of a double's shortest digits.
_EXACT = _VOTE.replace("avg(confidence) AS c", "sum(CAST(CAST(confidence AS VARCHAR) AS DECIMAL(38,18))) AS s, s::DOUBLE / n AS c").replace("n DESC, c DESC", "n DESC, s DESC")
SQL["plate_vote"] = over(f"{_EXACT.format('plate_reads')} SELECT video_id, track_id, text, round(confidence, 6) AS confidence, reads FROM won", "plate_reads")
SQL["best_reading"] = over(f"{_BEST} SELECT * FROM best", "plate_reads")
SQL["plate_for_image_set"] = over(f"{_BEST}{_EXACT.format('best')} SELECT video_id, track_id, text, round(confidence, 6) AS confidence, reads FROM won", "plate_reads")
SQL["plate_for_violation"] = over(f"{_VOTE.format('plate_reads')} SELECT id, coalesce(CASE WHEN w.confidence > 0 THEN text END, license_plate) AS license_plate, round(coalesce(CASE WHEN w.confidence > 0 THEN w.confidence END, plate_conf), 6) AS plate_conf FROM violations LEFT JOIN won w USING (video_id, track_id)", "plate_reads", "violations")
_AUTO = " UNION ALL ".join(f"SELECT video_id, violation_type, track_id, start_ms, end_ms FROM ({SQL[k]})" for k in _RULES)
SQL["extract_violations"] = (
    over(f"{_EXACT.format('plate_reads')}, auto AS (SELECT * FROM ({_AUTO})), ", "violations", "detections", "videos", "plate_reads")
    + """seen AS (SELECT DISTINCT video_id FROM detections),
all_rows AS (SELECT coalesce(source, 'auto') AS source, violation_type, license_plate, video_id, track_id, start_ms, end_ms FROM violations
  WHERE coalesce(source, 'auto') <> 'auto' OR video_id NOT IN (SELECT video_id FROM seen)
 UNION ALL SELECT 'auto', violation_type, CASE WHEN w.confidence > 0 THEN text END, a.video_id, a.track_id, a.start_ms, a.end_ms
  FROM auto a LEFT JOIN won w USING (video_id, track_id) WHERE a.video_id IN (SELECT video_id FROM seen))
SELECT video_id, source, violation_type, track_id, start_ms, end_ms, license_plate,
 CASE WHEN v.id IN (SELECT video_id FROM seen) THEN 'analyzed' ELSE v.status END AS status FROM all_rows r LEFT JOIN videos v ON v.id = r.video_id"""
)
# Detections that come in batches end with the same rows.
SQL["incremental_extraction"] = SQL["extract_violations"]
SQL["plates_for_track"] = _tracks(
    """, p AS (SELECT v.video_id, v.track_id, v.frame_no, min(d.id) AS box_id FROM veh v JOIN detections d ON d.video_id = v.video_id AND d.frame_no = v.frame_no AND d.class_name = 'license_plate'
  WHERE (d.bbox_x1 + d.bbox_x2) / 2 BETWEEN v.bbox_x1 AND v.bbox_x2 AND (d.bbox_y1 + d.bbox_y2) / 2 BETWEEN v.bbox_y1 AND v.bbox_y2 GROUP BY ALL)
SELECT video_id, track_id, frame_no, box_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_no) AS k FROM p) WHERE k <= 5"""
)

# Label data sets.
_DIM = ", dim AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in DETECTION_CLASSES.items()) + ") t(class_id, class_name)), st AS (SELECT class_id, class_name, count(stem) AS instances, count(DISTINCT stem) AS images FROM dim LEFT JOIN (SELECT stem, try_cast(string_split(line, ' ')[1] AS INT) AS c FROM label_lines) ON c = class_id GROUP BY ALL)"
SQL["class_stats"] = over(f"{_DIM} SELECT * FROM st", "label_lines")
SQL["split_dataset"] = over(", n AS (SELECT count(DISTINCT stem) AS n FROM label_lines) SELECT 'train' AS split, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS n FROM n UNION ALL SELECT 'val', CAST(floor(n * 0.2::DOUBLE) AS BIGINT) FROM n UNION ALL SELECT 'test', n - CAST(floor(n * 0.7::DOUBLE) AS BIGINT) - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) FROM n", "label_lines")
SQL["dataset_validate"] = over(
    f"""{_DIM}, n AS (SELECT count(DISTINCT stem) AS n FROM label_lines), parts AS (SELECT n, floor(n * 0.97::DOUBLE) AS train, floor(n * 0.02::DOUBLE) AS val FROM n)
SELECT 'few instances' AS issue, class_name AS subject FROM st WHERE instances < 100
UNION ALL SELECT 'empty split', 'train' FROM parts WHERE train = 0 UNION ALL SELECT 'empty split', 'val' FROM parts WHERE val = 0
UNION ALL SELECT 'small split', 'val' FROM parts WHERE n > 0 AND val / n < 0.05""",
    "label_lines",
)
SQL["dataset_manifest"] = over(" SELECT DISTINCT stem, stem || '.jpg' AS image, split FROM label_lines", "label_lines")
_WEAK = _DIM + ", weak AS (SELECT m.class_name, m.class_id, map50, coalesce(instances, 0) AS instances, precision AS p, recall AS r FROM eval_metrics m LEFT JOIN st USING (class_id) WHERE map50 < 0.5)"
SQL["weak_classes"] = over(
    f"{_WEAK} SELECT class_name, class_id, map50, instances, CASE WHEN x = '' THEN 'general' ELSE x END AS reasons FROM (SELECT *, concat_ws(';', CASE WHEN instances < 100 THEN 'few instances' END, CASE WHEN p < r - 0.1::DOUBLE THEN 'false alarms' END, CASE WHEN r < p - 0.1::DOUBLE THEN 'missed objects' END, CASE WHEN map50 < 0.25 THEN 'very weak' END) AS x FROM weak)", "label_lines", "eval_metrics"
)
SQL["augment_advice"] = over(f"{_WEAK} SELECT CASE WHEN bool_or(instances < 100) THEN 0.3::DOUBLE END AS copy_paste, CASE WHEN bool_or(instances < 100) THEN 0.15::DOUBLE END AS mixup, CASE WHEN bool_or(map50 < 0.3::DOUBLE) THEN 1.0::DOUBLE END AS mosaic, CASE WHEN bool_or(map50 < 0.3::DOUBLE) THEN 0.8::DOUBLE END AS hsv_s FROM weak", "label_lines", "eval_metrics")
SQL["error_report"] = over(" SELECT 0.5::DOUBLE AS threshold, round(avg(map50), 6) AS map50, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, count(*) FILTER (map50 < 0.5) AS n_weak, avg(map50) >= 0.5 AS passes_threshold FROM eval_metrics", "eval_metrics")
SQL["loss_series"] = over(" SELECT epoch, 'box_loss' AS loss, box_loss AS value FROM training_log WHERE box_loss IS NOT NULL UNION ALL SELECT epoch, 'cls_loss', cls_loss FROM training_log WHERE cls_loss IS NOT NULL UNION ALL SELECT epoch, 'dfl_loss', dfl_loss FROM training_log WHERE dfl_loss IS NOT NULL", "training_log")
SQL["label_export_xml"] = over(
    " SELECT filename, frame_no AS _id, count(*) AS n, first(class_name || '|' || printf('%.2f', bbox_x1) || '|' || printf('%.2f', bbox_y2) ORDER BY d.id) AS first FROM detections d JOIN videos v ON v.id = d.video_id WHERE width IS NOT NULL AND height IS NOT NULL GROUP BY ALL", "detections", "videos"
)

# Changes and exports.
SQL["export_rows"] = over(
    f" SELECT v.id, filename, violation_type, CASE violation_type {_NAMES} END AS type_name, start_ms / 1000 AS start_sec, end_ms / 1000 AS end_sec, confidence, review_status, source_type, true AS anonymized, {_PSEUDONYM} AS license_plate FROM violations v JOIN videos ON videos.id = v.video_id", *_V
)
SQL["apply_review"] = over(", r AS (SELECT violation_id, review_status AS new FROM (SELECT *, row_number() OVER (PARTITION BY violation_id ORDER BY changed_at DESC, change_id DESC) AS k FROM changes WHERE op = 'review') WHERE k = 1) SELECT id, coalesce(new, review_status) AS review_status FROM violations LEFT JOIN r ON violation_id = id", "violations", "changes")
_VALID = ", ok AS (SELECT c.*, CASE WHEN d IS NULL THEN 'unknown video' WHEN end_ms <= start_ms THEN 'empty interval' WHEN end_ms > d * 1000 THEN 'beyond the video' WHEN length(license_plate) > 12 THEN 'plate too long' END AS reason FROM changes c LEFT JOIN (SELECT id AS v, duration_sec AS d FROM videos) ON v = video_id WHERE op IN ('I', 'U'))"
SQL["validate_manual"] = over(f"{_VALID} SELECT change_id, reason FROM ok", "changes", "videos")
SQL["apply_manual_insert"] = over(f"{_VALID} SELECT video_id, violation_type, start_ms, end_ms, 1.0::DOUBLE AS confidence, license_plate, 'confirmed' AS review_status, 'manual' AS source, '[manual] ' || notes AS notes, actor AS manual_user FROM ok WHERE reason IS NULL AND op = 'I'", "changes", "videos")
SQL["apply_manual_edit"] = over(
    f"{_VALID}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY violation_id ORDER BY changed_at DESC, change_id DESC) AS k FROM ok WHERE reason IS NULL AND op = 'U') WHERE k = 1) SELECT v.id, coalesce(e.violation_type, v.violation_type) AS violation_type, coalesce(e.start_ms, v.start_ms) AS start_ms, coalesce(e.end_ms, v.end_ms) AS end_ms, CASE WHEN e.change_id IS NULL THEN v.license_plate ELSE e.license_plate END AS license_plate, CASE WHEN e.change_id IS NULL THEN v.source ELSE 'manual' END AS source FROM violations v LEFT JOIN e ON e.violation_id = v.id",
    "changes", "videos", "violations",
)
SQL["apply_delete"] = over(" SELECT id, violation_type FROM violations WHERE id NOT IN (SELECT violation_id FROM changes WHERE op = 'D')", "violations", "changes")
SQL["audit_append"] = over(" SELECT 'violation' AS entity, violation_id AS entity_id, CASE op WHEN 'review' THEN 'review' WHEN 'D' THEN 'delete' WHEN 'U' THEN 'edit' ELSE 'insert' END AS action, CASE WHEN op = 'review' THEN v.review_status END AS old_value, CASE WHEN op = 'review' THEN c.review_status END AS new_value, actor FROM changes c JOIN violations v ON v.id = violation_id", "violations", "changes")
SQL["video_changes"] = over(
    ", c AS (SELECT video_id, max_by(changed_at, (changed_at, change_id)) FILTER (change_id % 2 = 0) AS r, CASE WHEN bool_or(change_id % 3 = 0) THEN 'cctv' END AS s FROM changes WHERE op = 'U' GROUP BY 1) SELECT id, coalesce(s, source_type) AS source_type, CASE WHEN c.video_id IS NULL THEN status ELSE 'reviewed' END AS status, strftime(coalesce(r, recorded_at), '%Y-%m-%d %H:%M') AS recorded FROM videos LEFT JOIN c ON c.video_id = id", "videos", "changes"
)
SQL["delete_videos_cascade"] = over(
    " SELECT 'videos' AS part, CAST(id AS BIGINT) AS key FROM videos WHERE id % 4 <> 1"
    + "".join(f" UNION ALL SELECT '{t}', {k} FROM {t} WHERE video_id NOT IN (SELECT id FROM videos WHERE id % 4 = 1)" for t, k in (("detections", "id"), ("violations", "id"), ("zones", "id"), ("calibrations", "video_id"))),
    "videos",
    "detections",
    "violations",
    "zones",
    "calibrations",
)

# Sampling, hashes and codecs that follow from how the derived tables are made.
SQL["stride_sample"] = over(
    """, p AS (SELECT DISTINCT video_id, class_name, frame_no FROM detections),
g(video_id, class_name, frame_no) AS (SELECT video_id, class_name, min(frame_no) FROM p GROUP BY ALL
 UNION ALL SELECT g.video_id, g.class_name, min(p.frame_no) FROM g JOIN p ON p.video_id = g.video_id AND p.class_name = g.class_name AND p.frame_no >= g.frame_no + 5 GROUP BY g.video_id, g.class_name, g.frame_no)
SELECT video_id, class_name, frame_no FROM g""",
    "detections",
).replace("WITH ", "WITH RECURSIVE ", 1)
_PAIRS = (
    """, h AS (SELECT id, phash, [('0x' || phash[i:i+7])::UBIGINT for i in range(1, 65, 8)] AS w FROM hashes WHERE regexp_full_match(phash, '[0-9a-f]{64}')),
near AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id < b.id WHERE """
    + " + ".join(f"bit_count(xor(a.w[{i}], b.w[{i}]))::INT" for i in range(1, 9))
    + " <= 10)"
)
SQL["near_duplicate_pairs"] = over(f"{_PAIRS} SELECT a, b FROM near", "hashes")
# One representative a step: the smallest free id takes its free neighbours.
_GREEDY = f"""{_PAIRS}, exact AS ({_EXACT}), twin AS (SELECT representative AS id FROM exact UNION SELECT duplicate FROM exact),
pairs AS (SELECT a, b FROM near WHERE a NOT IN (SELECT id FROM twin) AND b NOT IN (SELECT id FROM twin)),
beside AS (SELECT a, list(b ORDER BY b) AS bs FROM pairs GROUP BY a),
g(representative, taken, free) AS (
 SELECT NULL::INTEGER, []::INTEGER[], (SELECT list(DISTINCT x ORDER BY x) FROM (SELECT a AS x FROM pairs UNION ALL SELECT b FROM pairs))
 UNION ALL
 SELECT g.free[1], list_filter(coalesce(bs, []), lambda x: list_contains(g.free, x)), list_filter(g.free[2:], lambda x: NOT list_contains(coalesce(bs, []), x)) FROM g LEFT JOIN beside ON beside.a = g.free[1] WHERE len(g.free) > 0),
groups AS (SELECT representative, unnest(taken) AS duplicate FROM g WHERE representative IS NOT NULL)"""
for _name, _query in {
    "near_duplicates": "SELECT representative, duplicate FROM groups",
    "duplicate_groups": "SELECT representative, duplicate, 'exact' AS match_type FROM exact UNION ALL SELECT representative, duplicate, 'perceptual' FROM groups",
}.items():
    SQL[_name] = over(f"{_GREEDY} {_query}", "hashes").replace("WITH ", "WITH RECURSIVE ", 1)
SQL["json_codecs"] = over(""" SELECT video_id, frame_no, '[' || string_agg('{"id":' || id || ',"class_name":"' || class_name || '","confidence":' || round(confidence, 4) || '}', ',' ORDER BY id) || ']' AS json FROM detections GROUP BY ALL""", "detections")
SQL["pseudonymize_plate"] = over(f" SELECT {_PSEUDONYM} AS pseudonym, count(*) AS n FROM violations GROUP BY 1", "violations")

# Files that queries write from the tables and read back.
_MEDIA = """, f AS (SELECT 'clip_' || id || '.mp4' AS name, repeat('video ' || (id % 40) || chr(10), 50) AS content FROM videos WHERE id % 3 <> 0),
d AS (SELECT *, length(content) AS size FROM f)"""
SQL["src_video_files"] = over(f"{_MEDIA} SELECT name, size FROM d", "videos")
SQL["file_fingerprints"] = over(
    f"{_MEDIA} SELECT name, sha256(unhex(printf('%02x%02x', size % 256, size // 256) || '000000000000') || encode(content)) AS partial, CASE WHEN count(*) OVER (PARTITION BY content) > 1 THEN sha256(content) END AS full, NULL::VARCHAR AS error FROM d", "videos"
)
SQL["labels_read"] = over(" SELECT 'clip_' || video_id AS stem, 'clip_' || video_id || '.jpg' AS image, count(*) AS n, CAST(sum(d.id % 13) AS BIGINT) AS classes FROM detections d JOIN videos v ON v.id = video_id WHERE width IS NOT NULL GROUP BY video_id", "detections", "videos")
SQL["training_log_read"] = over(" SELECT epoch, box_loss, cls_loss FROM training_log", "training_log")
SQL["zone_changes"] = over(
    " SELECT zone_type, count(*) AS n, count(*) AS ids, count(DISTINCT video_id) AS videos FROM (SELECT zone_type, video_id FROM zones WHERE zone_type <> 'stop_line' UNION ALL SELECT 'lane_line_dashed', id FROM videos WHERE id % 5 <> 0) GROUP BY 1", "zones", "videos"
)
SQL["estimate_speed"] = _tracks(
    """ SELECT video_id, track_id, round(CASE WHEN ms > 0 THEN px * meters_per_px / (ms / 1000.0) * 3.6 ELSE 0 END, 3) AS kmh FROM
 (SELECT video_id, track_id, sqrt((last(cx ORDER BY pos) - first(cx ORDER BY pos)) ** 2 + (last(cy ORDER BY pos) - first(cy ORDER BY pos)) ** 2) AS px, last(timestamp_ms ORDER BY pos) - first(timestamp_ms ORDER BY pos) AS ms FROM veh WHERE n > 1 GROUP BY ALL) JOIN calibrations USING (video_id)"""
)
_ADVICE = ", ".join(f"('{reason}', {k}, '{tip}')" for reason, tips in ADVICE.items() for k, tip in enumerate(tips))
SQL["augment_tips"] = (
    "WITH w AS (" + SQL["weak_classes"] + f"), a AS (SELECT * FROM (VALUES {_ADVICE}) t(reason, pos, tip)) SELECT class_name, reason, pos::INT AS pos, tip FROM w JOIN a ON contains(';' || reasons || ';', ';' || reason || ';')"
)
SQL["dataset_prepare"] = over(
    f"""{_DIM}, n AS (SELECT count(DISTINCT stem) AS n FROM label_lines), parts AS (SELECT CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS b, n FROM n)
SELECT 'split' AS part, 'train' AS key, a AS n FROM parts UNION ALL SELECT 'split', 'val', b FROM parts UNION ALL SELECT 'split', 'test', n - a - b FROM parts UNION ALL SELECT 'manifest', 'images', n FROM parts
UNION ALL SELECT 'stats', class_name, instances FROM st UNION ALL SELECT 'issues', 'few instances', 1 FROM st WHERE instances < 100""",
    "label_lines",
)
_LISTED = "'[' || string_agg('{\"' || k || '\":' || v || ',\"n\":' || n || '}', ',' ORDER BY o) || ']'"
SQL["study_document"] = over(
    f"""{_MOMENT}, u AS (SELECT 'by_type' AS part, 'violation_type' AS k, '\"' || violation_type || '\"' AS v, violation_type AS o, count(*) AS n FROM violations GROUP BY ALL UNION ALL SELECT 'by_status', 'review_status', '\"' || review_status || '\"', review_status, count(*) FROM violations GROUP BY ALL
 UNION ALL SELECT 'by_hour', 'hour', hour(moment)::VARCHAR, lpad(hour(moment)::VARCHAR, 2, '0'), count(*) FROM m GROUP BY ALL UNION ALL SELECT 'by_weekday', 'weekday', ((dayofweek(moment) + 6) % 7)::VARCHAR, ((dayofweek(moment) + 6) % 7)::VARCHAR, count(*) FROM m GROUP BY ALL)
SELECT part, {_LISTED} AS rows FROM u GROUP BY part UNION ALL SELECT 'kpis', '[{{"videos":' || a || ',"violations":' || b || ',"per_video":' || (b / a)::DOUBLE || '}}]' FROM (SELECT (SELECT count(*) FROM videos) AS a, (SELECT count(*) FROM violations) AS b)""".replace('\\"', '"'),
    *_V,
)
_HMAC = f"'PLATE-' || upper(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(license_plate))))[1:10])"
SQL["export_csv"] = over(f" SELECT v.id, filename, violation_type, CASE violation_type {_NAMES} END AS type_name, start_ms / 1000 AS start_sec, CASE WHEN license_plate <> '' THEN {_HMAC} END AS plate, true AS anonymized FROM violations v JOIN videos ON videos.id = v.video_id", *_V)
SQL["export_json"] = over(" SELECT id, notes, license_plate, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM violations", "violations")
SQL["export_detail_tables"] = over(
    f"""{_MOMENT} SELECT 'summary' AS part, k AS key, CASE k WHEN 'videos' THEN a WHEN 'violations' THEN b ELSE b / a END::DOUBLE AS value FROM (SELECT (SELECT count(*) FROM videos) AS a, (SELECT count(*) FROM violations) AS b), (VALUES ('videos'), ('violations'), ('per_video')) t(k)
UNION ALL SELECT 'by_type', CASE violation_type {_NAMES} END, count(*) FROM violations GROUP BY ALL UNION ALL SELECT 'by_hour', hour(moment)::VARCHAR, count(*) FROM m GROUP BY ALL
UNION ALL SELECT 'details', violation_type, round(sum(start_ms / 1000), 3) FROM violations JOIN videos ON videos.id = video_id GROUP BY ALL""",
    *_V,
)
SQL["export_log"] = over(""", s AS (SELECT DISTINCT coalesce(source_type, 'other') AS s FROM videos) SELECT 'study of ' || s AS study_name, '{"source":"' || s || '"}' AS filter_json, 'csv' AS format, '/out/' || s AS output_path, 2::BIGINT AS n FROM s""", "videos")
SQL["deletion_audit"] = over(" SELECT 'video' AS entity, id AS entity_id, 'delete' AS action, filename AS old_value, NULL::VARCHAR AS new_value, 'admin' AS actor FROM videos WHERE id % 4 = 1", "videos")

# Batches, documents, files and trails with all their outputs.
SQL["analyze_batch_outputs"] = over(
    """, r AS (SELECT video_id, frame_no AS k, count(*) AS n, round(sum(bbox_x1), 2) AS x1 FROM detections GROUP BY ALL),
e AS (SELECT *, CASE WHEN video_id % 23 = 1 AND k = 7 THEN 'no frame index' WHEN video_id % 14 = 5 AND k = 4 THEN 'no xyxy' WHEN video_id % 9 = 0 AND k = 2 AND n > 0 THEN 'conf and xyxy differ in length'
  WHEN video_id % 17 = 3 AND k < 3 AND NOT (video_id % 14 = 5 AND k = 4) THEN 'a box without four corners' END AS error FROM r),
bad AS (SELECT video_id, count(*) AS n, first(error ORDER BY CASE WHEN error = 'no frame index' THEN -1 ELSE k END) AS error FROM e WHERE error IS NOT NULL GROUP BY 1)
SELECT video_id, k * 3 AS frame_no, n, x1, NULL::VARCHAR AS error FROM r WHERE video_id NOT IN (SELECT video_id FROM bad) UNION ALL SELECT video_id, NULL, n, NULL, error FROM bad""",
    "detections",
)
SQL["study_lines"] = over(
    f"""{_MOMENT}, l(part, key, n, videos, filename, name, end_ms, confidence, plate) AS (
 SELECT 'study', NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::INT, NULL::DOUBLE, NULL::VARCHAR
 UNION ALL SELECT 'kpis', NULL, (SELECT count(*) FROM violations), (SELECT count(*) FROM videos), NULL, NULL, NULL, NULL, NULL
 UNION ALL SELECT 'violations', v.id::VARCHAR, NULL, NULL, filename, CASE violation_type {_NAMES} ELSE violation_type END, end_ms, round(confidence, 4), {_PSEUDONYM} FROM violations v JOIN videos ON videos.id = v.video_id
 UNION ALL SELECT 'by_type', violation_type, count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM violations GROUP BY 2
 UNION ALL SELECT 'by_hour', hour(moment)::VARCHAR, count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM m GROUP BY 2
 UNION ALL SELECT 'by_weekday', ((dayofweek(moment) + 6) % 7)::VARCHAR, count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM m GROUP BY 2
 UNION ALL SELECT 'by_review_status', review_status, count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM violations GROUP BY 2)
SELECT *, true AS anonymized FROM l""",
    *_V,
)
_LABELS = "|".join(DETECTION_CLASSES.values())
SQL["annotation_files"] = over(
    f""", good AS (SELECT id FROM videos WHERE width IS NOT NULL AND height IS NOT NULL),
b AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_no) - 1 AS image, (row_number() OVER (PARTITION BY video_id, frame_no ORDER BY id) - 1)::INT AS place FROM detections WHERE video_id IN (SELECT id FROM good))
SELECT 'box' AS part, video_id, image, frame_no, place, class_name AS text, {", ".join(f"printf('%.2f', bbox_{c})::DOUBLE AS bbox_{c}" for c in ("x1", "y1", "x2", "y2"))} FROM b
UNION ALL SELECT 'task', id, (SELECT count(DISTINCT frame_no) FROM detections WHERE video_id = g.id), NULL, NULL, 'video_' || id || '|annotation|{_LABELS}', NULL, NULL, NULL, NULL FROM good g
UNION ALL SELECT 'refused', id, NULL, NULL, NULL, 'unknown size', NULL, NULL, NULL, NULL FROM videos WHERE width IS NULL OR height IS NULL
UNION ALL SELECT DISTINCT 'refused', video_id, NULL::BIGINT, NULL::INT, NULL::INT, 'unknown video', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM detections WHERE video_id NOT IN (SELECT id FROM videos)""",
    "detections",
    "videos",
)
# What held before a change is found by looking for the last earlier one, row by row.
SQL["audit_log"] = over(
    f"""{_VALID}, log AS (SELECT * FROM changes WHERE op IN ('review', 'D') OR change_id IN (SELECT change_id FROM ok WHERE reason IS NULL)),
top AS (SELECT max(id)::BIGINT AS top FROM violations),
died AS (SELECT violation_id, min((changed_at, change_id)) AS at FROM log WHERE op = 'D' GROUP BY 1),
c AS (SELECT l.*, v.id IS NOT NULL AND (d.at IS NULL OR (l.changed_at, l.change_id) <= d.at) AS known, v.review_status AS review0, v.violation_type || ' (source=' || coalesce(v.source, 'auto') || ')' AS label0
  FROM log l LEFT JOIN violations v ON v.id = l.violation_id LEFT JOIN died d USING (violation_id) WHERE op <> 'I'),
p AS (SELECT c.*, max_by(e.review_status, (e.changed_at, e.change_id)) FILTER (e.op = 'review') AS review1, count(*) FILTER (e.op = 'U') AS edits FROM c LEFT JOIN log e ON e.violation_id = c.violation_id AND e.op IN ('review', 'U')
  AND (e.changed_at, e.change_id) < (c.changed_at, c.change_id) GROUP BY ALL),
t AS (SELECT video_id, change_id, changed_at, actor FROM changes WHERE op = 'U' AND change_id % 2 = 0),
w AS (SELECT t.*, lag(changed_at) OVER (PARTITION BY t.video_id ORDER BY changed_at, change_id) AS before, v.id IS NOT NULL AS known, v.recorded_at FROM t LEFT JOIN videos v ON v.id = t.video_id)
SELECT 'violation' AS entity, violation_id::BIGINT AS entity_id, CASE op WHEN 'review' THEN 'review_status' WHEN 'D' THEN 'delete' ELSE 'edit' END AS action,
 CASE WHEN known THEN CASE WHEN op = 'review' THEN coalesce(review1, review0) WHEN edits > 0 THEN 'speeding (source=manual)' ELSE label0 END END AS old_value,
 CASE op WHEN 'review' THEN review_status WHEN 'U' THEN violation_type || ' (source=manual)' END AS new_value, actor FROM p
UNION ALL SELECT 'violation', top + change_id + 1, 'create_manual', NULL, violation_type || ' @ video ' || video_id, actor FROM log, top WHERE op = 'I'
UNION ALL SELECT 'video', video_id, 'set_recorded_at', CASE WHEN known THEN strftime(coalesce(before, recorded_at), '%Y-%m-%dT%H:%M:%S') END, strftime(changed_at, '%Y-%m-%dT%H:%M:%S'), actor FROM w""",
    "changes",
    "videos",
    "violations",
)
SQL["zones_from_files"] = over(
    """, f AS (SELECT id, 'zones_' || id || '.json' AS file FROM videos),
z AS (SELECT video_id, zone_type, CASE zone_type WHEN 'stop_line' THEN '0.0,250.5;1000.0,250.5' WHEN 'lane_line_solid' THEN '0.0,350.5;1000.0,350.5' ELSE '600.0,250.0;700.0,250.0;700.0,450.0;600.0,450.0' END AS text FROM zones)
SELECT 'zone' AS part, video_id, zone_type, text FROM z WHERE video_id % 7 = 0 UNION ALL SELECT 'zone', id, 'lane_line_dashed', '0.0,9.5;9.0,9.5' FROM f WHERE id % 7 <> 0
UNION ALL SELECT 'refused', id, NULL, file || ': no JSON' FROM f WHERE id % 7 = 0
UNION ALL SELECT 'refused', id, 'island', file || ': unknown type' FROM f WHERE id % 7 <> 0 AND id % 5 = 0 UNION ALL SELECT 'refused', id, 'no_parking', file || ': too few points' FROM f WHERE id % 7 <> 0 AND id % 5 = 0""",
    "videos",
    "zones",
)
