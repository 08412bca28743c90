"""The domain's tables, derived from a star schema's: one SQL text for Spark and for checks in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadtrace.session import dealt

#: Per table: what it reads, and its SQL. {mins:x} is an interval of x minutes; the text is otherwise common to both engines.
TABLES: dict[str, tuple[list[str], str]] = {
    "videos": (
        ["supplier"],
        """SELECT CAST(s_suppkey + 1 AS INT) AS id, concat('/media/clip_', CAST(s_suppkey AS STRING), '.mp4') AS filepath, concat('clip_', CAST(s_suppkey AS STRING), '.mp4') AS filename,
 CASE s_suppkey % 5 WHEN 0 THEN 'dashcam' WHEN 1 THEN 'cctv' WHEN 2 THEN 'social' WHEN 3 THEN 'other' END AS source_type,
 CAST(60 + s_suppkey % 300 AS DOUBLE) AS duration_sec, CASE WHEN s_suppkey % 9 <> 0 THEN 1280 END AS width, CASE WHEN s_suppkey % 9 <> 0 THEN 720 END AS height,
 CASE s_suppkey % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(10 AS DOUBLE) WHEN 2 THEN CAST(25 AS DOUBLE) END AS fps, 'h264' AS codec,
 CASE s_suppkey % 4 WHEN 0 THEN 'imported' WHEN 1 THEN 'prelabeled' WHEN 2 THEN 'reviewed' ELSE 'analyzed' END AS status,
 CASE WHEN s_suppkey % 7 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + {mins:s_suppkey * 37} END AS recorded_at,
 TIMESTAMP '2024-02-01 00:00:00' + {mins:s_suppkey % 50} AS imported_at FROM supplier""",
    ),
    "detections": (
        ["lineitem"],
        """SELECT CAST((s + 1) * 10 + k AS BIGINT) * 1000000 + f AS id, CAST(s + 1 AS INT) AS video_id, f AS frame_no,
 CAST(floor(1000 * f / CASE s % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 25 ELSE 30 END) AS INT) AS timestamp_ms,
 CASE WHEN k <= 4 THEN 'vehicle' WHEN k = 5 THEN 'motorcycle' WHEN k = 6 THEN CASE WHEN q <= 20 THEN 'person' WHEN q <= 30 THEN 'helmet' ELSE 'traffic_light_red' END
  ELSE CASE WHEN q <= 25 THEN 'license_plate' ELSE 'lane_line_solid' END END AS class_name,
 CAST(0.5 AS DOUBLE) + d * 4 AS confidence, x AS bbox_x1, y AS bbox_y1, x + w AS bbox_x2, y + h AS bbox_y2, CASE WHEN k <= 5 THEN k WHEN k = 6 THEN 6 END AS track_id
 FROM (SELECT *, CASE k WHEN 1 THEN 100 + d WHEN 2 THEN 110 + d WHEN 3 THEN 400 + t WHEN 4 THEN 620 + d WHEN 5 THEN 300 + d WHEN 6 THEN 305 + d ELSE 105 + d END AS x,
  CASE k WHEN 1 THEN 10 + CAST(6 AS DOUBLE) * f + t WHEN 2 THEN 80 + CAST(6 AS DOUBLE) * f + t WHEN 3 THEN CASE WHEN s % 3 = 0 THEN 600 - CAST(6 AS DOUBLE) * f ELSE CAST(6 AS DOUBLE) * f END
   WHEN 4 THEN 300 + t WHEN 5 THEN 200 + CAST(4 AS DOUBLE) * f WHEN 6 THEN 180 + CAST(4 AS DOUBLE) * f ELSE 30 + CAST(6 AS DOUBLE) * f END AS y,
  CASE WHEN k <= 4 THEN 60 WHEN k = 7 THEN 20 ELSE 30 END AS w, CASE WHEN k <= 4 THEN 50 WHEN k = 7 THEN 15 ELSE 40 END AS h
  FROM (SELECT l_suppkey AS s, l_linenumber AS k, l_quantity AS q, l_discount AS d, l_tax AS t,
   CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS f FROM lineitem) r) z""",
    ),
    "zones": (
        ["supplier"],
        """SELECT CAST(s_suppkey * 3 + k AS INT) AS id, CAST(s_suppkey + 1 AS INT) AS video_id, zone_type, polygon, CAST(NULL AS STRING) AS metadata FROM supplier CROSS JOIN
 (SELECT 1 AS k, 'stop_line' AS zone_type, '[[0,250.5],[1000,250.5]]' AS polygon UNION ALL SELECT 2, 'lane_line_solid', '[[0,350.5],[1000,350.5]]' UNION ALL SELECT 3, 'no_parking', '[[600,250],[700,250],[700,450],[600,450]]') z""",
    ),
    "calibrations": (["supplier"], "SELECT CAST(s_suppkey + 1 AS INT) AS video_id, '[[0,0],[10,0]]' AS reference_pts, CAST(0.2 AS DOUBLE) AS meters_per_px, TIMESTAMP '2024-01-05 00:00:00' + {mins:s_suppkey} AS calibrated_at FROM supplier WHERE (s_suppkey + 1) % 2 = 0"),
    "violations": (
        ["events"],
        """SELECT CAST(event_id AS INT) AS id, CAST(user_id % 97 + 1 AS INT) AS video_id,
 CASE event_type WHEN 'error' THEN 'speeding' WHEN 'click' THEN 'red_light_running' WHEN 'view' THEN 'lane_keeping' WHEN 'purchase' THEN 'illegal_parking' ELSE 'manual_other' END AS violation_type,
 CAST(floor(value * 1000) AS INT) AS start_ms, CAST(floor(value * 1000) AS INT) + 2500 AS end_ms, CAST(0.5 AS DOUBLE) + CAST(event_id % 50 AS DOUBLE) / 100 AS confidence, CAST(event_id % 5 + 1 AS INT) AS track_id,
 CASE WHEN event_id % 11 = 0 THEN 'broken' ELSE concat('[', CAST(event_id % 40 AS STRING), ',', CAST(event_id % 40 + 3 AS STRING), ',', CAST(event_id % 40 + 9 AS STRING), ']') END AS evidence_frames,
 CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'false_positive' ELSE 'uncertain' END AS review_status,
 CASE WHEN event_type = 'signup' THEN 'manual' WHEN event_id % 13 <> 0 THEN 'auto' END AS source, CASE WHEN event_id % 6 = 0 THEN '=note' WHEN event_id % 6 = 1 THEN 'seen' END AS notes, ts AS created_at,
 CASE WHEN event_id % 2 = 0 THEN concat('ABC ', CAST(1000 + user_id AS STRING)) END AS license_plate, CASE WHEN event_id % 2 = 0 THEN CAST(0.9 AS DOUBLE) END AS plate_conf FROM events""",
    ),
    "hashes": (
        ["part"],
        """SELECT CAST(p_partkey AS INT) AS id, CASE WHEN p_partkey % 50 = 7 THEN 'zz-bad' ELSE concat(substring(h, 1, 64 - r), repeat('0', r)) END AS phash,
 {sha256:CAST(CASE WHEN p_partkey % 40 = 0 THEN p_partkey + 20 ELSE p_partkey END AS STRING)} AS file_hash FROM (SELECT p_partkey, CAST(p_partkey % 4 * 2 AS INT) AS r,
 concat(md5(CAST(p_partkey - p_partkey % 4 AS STRING)), md5(concat(CAST(p_partkey - p_partkey % 4 AS STRING), 'x'))) AS h FROM part) q""",
    ),
    "plate_reads": (
        ["lineitem"],
        """SELECT CAST(l_suppkey + 1 AS INT) AS video_id, CAST(l_linenumber AS INT) AS track_id, CAST(l_orderkey AS STRING) AS image, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS read_id,
 concat(CASE l_partkey % 4 WHEN 0 THEN 'أبح ' WHEN 1 THEN 'ABD-' WHEN 2 THEN 'ابح ' ELSE '' END, CASE WHEN l_partkey % 8 < 6 THEN '١٢٣٤' ELSE '12' END) AS raw_text, round(l_discount * 10, 2) AS confidence FROM lineitem""",
    ),
    "label_lines": (
        ["lineitem"],
        """SELECT concat('img_', CAST(l_orderkey AS STRING)) AS stem, CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split,
 concat(CASE WHEN l_partkey % 23 = 0 THEN 'x' ELSE CAST(l_partkey % 11 AS STRING) END, ' 0.5 0.5 0.1 0.2') AS line FROM lineitem""",
    ),
    "eval_metrics": (["part"], "SELECT concat('class_', CAST(p_partkey AS STRING)) AS class_name, CAST(p_partkey % 11 AS INT) AS class_id, round((p_partkey % 97) / CAST(97 AS DOUBLE), 4) AS map50, round((p_partkey % 89) / CAST(89 AS DOUBLE), 4) AS precision, round((p_partkey % 83) / CAST(83 AS DOUBLE), 4) AS recall FROM part"),
    "training_log": (["orders"], "SELECT CAST(o_orderkey AS DOUBLE) AS epoch, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 10 END AS box_loss, CAST(o_orderkey % 70 AS DOUBLE) / 10 AS cls_loss, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 30 AS DOUBLE) / 10 END AS dfl_loss FROM orders"),
    "changes": (
        ["events"],
        """SELECT CAST(event_id AS BIGINT) AS change_id, CASE event_id % 7 WHEN 0 THEN 'D' WHEN 1 THEN 'I' WHEN 2 THEN 'U' ELSE 'review' END AS op, CAST(event_id * 3 % 20000 AS INT) AS violation_id,
 CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' ELSE 'uncertain' END AS review_status, 'speeding' AS violation_type, CAST(user_id % 120 + 1 AS INT) AS video_id,
 CAST(floor(value * 900) AS INT) AS start_ms, CAST(floor(value * 900) AS INT) + CASE WHEN event_id % 9 = 0 THEN 0 ELSE 4000 END AS end_ms, CASE WHEN event_id % 10 = 1 THEN 'ABCDEFGHIJKLMNOP' ELSE 'ABC 12' END AS license_plate,
 'checked' AS notes, concat('user', CAST(user_id % 5 AS STRING)) AS actor, ts AS changed_at FROM events""",
    ),
}

#: What the rows of a table are numbered by: they are dealt by it in tasks that do not grow.
NUMBERED_BY = {"detections": ["l_suppkey", "l_linenumber"]}


def _text(name: str, duck: bool) -> str:
    text = TABLES[name][1]
    for mark in ("mins", "sha256"):
        while (at := text.find("{" + mark + ":")) >= 0:
            end, depth = at + 1, 1
            while depth:
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            x = text[at + len(mark) + 2 : end - 1]
            new = {"mins": f"to_minutes(CAST({x} AS BIGINT))" if duck else f"make_interval(0, 0, 0, 0, 0, CAST({x} AS INT), 0)", "sha256": f"sha256({x})" if duck else f"sha2({x}, 256)"}[mark]
            text = text[:at] + new + text[end:]
    return text.replace("AS STRING", "AS VARCHAR") if duck else text


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; the timestamps have no zone."""
    inputs, _ = TABLES[name]
    text = _text(name, duck=False)
    for t in inputs:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in inputs}
    if name in NUMBERED_BY:
        read = {t: dealt(df, *NUMBERED_BY[name]) for t, df in read.items()}
    return spark.sql(text, **read)


def with_tables(query: str, *names: str) -> str:
    """DuckDB SQL: the query over derived tables."""
    parts = ", ".join(f"{n} AS ({_text(n, duck=True)})" for n in names)
    return f"WITH {parts} {query}" if not query.lstrip().startswith(",") else f"WITH {parts}{query}"
