"""Sources: files, fingerprints, probes, detections, zones, calibrations, labels and logs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.functions import geometry as G
from roadtrace.schemas import DETECTION_CLASSES, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, ZONE_TYPES
from roadtrace.session import materialise, new_folder

CHUNK = 4 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def video_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Video files below paths: path, size, modified; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.filter(extension(F.col("path")).isin(VIDEO_EXTENSIONS)).dropDuplicates(["path"])


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, inner = fs.FileSystem.from_uri(_uri(folder))
    system.create_dir(inner, recursive=True)
    for batch in batches:
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
            with system.open_output_stream(f"{inner}/{name}") as f:
                f.write((content or "").encode())
        yield batch.select(["name"])


def write_files(rows: DataFrame, folder: str) -> str:
    """A text file for each row (name, content) in a folder, which is returned; a task that runs again writes the same files."""
    rows.select("name", "content").mapInArrow(partial(_write, folder=folder), "name string").write.format("noop").mode("overwrite").save()
    return folder


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _opened(path: str):
    """A random-access file on whichever file system the path names."""
    system, inner = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(inner)


def _partial(path: str) -> str:
    with _opened(path) as f:
        size = f.size()
        digest = hashlib.sha256(size.to_bytes(8, "little") + f.read(CHUNK))
        if size > 2 * CHUNK:
            f.seek(size - CHUNK)
            digest.update(f.read(CHUNK))
    return digest.hexdigest()


def _full(path: str) -> str:
    digest = hashlib.sha256()
    with _opened(path) as f:
        while part := f.read(CHUNK):
            digest.update(part)
    return digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch], digest: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, errors = [], []
        for path in batch.column("path").to_pylist():
            try:
                found.append(digest(path))
                errors.append(None)
            except OSError as e:
                found.append(None)
                errors.append(str(e).splitlines()[0][:300])
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string()), pa.array(errors, pa.string())], names=["path", "digest", "error"])


def fingerprints(files: DataFrame) -> DataFrame:
    """path, partial and full fingerprint, and the error of a file that cannot be read.

    The partial one is SHA-256 over the size (eight bytes, little-endian), the first 4 MiB
    and, of files above 8 MiB, the last 4 MiB: two reads, whatever the size. The full one is
    taken where partial ones collide, and streamed, so no file is held in memory.
    """
    out = "path string, digest string, error string"
    part = files.select("path").mapInArrow(partial(_digests, digest=_partial), out).withColumnRenamed("digest", "partial")
    part = materialise(part, "fingerprints")
    twins = part.groupBy("partial").agg(F.count("*").alias("n")).filter("n > 1 and partial is not null").select("partial")
    full = part.join(twins, "partial", "left_semi").select("path").mapInArrow(partial(_digests, digest=_full), out)
    full = full.select("path", F.col("digest").alias("full"), F.col("error").alias("late"))
    return part.join(full, "path", "left").select("path", "partial", "full", F.coalesce("error", "late").alias("error"))


def import_classify(found: DataFrame, known: DataFrame) -> DataFrame:
    """found: path, partial, full, error; known: filepath, file_hash, full. Outcome: failed, skipped, duplicate or imported.

    A duplicate needs the same full hash as a known file, or as an earlier path of the same import.
    """
    paths = known.select(F.col("filepath").alias("path"), F.lit(True).alias("is_known")).distinct()
    fulls = known.filter("full is not null").select("full", F.lit(True).alias("has_twin")).distinct()
    first = found.filter("full is not null").groupBy("full").agg(F.min("path").alias("first"))
    rows = found.join(paths, "path", "left").join(fulls, "full", "left").join(first, "full", "left")
    twin = F.coalesce("has_twin", F.lit(False)) | F.coalesce(F.col("first") < F.col("path"), F.lit(False))
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("is_known"), "skipped").when(twin, "duplicate").otherwise("imported")
    return rows.select("path", outcome.alias("outcome"))


PROBE = "format struct<duration:string,size:string,tags:map<string,string>>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,tags:map<string,string>>>"


def _rate(text: Column) -> Column:
    parts = F.split(text, "/")
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0))
    return F.when((den != 0) & (num != 0), num / den)


def probe_metadata(probes: DataFrame) -> DataFrame:
    """path, json -> duration, width, height, codec, fps, size in MB, recorded_at. What cannot be read is null."""
    p = probes.withColumn("p", F.from_json("json", PROBE))
    v = F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    tags = F.map_zip_with(F.coalesce(F.col("p.format.tags"), F.create_map().cast("map<string,string>")), F.coalesce(v["tags"], F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))
    when = F.coalesce(*(F.try_to_timestamp(F.try_element_at(tags, F.lit(k))) for k in ("creation_time", "com.apple.quicktime.creationdate", "date")))
    return p.select(
        "path",
        F.col("p.format.duration").try_cast("double").alias("duration_sec"),
        v["width"].alias("width"),
        v["height"].alias("height"),
        v["codec_name"].alias("codec"),
        F.coalesce(_rate(v["avg_frame_rate"]), _rate(v["r_frame_rate"])).alias("fps"),
        F.round(F.col("p.format.size").try_cast("double") / (1024 * 1024), 2).alias("file_size_mb"),
        when.alias("recorded_at"),
    )


def detections_from_frames(results: DataFrame, rates: DataFrame) -> DataFrame:
    """results: video_id, kept_idx, stride, xyxy array<array<double>>, conf, cls, ids arrays. One row a box."""
    names = F.create_map(*[F.lit(x) for kv in DETECTION_CLASSES.items() for x in kv])
    rows = results.join(rates.select("video_id", "fps"), "video_id", "left").withColumn("frame_no", (F.col("kept_idx") * F.col("stride")).cast("int"))
    rows = rows.select("video_id", "frame_no", F.coalesce(F.col("fps"), F.lit(30.0)).alias("fps"), F.posexplode(F.arrays_zip("xyxy", "conf", "cls", "ids")).alias("k", "b"))
    corner = lambda i, c: F.get("b.xyxy", F.lit(i)).alias(f"bbox_{c}")
    return rows.select("video_id", "frame_no", F.floor(1000 * F.col("frame_no") / F.greatest(F.col("fps"), F.lit(1e-6))).cast("int").alias("timestamp_ms"), "k", F.coalesce(F.try_element_at(names, F.col("b.cls")), F.col("b.cls").cast("string")).alias("class_name"), F.col("b.conf").alias("confidence"), *(corner(i, c) for i, c in enumerate(G.Box._fields)), F.col("b.ids").alias("track_id"))


def detections_replace(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """All detections after the touched videos (video_id) were analysed again, also where they have none now."""
    return old.join(touched.select("video_id").distinct(), "video_id", "left_anti").unionByName(new.join(touched.select("video_id").distinct(), "video_id", "left_semi"), allowMissingColumns=True)


def analysis_summary(detections: DataFrame) -> DataFrame:
    return detections.groupBy("video_id").agg(F.count("*").alias("n_detections"), F.countDistinct("frame_no").alias("n_frames"))


def analyze_batch(results: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections of the readable videos, and (video_id, frames, error) of those with a malformed frame, which are left out whole.

    The results are scanned once: frames are judged and written, good and malformed ones
    apart; both outputs read what was written. The error is that of a video's first malformed
    frame, frames without an index before all others; frames is how many there are. Frames
    without video_id are a video of their own.
    """
    arrays = ("xyxy", "conf", "cls", "ids")
    sizes = [F.size(c) for c in arrays]
    error = F.when(F.col("kept_idx").isNull(), "no frame index").when(F.col("stride").isNull(), "no stride")
    for c in arrays:
        error = error.when(F.col(c).isNull(), f"no {c}")
    for c, n in zip(arrays[1:], sizes[1:]):
        error = error.when(n != sizes[0], f"{c} and xyxy differ in length")
    error = error.when(F.exists("xyxy", lambda b: b.isNull() | (F.size(b) != 4)), "a box without four corners")
    judged = results.withColumn("_error", error).withColumn("_malformed", error.isNotNull())
    at = new_folder(results.sparkSession, "analysed")
    judged.write.partitionBy("_malformed").parquet(at)
    held = results.sparkSession.read.schema(judged.schema).parquet(at)
    first = F.min(F.struct("kept_idx", "_error"))
    bad = held.filter("_malformed").groupBy("video_id").agg(F.count("*").alias("frames"), first["_error"].alias("error"))
    good = held.filter("not _malformed").drop("_malformed", "_error").alias("r")
    good = good.join(bad.select(F.col("video_id").alias("bad_id")), F.col("r.video_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return detections_from_frames(good, rates), bad


def videos_insert(known: DataFrame, new: DataFrame) -> DataFrame:
    """New catalogue rows: unknown paths, one row each (of several the first filename), ids after the largest known one."""
    rest = [c for c in new.columns if c != "filepath"]
    fresh = new.join(known.select("filepath"), "filepath", "left_anti").groupBy("filepath").agg(F.min(F.struct(*rest)).alias("r")).select("filepath", "r.*")
    # distinct and above the known ones, with gaps between partitions; nothing is ranked globally
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rows = fresh.withColumn("id", top + 1 + F.monotonically_increasing_id())
    return rows.withColumn("status", F.lit("imported"))


def parse_points(raw: Column) -> Column:
    """JSON [[x, y], ...] as an array of points. Corrupt text gives none; a bad point is left out alone."""
    items = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    pairs = F.transform(items, lambda e: F.from_json(e, "array<string>"))
    points = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def zones_parse(zones: DataFrame) -> DataFrame:
    return zones.select("id", "video_id", "zone_type", parse_points(F.col("polygon")).alias("points"), F.from_json("metadata", "map<string,string>").alias("metadata"))


def zones_validate(parsed: DataFrame) -> DataFrame:
    """parsed zones with the reason for which one is refused, null for the good ones."""
    least = F.when(F.col("zone_type") == "no_parking", 3).otherwise(2)
    reason = F.when(F.col("zone_type").isNull() | ~F.col("zone_type").isin(ZONE_TYPES), "unknown type").when(F.size("points") < least, "too few points")
    return parsed.withColumn("reason", reason)


def zones_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The zones after those of some videos were replaced by new ones."""
    return old.join(new.select("video_id").distinct(), "video_id", "left_anti").unionByName(new, allowMissingColumns=True)


def zones_add(old: DataFrame, new: DataFrame) -> DataFrame:
    """The zones with the good ones of `new` (video_id, zone_type, polygon, metadata) behind them, ids after the largest."""
    good = zones_validate(new.withColumn("points", parse_points(F.col("polygon")))).filter("reason is null").drop("points", "reason", "id")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    rows = good.withColumn("id", top + 1 + F.monotonically_increasing_id())
    return old.withColumn("id", F.col("id").cast("long")).unionByName(rows, allowMissingColumns=True)


def zones_delete(old: DataFrame, ids: DataFrame) -> DataFrame:
    """The zones without those of the given ids."""
    return old.join(ids.select("id").distinct(), "id", "left_anti")


def zones_file(spark: SparkSession, path: str, video_id: int) -> DataFrame:
    """Zones of one video out of a JSON file [{zone_type, polygon}]."""
    rows = spark.read.schema("zone_type string, polygon string, metadata string").json(path, multiLine=True)
    return rows.withColumn("video_id", F.lit(video_id))


def calibration_compute(reference: DataFrame) -> DataFrame:
    """video_id, points, distances (metres between consecutive points) -> meters_per_px, or the reason why there is none."""
    n = F.size("points")
    steps = F.zip_with(F.slice("points", 1, F.greatest(n - 1, F.lit(0))), F.slice("points", 2, F.greatest(n - 1, F.lit(0))), lambda p, q: G.distance(p["x"], p["y"], q["x"], q["y"]))
    reason = F.when(n < 2, "needs two points").when(F.size("distances") != n - 1, "needs a distance for each pair").when(F.exists("distances", lambda d: d.isNull() | (d <= 0)), "distances must be positive").when(F.exists(steps, lambda s: s == 0), "points coincide")
    ratios = F.zip_with("distances", steps, lambda d, s: d / F.nullif(s, F.lit(0.0)))
    mean = F.aggregate(ratios, F.lit(0.0), lambda acc, r: acc + r) / F.greatest(F.size(ratios), F.lit(1))
    return reference.select("video_id", F.when(reason.isNull(), mean).alias("meters_per_px"), reason.alias("reason"))


def calibration_upsert(rows: DataFrame) -> DataFrame:
    """The latest calibration of each video."""
    return rows.groupBy("video_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "video_id"]), "calibrated_at").alias("r")).select("video_id", "r.*")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def labels_read(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """stem, image path and label lines of images and label files that share a stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(images).select("path").filter(extension(F.col("path")).isin(IMAGE_EXTENSIONS))
    pictures = files.groupBy(stem(F.col("path")).alias("stem")).agg(F.max("path").alias("image"))
    lines = spark.read.text(labels, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("path"), "value")
    texts = lines.groupBy(stem(F.col("path")).alias("stem")).agg(F.max_by("value", "path").alias("text"))
    return pictures.join(texts, "stem").select("stem", "image", F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "").alias("lines"))


def training_log_read(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV: trimmed headers, cells that are numbers, no empty rows."""
    raw = spark.read.csv(path, header=True)
    out = raw.select(*(F.trim(F.col(f"`{c}`")).try_cast("double").alias(c.strip()) for c in raw.columns))
    return out.dropna("all")


def evidence_decode(raw: Column) -> Column:
    """A JSON list's whole numbers; corrupt text gives none."""
    items = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda e: e.try_cast("int")), lambda i: i.isNotNull())


def constraint_breaks(videos: DataFrame) -> DataFrame:
    """Rows against the catalogue's rules: an unknown source_type, or a filepath that others have too."""
    twice = videos.groupBy("filepath").agg(F.count("*").alias("n")).filter("n > 1").select("filepath", F.lit("repeated filepath").alias("twice"))
    rows = videos.join(twice, "filepath", "left")
    reason = F.when(~F.col("source_type").isin("dashcam", "cctv", "social", "other"), "unknown source_type").otherwise(F.col("twice"))
    return rows.select("id", reason.alias("reason")).filter("reason is not null")
