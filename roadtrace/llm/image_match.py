"""Cropped and edited copies among images, by local descriptors.

Corners are found by the Harris measure, turned upright by the intensity centroid of their
surroundings, and described by 128 brightness tests, and by 128 more of twice the radius.
Images are described at two sizes; the queries, a fixed share of all, at a ladder of sizes,
so that a copy of any scale between meets one that is near. Descriptors meet in Hamming
tables, each keyed by some of the bits; keys and tables grow with the number of descriptors.
Corners that are alike by chance, whose number grows with the square of the images, do not
meet, since what is around them differs. Images of which any corners meet are compared
corner by corner, pairs of a small Hamming distance propose similarity transforms,
and two images match where enough different corners agree on one. Images of equal pixels
form a class that is described once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.session import materialise

BITS = 128
#: Share of bits that differ between descriptors which meet with MEET in some table, and descriptors a key holds on average.
NOISE, MEET, KEY_HOLDS = 0.1, 0.85, 256
#: Sizes at which images are described, and those at which queries are.
LEVELS = (1.0, 0.6)
LADDER = tuple(2 ** (k / 4) for k in (2, 1, 0, -1, -2, -3, -4, -5))
#: Corners kept of an image over its levels, and of a query at each of its; both grow with images longer than BASE_SIDE.
CORNERS, ASKED, BASE_SIDE = 32, 40, 96
RADIUS = 12
#: Largest Hamming distance of two descriptors that meet in a table, and of two of one corner in images that are compared.
NEAR, DISTANCE = 16, 24
#: Surroundings of two corners are alike with at most AROUND differing bits. They are not asked for in corners that differ by CLOSE bits at most (of a part
#: that is put into another picture), or where an image has fewer than FEW corners (a small one, most of whose surroundings lie outside of it).
AROUND, CLOSE, FEW = 30, 10, 16
#: Corners that must agree on a transform, how far off they may lie in pixels of an image of BASE_SIDE, and how many transforms are tried beyond all pairs.
AGREE, OFF, TRIES = 4, 3.5, 4000
#: How far a pair's own turn (radians) and scale (factor) may differ from the transform's.
TURN_OFF, SCALE_OFF = 0.45, 1.45
#: Broadcast at most so many rows of (id, digest).
BROADCAST_IDS = 200_000

_rng = np.random.Generator(np.random.PCG64(4096))
_TESTS = np.clip(_rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
_TESTS *= np.minimum(1, (RADIUS - 1) / np.maximum(1e-9, np.hypot(_TESTS[..., 0], _TESTS[..., 1])))[..., None]
_WIDE = np.clip(_rng.normal(0, RADIUS, (BITS, 2, 2)), -2 * RADIUS, 2 * RADIUS)
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])
#: Directions to which an upright turn is rounded, and the tests turned by each.
TURNS = 64
_TURNED, _TURNED_WIDE = (np.stack([np.rint(tests @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(int) for a in np.arange(TURNS) * 2 * np.pi / TURNS]) for tests in (_TESTS, _WIDE))

WORDS = ("d0", "d1", "c0", "c1")
DESCRIBED = "cid long, asked boolean, place array<long>, d0 array<long>, d1 array<long>, c0 array<long>, c1 array<long>"


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r + 1) squares, edges repeated; a: (..., h, w)."""
    n = 2 * r + 1
    for axis in (-2, -1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float32)
        lo = [slice(None)] * a.ndim
        hi = [slice(None)] * a.ndim
        lo[axis], hi[axis] = slice(0, -n), slice(n, None)
        a = (s[tuple(hi)] - s[tuple(lo)]) / n
    return a


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * image.shape[0] / h - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * image.shape[1] / w - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, image.shape[0] - 2)), np.minimum(x.astype(int), max(0, image.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def _corners(level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strength, y and x of local maxima of the Harris measure, away from the border; of equal neighbours one."""
    gy, gx = np.zeros_like(level), np.zeros_like(level)
    gy[1:-1], gx[:, 1:-1] = level[2:] - level[:-2], level[:, 2:] - level[:, :-2]
    xx, yy, xy = _box(np.stack([gx * gx, gy * gy, gx * gy]), 2)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    m = RADIUS + 1
    if min(level.shape) <= 2 * m:
        return np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    mid = r[m:-m, m:-m]
    top = mid > 1e-3
    for dy in (-2, -1, 0, 1, 2):
        for dx in (-2, -1, 0, 1, 2):
            if dy or dx:
                near = r[m + dy : r.shape[0] - m + dy, m + dx : r.shape[1] - m + dx]
                top &= (mid > near) | ((mid == near) & ((dy, dx) > (0, 0)))
    y, x = np.nonzero(top)
    return mid[y, x], y + m, x + m


def growth(shape: tuple[int, ...]) -> float:
    """How much larger than BASE_SIDE an image is, 1 at least."""
    return max(1.0, max(shape) / BASE_SIDE)


def _bits(level: np.ndarray, y: np.ndarray, x: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """Two words of test bits for each corner; tests: corner, test, end, (x, y); beyond the border its pixels are repeated."""
    value = level[np.clip(y[:, None, None] + tests[..., 1], 0, level.shape[0] - 1), np.clip(x[:, None, None] + tests[..., 0], 0, level.shape[1] - 1)]
    bits = np.packbits(value[..., 0] < value[..., 1], axis=1)
    return np.ascontiguousarray(bits).view(">i8").astype(np.int64).reshape(-1, 2)


def describe(image: np.ndarray, asked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, turn) in the image's pixels, and four words of test bits (two of the corner, two of its surroundings), for each corner of a grey image.

    asked: at each size of LADDER, else at LEVELS. Ties of strength go to the larger size, then
    to the upper left.
    """
    found = []
    most = round((ASKED if asked else CORNERS) * growth(image.shape))
    for share in LADDER if asked else LEVELS:
        h, w = round(image.shape[0] * share), round(image.shape[1] * share)
        if min(h, w) <= 2 * RADIUS + 2:
            continue
        level = _box(image.astype(np.float32) if share == 1 else resized(image.astype(np.float32), h, w).astype(np.float32), 1)
        s, y, x = _corners(level)
        best = np.lexsort((x, y, -s))[:most]
        found.append((level, share, s[best], y[best], x[best]))
    if not found:
        return np.zeros((0, 4)), np.zeros((0, 4), np.int64)
    if not asked:  # the strongest over all levels
        strength = np.concatenate([f[2] for f in found])
        keep = np.zeros(len(strength), bool)
        keep[np.argsort(-strength, kind="stable")[:most]] = True
        ends = np.cumsum([0, *(len(f[2]) for f in found)])
        found = [(lv, sh, s[k], y[k], x[k]) for (lv, sh, s, y, x), k in zip(found, (keep[a:b] for a, b in zip(ends, ends[1:])))]
    info, words = [], []
    for level, share, _, y, x in found:
        patch = level[y[:, None] + _DISC[:, 0], x[:, None] + _DISC[:, 1]]
        angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
        upright = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        words.append(np.concatenate([_bits(level, y, x, _TURNED[upright]), _bits(_box(level, 2), y, x, _TURNED_WIDE[upright])], 1))
        scale = level.shape[0] / image.shape[0]
        info.append(np.stack([(x + 0.5) * image.shape[1] / level.shape[1], (y + 0.5) / scale, np.full(len(x), share), angle], 1))
    return np.concatenate(info), np.concatenate(words)


def packed(info: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A corner's place in one long: quarter pixels of x and y, 256 directions, eighths of octaves of its scale and of the image's growth."""
    x, y = (np.rint(info[:, i] * 4).astype(np.int64) & 0xFFFFF for i in (0, 1))
    turn = np.rint(info[:, 3] / (2 * np.pi) * 256).astype(np.int64) & 0xFF
    scale = np.rint(np.log2(info[:, 2]) * 8).astype(np.int64) + 32
    return x << 40 | y << 20 | turn << 12 | scale << 6 | min(63, round(math.log2(growth(shape)) * 8))


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points as complex numbers, turns, scales and growths."""
    at = ((place >> 40) & 0xFFFFF) / 4 + 1j * ((place >> 20) & 0xFFFFF) / 4
    return at, ((place >> 12) & 0xFF) * (2 * np.pi / 256), 2 ** ((((place >> 6) & 0x3F) - 32) / 8), 2 ** ((place & 0x3F) / 8)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            out = []
            for cid, h, w, pixels, asked in zip(*(part.column(c).to_pylist() for c in ("cid", "height", "width", "pixels", "asked"))):
                image = np.frombuffer(pixels, np.uint8).reshape(h, w)
                for side in (False, True) if asked else (False,):
                    info, words = describe(image, side)
                    out.append((cid, side, packed(info, image.shape), *words.T))
            cid, side, *lists = zip(*out)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(side), *(pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in lists)], names=["cid", "asked", "place", *WORDS])


def whole_images(images: DataFrame) -> DataFrame:
    """Named images whose pixels fill height x width, with a 128-bit digest of size and pixels."""
    rows = images.select(F.col("media_id").cast("long").alias("media_id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")
    rows = rows.filter((F.col("height") > 0) & (F.length("pixels") == F.col("height").cast("long") * F.col("width")) & F.col("media_id").isNotNull())
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.encode(F.concat_ws("x", "height", "width", F.lit("")), "utf-8"), "pixels"))))


def table_sizes(descriptors: int) -> tuple[int, int]:
    """(tables, bits of a key): keys grow with the number of descriptors, and tables until MEET is reached."""
    bits = max(10, min(48, round(math.log2(max(1, descriptors) / KEY_HOLDS))))
    return math.ceil(math.log(1 - MEET) / math.log(1 - (1 - NOISE) ** bits)), bits


def _cut(d0: Column, d1: Column, start: int, bits: int) -> Column:
    """bits of the circle of 128 bits that d0 and d1 form, from `start` on."""
    if start >= 64:
        d0, d1, start = d1, d0, start - 64
    if start + bits <= 64:
        out = F.shiftrightunsigned(d0, 64 - start - bits)
    else:
        over = start + bits - 64
        out = F.shiftleft(d0, over).bitwiseOR(F.shiftrightunsigned(d1, 64 - over))
    return out.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def meetings(words: DataFrame, tables: int, bits: int) -> DataFrame:
    """Images (qcid, mcid) of each pair of corners of different images, within NEAR and of like surroundings, whose keys meet in a table.

    Distances are taken where keys meet, so that only such pairs leave the join; a pair that
    meets in several tables leaves the first of them.
    """
    starts = [BITS * t // tables for t in range(tables)]
    keys = [F.lit(t << bits).bitwiseOR(_cut(F.col("d0"), F.col("d1"), s, bits)) for t, s in enumerate(starts)]
    corners = words.select("cid", "asked", (F.size("place") < FEW).alias("few"), F.explode(F.arrays_zip(*WORDS)).alias("c")).select("cid", "asked", "few", "c.*")
    slim = lambda asked, p, *more: corners.filter(F.col("asked") == asked).select(*(F.col(c).alias(p + c) for c in ("cid", *WORDS, *more)), F.explode(F.array(*keys)).alias("key"))
    x0, x1, y0, y1 = (F.col("q" + c).bitwiseXOR(F.col("m" + c)) for c in WORDS)
    first = F.coalesce(*(F.when(_cut(x0, x1, s, bits) == 0, F.lit(t)) for t, s in enumerate(starts)))
    apart = F.bit_count(x0) + F.bit_count(x1)
    alike = (F.bit_count(y0) + F.bit_count(y1) <= AROUND) | (apart <= CLOSE) | F.col("mfew")
    both = slim(True, "q").join(slim(False, "m", "few"), "key").filter(apart <= NEAR).filter(alike).filter("qcid <> mcid")
    return both.filter(first == F.shiftright("key", bits)).select("qcid", "mcid")


def consensus(qplace: np.ndarray, mplace: np.ndarray) -> tuple[int, float, float]:
    """(corners, scale, turn) of the similarity transform that most different corner pairs agree on.

    Every two pairs give a transform; of many pairs TRIES transforms at even steps through
    all twos are tried beside those of neighbouring pairs. Ties go to the first.
    """
    q, qt, qs, _ = unpacked(qplace)
    m, mt, ms, grown = unpacked(mplace)
    turn, scale = np.exp(1j * (mt - qt)), qs / ms
    k = len(q)
    twos = k * (k - 1) // 2
    if twos <= TRIES:
        i, j = np.triu_indices(k, 1)
    else:
        step = np.arange(TRIES) * (twos / TRIES)
        i = (step / k).astype(int) % k
        j = step.astype(int) % k
        i, j = np.concatenate([i, np.arange(k - 1)]), np.concatenate([j, np.arange(1, k)])
    far = np.abs(q[i] - q[j]) > 6
    i, j = i[far], j[far]
    if not len(i):
        return 0, 0.0, 0.0
    a = (m[j] - m[i]) / (q[j] - q[i])
    size = np.abs(a)
    fits = lambda x, y: (np.abs(np.angle(x[0] / y[0])) <= TURN_OFF) & (np.abs(np.log(x[1] / y[1])) <= math.log(SCALE_OFF))
    with np.errstate(divide="ignore", invalid="ignore"):
        good = (size > 0.05) & fits((a, size), (turn[i], scale[i])) & fits((a, size), (turn[j], scale[j]))
    i, a = i[good], a[good]
    best = (0, 0.0, 0.0)
    # a corner that is found at several sizes counts once
    qn, mn = (np.unique(np.rint(x.real / 3) + 1j * np.rint(x.imag / 3), return_inverse=True)[1] for x in (q, m))
    for lo in range(0, len(a), 256):
        t = a[lo : lo + 256, None]
        off = np.abs(t * (q - q[i[lo : lo + 256], None]) + m[i[lo : lo + 256], None] - m)
        inside = (off <= OFF * grown) & (np.abs(np.angle(t / turn)) <= TURN_OFF) & (np.abs(np.log(np.abs(t) / scale)) <= math.log(SCALE_OFF))
        for h in np.argsort(-inside.sum(axis=1), kind="stable")[:3]:
            n = min(len(np.unique(qn[inside[h]])), len(np.unique(mn[inside[h]])))
            if n > best[0]:
                best = (n, float(np.abs(t[h, 0])), float(np.angle(t[h, 0])))
    return best


def compared(query: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> tuple[int, float, float]:
    """The consensus of two images, given as (places, first words, second words)."""
    off = sum(np.bitwise_count((query[k][:, None] ^ other[k][None, :]).view(np.uint64)).astype(np.uint8) for k in (1, 2))
    i, j = np.nonzero(off <= DISTANCE)
    return consensus(query[0][i], other[0][j])


def _agree(batches: Iterator[pa.RecordBatch], agree: int) -> Iterator[pa.RecordBatch]:
    """Rows of two images' corners: a row for each pair that matches."""
    for batch in batches:
        lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(p + n) for p in "qm" for n in ("place", "d0", "d1"))]
        out = []
        for k, (q, m) in enumerate(zip(batch.column("qcid").to_pylist(), batch.column("mcid").to_pylist())):
            parts = [values[at[k] : at[k + 1]] for at, values in lists]
            n, scale, turn = compared(tuple(parts[:3]), tuple(parts[3:]))
            if n >= agree:
                out.append((q, m, n, scale, turn))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.float64()) for c in cols[3:])], names=["qcid", "mcid", "inliers", "scale", "turn"])


def matches(words: DataFrame, agree: int = AGREE) -> DataFrame:
    """Image pairs (qcid, mcid, inliers, scale, turn) out of described classes (one row an image and side)."""
    corners = words.filter("not asked").agg(F.sum(F.size("place"))).first()[0] or 0
    some = meetings(words, *table_sizes(corners)).distinct()
    side = lambda asked, p: words.filter(F.col("asked") == asked).select(F.col("cid").alias(p + "cid"), *(F.col(c).alias(p + c) for c in ("place", "d0", "d1")))
    both = some.join(side(False, "m"), "mcid").join(side(True, "q"), "qcid")
    return both.mapInArrow(partial(_agree, agree=agree), "qcid long, mcid long, inliers long, scale double, turn double")


def find_copies(images: DataFrame, every: int = 20, agree: int = AGREE) -> DataFrame:
    """Copies, crops and edits of the query images among all images.

    images: media_id long, height int, width int, pixels binary (grey, row by row); other
    columns are ignored. Queries are the rows whose media_id is divisible by `every`.
    Returns a row per query and matching class of equal images: media_id, match_id (the
    smallest media_id of the class), copies (its images), inliers (corners that agree on
    the transform; null for the query's own class, returned where it holds other images),
    scale and turn (of the match against the query, radians). Null pixels, or pixels that do
    not fill height x width, match nothing; a flat image has no corners and matches its exact
    copies alone; images of any size are described whole, with more corners; repeated rows
    are copies; a media_id with several pictures asks for each; a null media_id asks nothing
    and names no class; of equally good transforms the first counts. No rows give no rows.
    """
    whole = whole_images(images)
    digest = materialise(whole.select("media_id", "digest"), "digests")
    asks = (F.pmod("media_id", F.lit(every)) == 0).alias("asks")
    classes = digest.groupBy("digest").agg(F.min("media_id").alias("rep"), F.count("*").alias("copies"), F.bool_or(asks).alias("asked"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "image-classes")
    # One image of each class is described; its row is found by id and digest.
    firsts = classes.select(F.col("rep").alias("media_id"), "digest", "cid", "asked")
    if firsts.count() <= BROADCAST_IDS:
        firsts = F.broadcast(firsts)
    words = whole.join(firsts, ["media_id", "digest"]).select("cid", "height", "width", "pixels", "asked").mapInArrow(_describe, DESCRIBED)
    if not digest.groupBy("media_id", "digest").count().filter("count > 1").isEmpty():
        words = words.dropDuplicates(["cid", "asked"])
    found = matches(materialise(words, "descriptors"), agree)
    wanted = digest.filter(F.pmod("media_id", F.lit(every)) == 0).distinct().join(classes, "digest").select("media_id", "cid", F.col("rep").alias("own"), F.col("copies").alias("own_copies"))
    theirs = classes.select(F.col("cid").alias("mcid"), F.col("rep").alias("match_id"), "copies")
    near = wanted.join(found, F.col("cid") == F.col("qcid")).join(theirs, "mcid").select("media_id", "match_id", "copies", "inliers", F.round("scale", 3).alias("scale"), F.round("turn", 3).alias("turn"))
    same = wanted.filter("own_copies > 1").select("media_id", F.col("own").alias("match_id"), F.col("own_copies").alias("copies"), F.lit(None).cast("long").alias("inliers"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("turn"))
    return near.unionByName(same)


SIDE, GRID = 96, 24


@lru_cache(4)
def _field(dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dimensions)).normal(0, 1, (GRID * GRID, dimensions)).astype(np.float32)


def render(vector: np.ndarray, edit: int) -> np.ndarray:
    """A grey image of a vector: a smooth random field that follows it continuously; edit 1 crops it, 2 repaints it, 3 shrinks it."""
    v = np.nan_to_num(np.asarray(vector, np.float32))
    grid = np.tanh(1.5 * (_field(max(1, len(v))) @ (v / max(1e-6, float(np.linalg.norm(v)))))) if len(v) else np.zeros(GRID * GRID)
    image = np.rint(127.5 + 120 * resized(grid.reshape(GRID, GRID), SIDE, SIDE)).astype(np.uint8)
    if edit == 1:
        return image[12:84, 8:88]
    if edit == 2:
        out = np.clip(image.astype(np.float32) * 0.8 + 30, 0, 255).astype(np.uint8)
        out[70:90, 4:36] = 255
        return out
    if edit == 3:
        return np.rint(resized(image.astype(np.float32), int(SIDE * 0.75), int(SIDE * 0.75))).astype(np.uint8)
    return image


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            images = [render(np.array(v or [], np.float32), e) for v, e in zip(part.column("embedding").to_pylist(), part.column("edit").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array([i.shape[0] for i in images], pa.int32()), pa.array([i.shape[1] for i in images], pa.int32()), pa.array([i.tobytes() for i in images], pa.binary())], names=["media_id", "height", "width", "pixels"])


def rendered(embeddings: DataFrame) -> DataFrame:
    """Images of all vectors of a table: media_id, height, width, pixels.

    Every vec_id's image follows its own vector, but those that leave 7, 9 or 11 when
    divided by 20 are a crop, a repainted or a shrunk copy of the image of the vec_id
    divisible by 20 below them, where there is one.
    """
    rest = F.pmod("vec_id", F.lit(20))
    edit = F.when(rest == 7, 1).when(rest == 9, 2).when(rest == 11, 3).otherwise(0)
    own = embeddings.select(F.col("vec_id").cast("long").alias("media_id"), edit.alias("edit"), (F.col("vec_id") - F.when(edit > 0, rest).otherwise(0)).cast("long").alias("source"), "embedding")
    sources = embeddings.filter(F.pmod("vec_id", F.lit(20)) == 0).groupBy(F.col("vec_id").cast("long").alias("source")).agg(F.min("embedding").alias("theirs"))
    return own.join(sources, "source", "left").select("media_id", F.when(F.col("theirs").isNotNull(), F.col("edit")).otherwise(0).alias("edit"), F.when(F.col("edit") > 0, F.coalesce("theirs", "embedding")).otherwise(F.col("embedding")).alias("embedding")).mapInArrow(_render, "media_id long, height int, width int, pixels binary")
