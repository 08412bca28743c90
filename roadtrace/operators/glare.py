"""Glare in night frames: bright blobs in the lower third of a vehicle's box, judged a block of frames at a time.

Pixels stay in Arrow's buffers and where their frames lie: what leaves a night frame is the
mask of its bright colourless pixels, one bit each, in the rows that have any. The masks in a
block's boxes are laid below each other in one array and labelled together: runs of a row join those they touch in the row above, and
labels settle by minimum and pointer jumps over all runs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A frame is of the night up to this mean brightness; a blob's pixels are at least so bright and at most so coloured.
NIGHT, V_MIN, S_MAX = 70, 240, 40
#: Area of a blob; one blob alone needs BIG times as much.
AREA, BIG = 80, 3
#: Pixels of the masks that are labelled together.
BLOCK = 1 << 22


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches along the edges a - b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return root
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def labels(mask: np.ndarray, corners: bool) -> np.ndarray:
    """A number for each connected area of a mask, 0 outside; with corners, pixels also touch at corners."""
    height, width = mask.shape
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    # Rows lie behind each other on one line, far enough apart not to touch.
    pitch, reach = width + 4, 1 if corners else 0
    begin, stop = row * pitch + start, row * pitch + end
    lo = np.searchsorted(stop, begin - pitch - reach, "right")
    hi = np.searchsorted(begin, stop - pitch + reach, "left")
    count = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(row)), count)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    root = _roots(len(row), below, above)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(root + 1, end - start)
    return out


def blob_areas(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Areas inside the outlines of a mask's 8-connected blobs, holes included, and each blob's first row.

    An outline runs through the centres of the outer pixels: four neighbouring pixels of a
    blob enclose an area of 1, three of them a half.
    """
    outside = labels(~np.pad(mask, 1), corners=False)
    label = labels(outside != outside[0, 0], corners=True)
    corner = np.stack([label[:-1, :-1], label[:-1, 1:], label[1:, :-1], label[1:, 1:]])
    owner = corner.max(axis=0)
    four = (corner == owner).sum(axis=0)
    names, first = np.unique(label, return_index=True)
    some = names > 0
    area = np.bincount(owner.ravel(), np.where(four == 4, 1.0, np.where(four == 3, 0.5, 0.0)).ravel(), int(label.max()) + 1)
    return area[names[some]], first[some] // label.shape[1] - 1


def is_night(image: np.ndarray, night: float = NIGHT) -> bool:
    """Whether the mean of the pixels' brightest channels is at most `night`.

    A pixel's brightest channel lies between a third of the sum of its channels and that sum,
    so most frames are told by one sum of their bytes.
    """
    total, most = int(image.sum(dtype=np.int64)), night * image.shape[0] * image.shape[1]
    if total <= most or total > 3 * most:
        return total <= most
    v = np.maximum(np.maximum(image[..., 0], image[..., 1]), image[..., 2])
    return int(v.sum(dtype=np.int64)) <= night * v.size


def shining(image: np.ndarray) -> tuple[int, np.ndarray] | None:
    """Where an image has bright colourless pixels: the first row that may have one, and the mask of the rows from there to the last; None for fewer than AREA of them."""
    rows = np.flatnonzero(image.reshape(image.shape[0], -1).max(axis=1) >= V_MIN)
    if not len(rows):
        return None
    part = image[rows[0] : rows[-1] + 1]
    v = np.maximum(np.maximum(part[..., 0], part[..., 1]), part[..., 2])
    shine = v >= V_MIN
    if shine.sum() < AREA:
        return None
    low = np.minimum(np.minimum(part[..., 0], part[..., 1]), part[..., 2])
    v = v.astype(np.int32)
    shine &= 255 * (v - low) // np.maximum(v, 1) <= S_MAX
    return (int(rows[0]), shine) if shine.sum() >= AREA else None


def bright(top: int, shine: np.ndarray, height: int, box: tuple) -> np.ndarray | None:
    """What of an image's mask, which begins at row `top`, lies in the lower third of a box; None where it has too few pixels."""
    x1, y1, x2, y2 = max(0, int(box[0])), max(0, int(box[1])), min(shine.shape[1], int(box[2])), min(height, int(box[3]))
    if x2 <= x1 or y2 <= y1:
        return None
    mask = shine[max(0, y1 + 2 * (y2 - y1) // 3 - top) : max(0, y2 - top), x1:x2]
    return mask if mask.sum() >= AREA else None


def glaring(masks: list[np.ndarray]) -> np.ndarray:
    """Of each mask, whether it has two blobs of AREA, or one of BIG times as much."""
    out, at = np.zeros(len(masks), bool), 0
    while at < len(masks):
        width, rows, to = 0, 0, at
        while to < len(masks) and (to == at or (rows + len(masks[to]) + 2) * max(width, masks[to].shape[1]) <= BLOCK):
            width, rows, to = max(width, masks[to].shape[1]), rows + len(masks[to]) + 2, to + 1
        tall, begin = np.zeros((rows, width), bool), []
        for m in masks[at:to]:
            begin.append(begin[-1] + len(last) + 2 if begin else 0)
            tall[begin[-1] : begin[-1] + len(m), : m.shape[1]] = m
            last = m
        area, first = blob_areas(tall)
        owner = np.searchsorted(begin, first[area >= AREA], "right") - 1
        area = area[area >= AREA]
        count = np.bincount(owner, minlength=to - at)
        most = np.zeros(to - at)
        np.maximum.at(most, owner, area)
        out[at:to] = (count >= 2) | ((count == 1) & (most >= BIG * AREA))
        at = to
    return out


def lit_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """video_id, frame_no, height, width, bgr -> those of the night that shine, with `top` and packed `bits` of their mask in place of their pixels.

    Frames without pixels, or with other than their size says, show nothing.
    """
    for batch in batches:
        height, width = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width"))
        pixels, at, top, bits = batch.column("bgr"), [], [], []
        for k in range(batch.num_rows):
            raw = pixels[k].as_buffer()
            if raw is None or not len(raw) == height[k] * width[k] * 3 > 0:
                continue
            image = np.frombuffer(raw, np.uint8).reshape(int(height[k]), int(width[k]), 3)
            if is_night(image) and (found := shining(image)) is not None:
                at.append(k)
                top.append(found[0])
                bits.append(np.packbits(found[1], axis=1).tobytes())
        some = batch.select(["video_id", "frame_no", "height", "width"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(top, pa.int32()), pa.array(bits, pa.binary())], names=["video_id", "frame_no", "height", "width", "top", "bits"])


def judge_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """video_id, frame_no, height, width, top, bits, boxes -> the (video_id, track_id, frame_no) that glare."""
    for batch in batches:
        masks, owners = [], []
        for r in batch.to_pylist():
            shine = np.unpackbits(np.frombuffer(r["bits"], np.uint8).reshape(-1, -(-r["width"] // 8)), axis=1, count=r["width"]).astype(bool)
            for b in r["boxes"]:
                mask = bright(r["top"], shine, r["height"], (b["bbox_x1"], b["bbox_y1"], b["bbox_x2"], b["bbox_y2"]))
                if mask is not None:
                    masks.append(mask)
                    owners.append((r["video_id"], b["track_id"], r["frame_no"]))
        shown = [o for o, yes in zip(owners, glaring(masks)) if yes]
        cols = list(zip(*shown)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int32)) for c in cols], names=["video_id", "track_id", "frame_no"])
