"""Copies of images by local descriptors: cropped, brightened, rotated or re-encoded ones share corners.

* Corners: Harris response at several scales, local maxima, the strongest ``most_corners`` of an image (a budget of the
  feature, by response and place: more corners make chance agreements of unlike images more frequent than they find copies). Every corner has an angle (intensity centroid of its patch).
* Descriptors: 256 brightness tests between points of the smoothed patch, turned by the corner's angle.
* Hamming tables: the bits are cut into bands; a query descriptor and a stored one are compared in full when a band agrees but for one bit.
  The query set is taken in blocks of bounded size, each a hash table that is sent to all tasks and probed by all stored
  descriptors, so neither side is shuffled and no pairs are made but those whose bands agree.
* Consensus: every matching pair of corners proposes a similarity transform (turn, scale, shift); a copy needs ``least``
  corners, of different places on both sides, that agree with one.

Corners of a copy differ in up to ``most_bits`` bits, so that a pair may agree in no band; an image needs six corners. A test holds
the tables to 95 % of the copies that comparing every pair of corners finds, each edit by itself: turned, cropped (to half the side,
too), darkened, noisy, shrunk (to half, too), quantised. Why 40 bits and these levels, on test images (96 x 96): of 50 copies cropped to half
the side 37 are found, of 50 shrunk to half 50, and 2 of 2450 pairs of unlike images; with the levels 1, 1.5, 2.25 it was 38, 21 and none,
and with 48 bits 254 of 3540 unlike pairs had a consensus.

Images are binary portable graymaps (P5); null, broken, empty or flat images have no corners and match nothing, and so do rows
without an id. Of rows that share an id the best match counts, once for each pair. Ties keep the earliest corner in reading order.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import in_batches, stored

SCALES = (1.0, 1.5, 2.0)  # an image of half the size has its first level where the whole one has its last
RADIUS = 9
BANDS, BAND_BITS = 12, 21
_FLIPS = np.r_[0, 1 << np.arange(BAND_BITS)].astype(np.int32)
_rng = np.random.default_rng(11)
_TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (256, 4)), -RADIUS + 1, RADIUS - 1)
_YY, _XX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_YY**2 + _XX**2 <= RADIUS**2).astype(np.float32)


def to_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels as floats; None for what is no 8-bit graymap."""
    try:
        magic, w, h, top, rest = bytes(data).split(None, 3)[0], *map(int, bytes(data).split(None, 4)[1:4]), None
        if magic != b"P5" or top != 255 or w * h == 0:
            return None
        head = len(bytes(data)) - w * h
        return np.frombuffer(data, np.uint8, w * h, head).reshape(h, w).astype(np.float32) if head > 0 else None
    except (ValueError, TypeError, IndexError):
        return None


def _smooth(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)^2 windows, edges repeated."""
    p = np.pad(x, r, mode="edge").cumsum(0, dtype=np.float64).cumsum(1)
    p = np.pad(p, ((1, 0), (1, 0)))
    k = 2 * r + 1
    return ((p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)).astype(np.float32)


def _shrunk(x: np.ndarray, by: float) -> np.ndarray:
    if by == 1:
        return x
    h, w = int(x.shape[0] / by), int(x.shape[1] / by)
    y, z = (np.arange(h) + 0.5) * by - 0.5, (np.arange(w) + 0.5) * by - 0.5
    y, z = np.clip(y, 0, x.shape[0] - 1), np.clip(z, 0, x.shape[1] - 1)
    a, b = np.minimum(y.astype(int), x.shape[0] - 2), np.minimum(z.astype(int), x.shape[1] - 2)
    fy, fz = (y - a)[:, None], (z - b)[None]
    x = _smooth(x, 1) if by > 1.6 else x
    return (x[a][:, b] * (1 - fy) * (1 - fz) + x[a + 1][:, b] * fy * (1 - fz) + x[a][:, b + 1] * (1 - fy) * fz + x[a + 1][:, b + 1] * fy * fz).astype(np.float32)


def describe(pixels: np.ndarray, most_corners: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(x, y, scale, angle) and 32 descriptor bytes of each corner."""
    places, bits = [], []
    for scale in SCALES:
        if min(pixels.shape) / scale < 2 * RADIUS + 4:
            break
        x = _shrunk(pixels, scale)
        gy, gx = np.gradient(x)
        a, b, c = _smooth(gx * gx, 2), _smooth(gy * gy, 2), _smooth(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        m = r[RADIUS:-RADIUS, RADIUS:-RADIUS]
        peak = np.ones(m.shape, bool)
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dy or dx:
                    n = r[RADIUS + dy : r.shape[0] - RADIUS + dy, RADIUS + dx : r.shape[1] - RADIUS + dx]
                    peak &= (m > n) if (dy, dx) < (0, 0) else (m >= n)
        ys, xs = np.nonzero(peak & (m > 50))
        if not len(ys):
            continue
        top = np.argsort(-m[ys, xs], kind="stable")[:most_corners]
        strength, ys, xs = m[ys, xs][top], ys[top] + RADIUS, xs[top] + RADIUS
        soft = _smooth(x, 1)
        patch = x[ys[:, None, None] + _YY, xs[:, None, None] + _XX] * _DISC
        angle = np.arctan2((patch * _YY).sum((1, 2)), (patch * _XX).sum((1, 2)))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def at(tx, ty, soft=soft, cos=cos, sin=sin, xs=xs, ys=ys):
            u = np.rint(xs[:, None] + tx * cos - ty * sin).astype(int)
            v = np.rint(ys[:, None] + tx * sin + ty * cos).astype(int)
            return soft[np.clip(v, 0, soft.shape[0] - 1), np.clip(u, 0, soft.shape[1] - 1)]

        bits.append(np.packbits(at(_TESTS[:, 0], _TESTS[:, 1]) < at(_TESTS[:, 2], _TESTS[:, 3]), axis=1))
        places.append(np.stack([(xs + 0.5) * scale - 0.5, (ys + 0.5) * scale - 0.5, np.full(len(xs), scale), angle, strength], 1))
    if not places:
        return np.zeros((0, 4), np.float32), np.zeros((0, 32), np.uint8)
    p, b = np.concatenate(places), np.concatenate(bits)
    order = np.argsort(-p[:, 4], kind="stable")[:most_corners]
    return p[order, :4].astype(np.float32), b[order]


def descriptors(images: DataFrame, most_corners: int = 60) -> DataFrame:
    """(image_id, corners, codes): 16 bytes of place and 32 bytes of descriptor for each corner, in order."""

    def rows(batches):
        for pdf in batches:
            out = []
            for k, data in zip(pdf["image_id"], pdf["image"], strict=True):
                x = from_pgm(data) if data is not None else None
                if x is not None and min(x.shape) >= 2 * RADIUS + 4:
                    p, b = describe(x, most_corners)
                    if len(p):
                        out.append((k, p.tobytes(), b.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "corners", "codes"])

    return in_batches(images.where("image_id is not null").select("image_id", "image"), rows, "image_id long, corners binary, codes binary")


def _bands(codes: np.ndarray) -> np.ndarray:
    """BANDS numbers of BAND_BITS bits for each descriptor."""
    bits = np.unpackbits(codes, axis=1)[:, : BANDS * BAND_BITS].reshape(len(codes), BANDS, BAND_BITS)
    return bits.astype(np.int32) @ (1 << np.arange(BAND_BITS, dtype=np.int32))


def consensus(q: np.ndarray, t: np.ndarray, slack: float = 3.0) -> tuple[int, tuple[float, float, float, float]]:
    """Most corners (of different places on both sides) that agree with one similarity transform from q to t."""
    best, found = 0, (0.0, 1.0, 0.0, 0.0)
    for k in range(len(q)):
        turn, scale = t[k, 3] - q[k, 3], t[k, 2] / q[k, 2]
        cos, sin = scale * np.cos(turn), scale * np.sin(turn)
        dx, dy = t[k, 0] - (q[k, 0] * cos - q[k, 1] * sin), t[k, 1] - (q[k, 0] * sin + q[k, 1] * cos)
        off = np.hypot(q[:, 0] * cos - q[:, 1] * sin + dx - t[:, 0], q[:, 0] * sin + q[:, 1] * cos + dy - t[:, 1])
        ok = off < slack * max(1.0, scale)
        if ok.sum() <= best:
            continue
        n = min(len(np.unique(np.rint(q[ok, :2] / 2), axis=0)), len(np.unique(np.rint(t[ok, :2] / 2), axis=0)))
        if n > best:
            best, found = n, (float(turn), float(scale), float(dx), float(dy))
    return best, found


def _promising(place: np.ndarray, spots: np.ndarray, size: np.ndarray, least: int, slack: float = 3.0, most: int = 1 << 20) -> np.ndarray:
    """Which groups of matches could reach ``least`` in :func:`consensus`: all transforms of many groups are tried at once.

    The matches of a group are consecutive, ``size`` long. Corners are counted without regard to equal places and with a
    little more slack, so no group that consensus accepts is lost. Groups whose proposals exceed ``most`` are taken as they are.
    """
    out = np.zeros(len(size), bool)
    start = np.cumsum(size) - size
    work = size.astype(np.int64) ** 2
    out[work > most] = True
    rest = np.flatnonzero((work <= most) & (size >= least))
    turn, scale = spots[:, 3] - place[:, 3], spots[:, 2] / place[:, 2]
    cos, sin = scale * np.cos(turn), scale * np.sin(turn)
    dx = spots[:, 0] - (place[:, 0] * cos - place[:, 1] * sin)
    dy = spots[:, 1] - (place[:, 0] * sin + place[:, 1] * cos)
    reach = (slack * np.maximum(1.0, scale)) * 1.001 + 0.01
    chunk = np.cumsum(work[rest]) // most
    for part in np.split(rest, np.flatnonzero(np.diff(chunk)) + 1):
        n = size[part]
        first = np.repeat(start[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # the proposing matches
        m = np.repeat(n, n)
        k = np.repeat(first, m)
        begin = np.cumsum(m) - m
        j = np.repeat(np.repeat(start[part], n), m) + np.arange(len(k)) - np.repeat(begin, m)
        x, y = place[j, 0], place[j, 1]
        off = np.hypot(x * cos[k] - y * sin[k] + dx[k] - spots[j, 0], x * sin[k] + y * cos[k] + dy[k] - spots[j, 1])
        if len(k):
            agree = np.add.reduceat((off < reach[k]).astype(np.int64), begin)
            out[part] = np.maximum.reduceat(agree, np.cumsum(n) - n) >= least
    return out


def find_copies(images: DataFrame, queries: DataFrame, least: int = 6, most_bits: int = 40, block: int = 4096) -> DataFrame:
    """(query_id, image_id, n_matches, n_inliers, turn, scale): images that share ``least`` corners with a query image.

    ``queries`` (image_id) are searched against all ``images`` (image_id, image) but themselves, ``block`` images at a time.
    """
    spark = images.sparkSession
    index = stored(descriptors(images), "image-descriptors")
    asked = index.join(queries.select("image_id").where("image_id is not null").distinct(), "image_id", "left_semi")
    blocks = max(1, -(-asked.count() // block))
    result = None
    for part in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("image_id"), F.lit(blocks)) == part).orderBy("image_id").collect()  # about `block` images
        if not rows:
            continue
        codes = [np.frombuffer(r["codes"], np.uint8).reshape(-1, 32) for r in rows]
        code, owner = np.concatenate(codes), np.repeat(np.arange(len(rows)), [len(c) for c in codes])
        place = np.concatenate([np.frombuffer(r["corners"], np.float32).reshape(-1, 4) for r in rows])
        bands = _bands(code)
        order = np.argsort(bands, axis=0, kind="stable")
        model = spark.sparkContext.broadcast((code, owner, place, np.take_along_axis(bands, order, 0), order, [r["image_id"] for r in rows]))
        found = in_batches(index, lambda it, model=model: _probe(it, model.value, most_bits, least), "query_id long, image_id long, n_matches int, n_inliers int, turn double, scale double")
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "query_id long, image_id long, n_matches int, n_inliers int, turn double, scale double")
    best = result.groupBy("query_id", "image_id").agg(F.max(F.struct("n_inliers", "n_matches", "turn", "scale")).alias("m"))
    return best.select("query_id", "image_id", "m.n_matches", "m.n_inliers", "m.turn", "m.scale")


def _candidates(codes: np.ndarray, table: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(descriptor, band, first, n) of all runs of equal values in the sorted ``table`` that a band of a descriptor meets, as it is
    or with one bit turned; by descriptor."""
    out = []
    bands = _bands(codes)
    for k in range(BANDS):
        value = bands[:, k, None] ^ _FLIPS
        mine, flip = np.nonzero(filled[k][value])
        value = value[mine, flip]
        first = np.searchsorted(table[:, k], value)
        out.append((mine, np.full(len(mine), k), first, np.searchsorted(table[:, k], value, side="right") - first))
    mine, band, first, n = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.argsort(mine, kind="stable")
    return mine[by], band[by], first[by], n[by]


def _probe(batches, model, most_bits: int, least: int, most: int = 1 << 22):
    """Matches of a table of stored images. Candidates are opened in portions of whole images, about ``most`` at a time."""
    code, owner, place, table, order, names = model
    wide, flat = code.view(np.uint64), np.ascontiguousarray(order.T).ravel()
    filled = np.zeros((BANDS, 1 << BAND_BITS), bool)
    for k in range(BANDS):
        filled[k][table[:, k]] = True
    for pdf in batches:
        out = []
        codes = [np.frombuffer(c, np.uint8).reshape(-1, 32) for c in pdf["codes"]]
        for lo in range(0, len(codes), 64):  # bounded runs of images
            c = np.concatenate(codes[lo : lo + 64])
            image = np.repeat(np.arange(lo, min(lo + 64, len(codes))), [len(x) for x in codes[lo : lo + 64]])
            corners = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, 4) for x in pdf["corners"].iloc[lo : lo + 64]])
            mine, band, first, n = _candidates(c, table, filled)
            load = np.bincount(image[mine] - lo, n, minlength=min(64, len(codes) - lo))
            portion = (np.cumsum(load) - load).astype(np.int64) // most
            for part in np.unique(portion):
                at = portion[image[mine] - lo] == part
                for found in _agreeing(c, image, corners, mine[at], flat, band[at] * len(code) + first[at], n[at], wide, owner, place, len(names), most_bits, least):
                    i, q, m, agree, turn, scale = found
                    if names[q] != pdf["image_id"].iloc[i]:
                        out.append((names[q], int(pdf["image_id"].iloc[i]), m, agree, turn, scale))
        yield pd.DataFrame(out, columns=["query_id", "image_id", "n_matches", "n_inliers", "turn", "scale"])


def _close(c: np.ndarray, wide: np.ndarray, mine: np.ndarray, flat: np.ndarray, first: np.ndarray, n: np.ndarray, most_bits: int, some: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (descriptor, stored place) of candidates that differ in ``most_bits`` bits at most, in order.

    Bits are compared word by word, ``some`` candidates at a time, before a pair that several bands propose is told apart: few
    candidates are close, so that only these are sorted.
    """
    here, there = np.ascontiguousarray(c.T), np.ascontiguousarray(wide.T)
    found = [np.zeros(0, np.int64)]
    portion = (np.cumsum(n) - n) // some
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(portion)) + 1):
        k = n[part]
        a = np.repeat(mine[part], k)
        b = flat[np.arange(k.sum()) + np.repeat(first[part] - np.cumsum(k) + k, k)]
        bits = np.zeros(len(a), np.int16)
        for word in range(len(here)):
            bits += np.bitwise_count(here[word][a] ^ there[word][b])
            if word % 2:
                near = bits <= most_bits
                a, b, bits = a[near], b[near], bits[near]
        found.append(a * len(wide) + b)
    hit = np.unique(np.concatenate(found))
    return hit // len(wide), hit % len(wide)


def _agreeing(c, image, corners, mine, flat, first, n, wide, owner, place, queries: int, most_bits: int, least: int):
    """(image, query, matches, agreeing corners, turn, scale) of pairs of images among candidates: ``n`` of ``flat`` from ``first``."""
    mine, theirs = _close(c.view(np.uint64), wide, mine, flat, first, n, most_bits)
    pair = image[mine] * queries + owner[theirs]
    by = np.argsort(pair, kind="stable")
    pair, mine, theirs = pair[by], mine[by], theirs[by]
    pairs, size = np.unique(pair, return_counts=True)
    keep = size >= least
    wanted = np.repeat(keep, size)
    pairs, size, mine, theirs = pairs[keep], size[keep], mine[wanted], theirs[wanted]
    spots, spread = corners[mine], place[theirs]
    start = np.cumsum(size) - size
    for g in np.flatnonzero(_promising(spread, spots, size, least)):
        at = slice(start[g], start[g] + size[g])
        agree, (turn, scale, _, _) = consensus(spread[at], spots[at])
        if agree >= least:
            yield int(pairs[g] // queries), int(pairs[g] % queries), int(size[g]), agree, turn, scale


def _stretched(grid: np.ndarray, size: int) -> np.ndarray:
    """``grid`` drawn out to ``size`` pixels, linear between its points."""
    at = np.linspace(0, len(grid) - 1.001, size)
    k, f = at.astype(int), at - at.astype(int)
    rows = grid[k] * (1 - f)[:, None] + grid[k + 1] * f[:, None]
    return rows[:, k] * (1 - f) + rows[:, k + 1] * f


def rendered(vectors: DataFrame, size: int = 64) -> DataFrame:
    """(image_id, image, made_from): test images from (vec_id, embedding): a field of blobs that the vector seeds.

    Every vector is one image; of every tenth (``vec_id % 10 = 1``) the image is an edited copy of the image of ``vec_id - 1``
    where there is one: cropped, brightened and slightly noisy. Null or empty vectors are null images.
    """
    v = vectors.select("vec_id", "embedding")
    source = v.where("vec_id % 10 = 0").select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    v = v.join(source, "vec_id", "left")

    def draw(values) -> np.ndarray | None:
        e = np.asarray(values if values is not None else [], np.float32)
        if not len(e):
            return None
        rng = np.random.default_rng(crc32(e.tobytes()))
        x = np.full((size, size), 128.0)
        for cells, depth in ((9, 45.0), (18, 35.0)):
            x += depth * _stretched(rng.normal(0, 1, (cells, cells)), size)
        return x

    def images(batches):
        for pdf in batches:
            out = []
            for k, own, other in zip(pdf["vec_id"], pdf["embedding"], pdf["other"], strict=True):
                if other is not None and len(other):
                    x = draw(other)[6:58, 4:60] * 0.85 + 18 + np.random.default_rng(int(k)).normal(0, 1.5, (52, 56))
                    out.append((k, to_pgm(np.clip(np.rint(x), 0, 255)), k - 1))
                else:
                    x = draw(own)
                    out.append((k, None if x is None else to_pgm(np.clip(np.rint(x), 0, 255)), k))
            yield pd.DataFrame(out, columns=["image_id", "image", "made_from"])

    return v.mapInPandas(images, "image_id long, image binary, made_from long")
