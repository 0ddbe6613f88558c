"""Copies of images by local descriptors.

Corners are found at several scales; each gets an orientation (the intensity centroid of its patch) and a binary descriptor:
brightness comparisons of point pairs in the turned patch.  The number of corners grows with the area: CORNERS for each GRID
square of each level, and levels are halved for as long as a patch fits.

Descriptors meet in Hamming tables.  A table joins a drawn set of bits exactly.  The bits of a table grow with the logarithm
of the number of descriptors, so that a descriptor meets about CHANCE unrelated ones in it (how alike those are is measured on
SAMPLE descriptors, the smallest by hash; all are indexed), and there are as many tables as two images that have COMMON corners
in common, with FLIPS of BITS bits flipped in each, need to meet MEETINGS times with probability FIND.

Every image is first compared with a leader of its entries alone, in several turns; of images that are then still apart, pairs that meet
MEETINGS times are compared.  A comparison matches all descriptors of the two within DISTANCE; matches vote for the turn,
scale and shift between the images, and images with enough votes in one bin are copies: VOTES, and one more for each doubling
of the pairs of descriptors that could match by chance.  Crops, shifts, changes of
brightness and contrast, noise, and halvings in size leave enough corners alone.

Equal images are one class.  Entries with more than ``tile`` images that are apart are split into pairs of leaves over tasks.
Null images, images smaller than a patch and flat images have no corners and only equal copies.  Rows with a null id have
a null component; rows that repeat an id are one image.  An empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, frugal, returned, stored, thinned
from .meeting import KEY_BITS, apart, beside, dealt, followed, shared_keys, tiles
from .tokens import mixed, narrow

RADIUS, CORNERS, GRID, BITS, DISTANCE, VOTES = 16, 24, 64, 128, 28, 3
COMMON, FLIPS, MEETINGS, FIND, CHANCE, SAMPLE, BIN, SEED = 8, 10, 2, 0.95, 0.25, 4096, 6, 10
FEATURES = "media_id bigint, same bigint, n_features bigint, place binary, bits binary"


def _place(level: np.ndarray, x: np.ndarray, y: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Level, half pixels and turn (in 1e-4 radians) of a feature in one number, so that shuffled rows stay narrow."""
    return level << 48 | np.rint(2 * x).astype(np.int64) << 32 | np.rint(2 * y).astype(np.int64) << 16 | np.rint((turn + np.pi) * 1e4).astype(np.int64)


def _places(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 48, (place >> 32 & 0xFFFF) / 2, (place >> 16 & 0xFFFF) / 2, (place & 0xFFFF) / 1e4 - np.pi


def _pattern() -> np.ndarray:
    """Point pairs of the binary tests, drawn once from a seeded normal distribution within the patch.

    Only pairs that lie across the orientation: along it a turned patch is brighter at one end, and tests would be biased.
    """
    draw = np.random.default_rng(5).normal(0, RADIUS / 2, (40 * BITS, 2, 2))
    inside = (np.hypot(draw[..., 0], draw[..., 1]) < RADIUS - 1).all(axis=1)
    along, across = np.abs(draw[:, 0] - draw[:, 1]).T
    return draw[inside & (along < 0.35 * across)][:BITS]


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1, edges repeated."""
    p = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=1).cumsum(axis=2)
    k = 2 * r + 1
    return (p[:, k:, k:] - p[:, :-k, k:] - p[:, k:, :-k] + p[:, :-k, :-k]) / (k * k)


def describe(images: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per image and level, arrays (image, level, x, y, turn, packed bits) of the features of ``images`` (n, height, width)."""
    out, pattern = [], _pattern()
    yy, xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = np.hypot(yy, xx) <= RADIUS
    yy, xx = yy[disc], xx[disc]
    level_image = images.astype(np.float64)
    for level in range(15):
        n, h, w = level_image.shape
        if min(h, w) <= 2 * RADIUS + 2:
            break
        gy, gx = np.zeros_like(level_image), np.zeros_like(level_image)
        gy[:, 1:-1] = level_image[:, 2:] - level_image[:, :-2]
        gx[:, :, 1:-1] = level_image[:, :, 2:] - level_image[:, :, :-2]
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = a * b - c * c - 0.05 * (a + b) ** 2
        peak = strength > np.maximum(1.0, 0.001 * strength.max(axis=(1, 2), keepdims=True))
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if (dy, dx) != (0, 0):
                    peak &= strength >= np.roll(strength, (dy, dx), axis=(1, 2))
        peak[:, : RADIUS + 1], peak[:, -RADIUS - 1 :], peak[:, :, : RADIUS + 1], peak[:, :, -RADIUS - 1 :] = False, False, False, False
        i, y, x = np.nonzero(peak)
        square = (i * (h // GRID + 1) + y // GRID) * (w // GRID + 1) + x // GRID
        order = np.lexsort((-strength[i, y, x], square))
        i, y, x, square = i[order], y[order], x[order], square[order]
        nth = np.arange(len(i)) - np.searchsorted(square, square)
        i, y, x = i[nth < CORNERS], y[nth < CORNERS], x[nth < CORNERS]
        smooth = _box(level_image, 2)
        patch = level_image[i[:, None], y[:, None] + yy, x[:, None] + xx]
        patch -= patch.mean(axis=1, keepdims=True)
        turn = np.arctan2((patch * yy).sum(axis=1), (patch * xx).sum(axis=1))
        cos, sin = np.cos(turn)[:, None], np.sin(turn)[:, None]
        values = []
        for side in (0, 1):
            px, py = pattern[None, :, side, 0], pattern[None, :, side, 1]
            values.append(smooth[i[:, None], y[:, None] + np.rint(sin * px + cos * py).astype(int), x[:, None] + np.rint(cos * px - sin * py).astype(int)])
        bits = np.packbits(values[0] < values[1], axis=1)
        out.append((i, np.full(len(i), level), (x + 0.5) * 2**level, (y + 0.5) * 2**level, turn, bits))
        level_image = level_image[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2).mean(axis=(2, 4))
    return out


def features(media: DataFrame) -> DataFrame:
    """A FEATURES row for each row of ``media (media_id, height, width, pixels)``, grey bytes row by row; ``same`` is equal for
    equal images, and equal images of one batch are described once (the others' features are null)."""

    def run(batches):
        frugal()
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                shapes: dict = {}
                got: dict[int, tuple] = {}
                ids, same = b.column(0).to_pylist(), []
                for j, (m, h, w, p) in enumerate(zip(ids, *(b.column(c).to_pylist() for c in ("height", "width", "pixels")))):
                    known = p is not None and m is not None
                    same.append(xxhash.xxh3_64_intdigest(p, seed=(h or 0) << 32 | (w or 0)) - (1 << 63) if known else None)
                    if known and same[-1] not in got:
                        got[same[-1]] = (j, np.zeros(0, np.int64), np.zeros((0, BITS // 8), np.uint8))
                        if h and w and len(p) == h * w:
                            shapes.setdefault((h, w), []).append((same[-1], p))
                for (h, w), own in shapes.items():
                    step = max(1, (1 << 20) // (h * w))
                    for s in range(0, len(own), step):
                        part = own[s : s + step]
                        found = describe(np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(-1, h, w))
                        image, place, bits = (np.concatenate(x) for x in zip(*((i, _place(level, x, y, turn), bits) for i, level, x, y, turn, bits in found))) if found else ([], [], [])
                        for k, (key, _) in enumerate(part):
                            mine = np.flatnonzero(image == k) if found else []
                            if len(mine):
                                got[key] = (got[key][0], place[mine], bits[mine])
                first = {v[0]: v for v in got.values()}
                rows = [(len(first[j][1]), first[j][1].tobytes(), first[j][2].tobytes()) if j in first else (None, None, None) for j in range(len(ids))]
                n, place, bits = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.int64()), pa.array(n, pa.int64()), pa.array(place, pa.binary()), pa.array(bits, pa.binary())], names=["media_id", "same", "n_features", "place", "bits"])
        returned()

    return media.select(F.col("media_id").cast("long").alias("media_id"), "height", "width", "pixels").mapInArrow(run, FEATURES)


def alike(sample: np.ndarray) -> tuple[float, float]:
    """``(a, b)``: a pair of unrelated descriptors agrees on ``k`` drawn bits with probability about ``2 ** (a - b k)``; ``sample`` is of 0 and 1."""
    rng = np.random.default_rng(SEED)
    x, y = rng.integers(0, max(len(sample), 1), (2, 200_000 if len(sample) else 0))
    differ = (sample[x] != sample[y]).sum(axis=1) if len(sample) else np.zeros(0, int)
    differ = differ[differ > DISTANCE]
    if len(differ) < 1000:
        return 0.0, 1.0
    ks = np.arange(16, 49, 4)
    meet = [np.mean([math.comb(BITS - d, int(k)) / math.comb(BITS, int(k)) if n else 0.0 for d, n in enumerate(np.bincount(differ, minlength=BITS))] @ np.bincount(differ, minlength=BITS)) / len(differ) for k in ks]
    slope, start = np.polyfit(ks, np.log2(np.maximum(meet, 1e-30)), 1)
    return float(start), float(max(-slope, 0.1))


def tables(n: int, sample: np.ndarray | None = None) -> np.ndarray:
    """The bits (table, bit) that the tables for ``n`` descriptors join."""
    a, b = (0.0, 1.0) if sample is None else alike(sample)
    k = int(np.clip(math.ceil((math.log2(max(n, 1) / CHANCE) + a) / b), 8, 60))
    meet = math.comb(BITS - FLIPS, k) / math.comb(BITS, k)
    many = 1
    while sum(math.comb(COMMON * many, m) * meet**m * (1 - meet) ** (COMMON * many - m) for m in range(MEETINGS)) > 1 - FIND:
        many += 1
    rng = np.random.default_rng((SEED, k))
    return np.stack([np.sort(rng.permutation(BITS)[:k]) for _ in range(many)])


def entries(found: DataFrame, bits: np.ndarray) -> DataFrame:
    """``(id, keys)``: for each image the hashed (table, bits of the table) of its descriptors."""
    weight = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                raw = [np.frombuffer(x, np.uint8).reshape(-1, BITS // 8) for x in b.column("bits").to_pylist()]
                on = np.unpackbits(np.concatenate(raw), axis=1).astype(np.uint64)
                keys = np.stack([mixed(on[:, at] @ weight, np.full(len(on), t, np.uint64)) for t, at in enumerate(bits)], axis=1) >> np.uint64(64 - KEY_BITS) & ~np.uint64(3) | np.uint64(2)
                edge = np.cumsum([0] + [len(r) for r in raw])
                yield pa.RecordBatch.from_arrays([b.column("media_id"), pa.array([narrow(keys[s:e].ravel()) for s, e in zip(edge[:-1], edge[1:])], pa.binary())], names=["id", "keys"])

    return found.select("media_id", "bits").mapInArrow(run, "id bigint, keys binary")


def met_pairs(rows: DataFrame, tiled: bool) -> DataFrame:
    """``(a, b, n)``: how often images of different labels meet in the cells of ``rows (cell[, tile, side], id, label)``, summed in runs of rows."""
    order = ["cell", "tile"] if tiled else ["cell"]

    def run(batches):
        held: list = []

        def out(t: pa.Table):
            cell, ids, label = (t.column(c).to_numpy() for c in ("cell", "id", "label"))
            change = cell[1:] != cell[:-1]
            if tiled:
                tile, side = t.column("tile").to_numpy(), t.column("side").to_numpy()
                change |= tile[1:] != tile[:-1]
            group = np.cumsum(np.concatenate([[0], change]))
            size = np.bincount(group)
            start = np.cumsum(size) - size
            left = (start + size)[group] - np.arange(len(cell))  # members from this one to the group's end
            across = np.maximum.reduceat(side, start)[group] > 0 if tiled else None
            i, d, a, b, many = np.arange(len(ids)), 0, [], [], 0
            while True:  # all pairs of every group, by their distance in the order
                d += 1
                i = i[left[i] > d]
                if many > 1_000_000 or many and not len(i):
                    pair = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
                    pair, n = np.unique(pair, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(n)], names=["a", "b", "n"])
                    a, b, many = [], [], 0
                if not len(i):
                    return
                ok = label[i] != label[i + d]
                if tiled:
                    ok &= ~across[i] | (side[i] != side[i + d])
                p, q = ids[i[ok]], ids[i[ok] + d]
                a.append(np.minimum(p, q))
                b.append(np.maximum(p, q))
                many += len(p)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            if t.num_rows < 50_000:
                held.append(batch)
                continue
            cell = t.column("cell").to_numpy()
            last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
            if last:
                yield from out(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    return rows.select(*order, "id", "label", *(["side"] if tiled else [])).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint, n bigint")


def agree(place_a: np.ndarray, bits_a: np.ndarray, place_b: np.ndarray, bits_b: np.ndarray) -> int:
    """The most corners of image a whose matches in b agree on turn, scale and shift."""
    if not len(place_a) or not len(place_b):
        return 0
    i, j = np.nonzero(np.bitwise_count(bits_a[:, None, :] ^ bits_b[None, :, :]).sum(axis=2) <= DISTANCE)
    if not len(i):
        return 0
    (level_a, x_a, y_a, turn_a), (level_b, x_b, y_b, turn_b) = _places(place_a[i]), _places(place_b[j])
    spin = turn_b - turn_a
    scale = 2.0 ** (level_b - level_a)
    cos, sin, unit = np.cos(spin), np.sin(spin), BIN * np.maximum(1, scale)
    sx, sy = (x_b - scale * (cos * x_a - sin * y_a)) / unit, (y_b - scale * (sin * x_a + cos * y_a)) / unit
    steps = np.rint(np.arctan2(sin, cos) / (np.pi / 12))  # turns of 15 degrees, two of them a bin
    best = 0
    for half in (0, 1):  # bins and bins shifted by half a bin, so that a true shift is not cut in two
        for odd in (0, 1):
            code = ((((level_b - level_a + 16) * 64 + np.floor((steps + odd) / 2).astype(np.int64) % 12) << 16) + np.floor(sx + half / 2).astype(np.int64) + (1 << 15) << 16) + np.floor(sy + half / 2).astype(np.int64) + (1 << 15)
            spots = np.unique(np.stack([code, place_a[i] & 0xFFFFFFFF0000], axis=1), axis=0)
            best = max(best, int(np.unique(spots[:, 0], return_counts=True)[1].max()))
    return best


def needed(n_a: int, n_b: int, votes: int) -> int:
    return votes + max(0, (n_a * n_b // 1024).bit_length() - 1)


def agreed(reps: DataFrame, pairs: DataFrame, votes: int) -> DataFrame:
    """The copies ``(a, b)`` among pairs of images."""

    def run(batches):
        frugal()
        place, head = None, None
        for batch in batches:
            out = []
            for key, salt, tail, one, spots, bits in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "tail", "id", "place", "bits"))):
                mine = np.frombuffer(spots, np.int64), np.frombuffer(bits, np.uint64).reshape(-1, BITS // 64)
                if not tail:
                    place, head = (key, salt), mine
                elif place == (key, salt) and agree(*head, *mine) >= needed(len(head[0]), len(mine[0]), votes):
                    out.append((key, one))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
        returned()

    return beside(dealt(pairs).join(reps.select(F.col("media_id").alias("id"), "place", "bits"), "id")).mapInArrow(run, "a bigint, b bigint")


def near_leaders(own: DataFrame, members: DataFrame, votes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies ``(a, b)`` among images and leaders of their entries, found in turns, and what ``apart`` then leaves of the entries.

    A turn compares each image with one leader that it isn't linked with; turns end when one adds less than a fiftieth to the links.
    So of a group of copies each image is compared a few times, and what is still apart is left to be paired.
    """
    spark = own.sparkSession
    near, labels = spark.createDataFrame([], "a bigint, b bigint"), spark.createDataFrame([], "id bigint, label bigint")
    total, turn = 0, 0
    while True:
        few, many = (stored(x, "media-apart") for x in apart(members, labels))
        fresh = stored(agreed(own, stored(followed(few, many, turn, MEETINGS), "media-led"), votes), "media-near")
        found = fresh.count()
        if not found:
            return near, few, many
        near, total, turn = near.union(fresh), total + found, turn + 1
        labels = stored(components(near).select("id", F.col("component_id").alias("label")), "media-labels")
        if found * 50 < total:
            return near, *(stored(x, "media-apart") for x in apart(members, labels))


def copies(media: DataFrame, votes: int = VOTES, tile: int = 1024) -> DataFrame:
    """``(media_id, n_features, component_id, kept)`` for every row of ``media``."""
    found = stored(features(media), "media-features")
    reps = found.where("same is not null").groupBy("same").agg(F.min("media_id").alias("media_id"), F.count("*").alias("copies"), *(F.first(c, ignorenulls=True).alias(c) for c in ("n_features", "place", "bits")))
    reps = stored(reps, "media-reps")
    # of different images that share an id, the one with the most corners stands for it
    own = reps.where("n_features > 0").groupBy("media_id").agg(F.max(F.struct("n_features", "same", "place", "bits")).alias("r")).select("media_id", "r.n_features", "r.place", "r.bits")
    own = stored(own, "media-own")
    n = own.select(F.sum("n_features")).first()[0] or 0
    sample = own.select(F.expr("substring(bits, 1, 16)").alias("bits")).orderBy(F.xxhash64("media_id")).limit(SAMPLE).collect()
    bits = tables(n, np.unpackbits(np.array([list(r.bits) for r in sample], np.uint8).reshape(-1, BITS // 8), axis=1))
    members = stored(shared_keys(entries(own, bits), n * len(bits), tile), "media-members")
    near, few, many = near_leaders(own, members, votes)
    met = met_pairs(few, False).union(met_pairs(tiles(many, tile), True))
    far = agreed(own, stored(met.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= MEETINGS).select("a", "b"), "media-pairs"), votes)
    linked = components(thinned(near.union(far)))
    r = reps.join(linked.withColumnRenamed("id", "media_id"), "media_id", "left")
    spread = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
    told = r.select("same", F.col("n_features"), F.coalesce("component_id", "media_id").alias("component_id"), spread)
    out = found.select("media_id", "same", F.pmod(F.xxhash64("media_id"), F.lit(16)).cast("int").alias("salt")).join(told, ["same", "salt"], "left")
    component = F.coalesce("component_id", "media_id")
    return out.select("media_id", F.coalesce("n_features", F.lit(0)).cast("long").alias("n_features"), component.alias("component_id"), F.coalesce(component == F.col("media_id"), F.lit(True)).alias("kept"))


def _textures(dims: int, side: int) -> np.ndarray:
    """A seeded smooth texture of unit variance for each component."""
    out = np.empty((dims, side * side), np.float32)
    for i in range(dims):
        cells = np.random.default_rng((SEED, i)).standard_normal((side // 3 + 1, side // 3 + 1))
        t = _box(np.kron(cells, np.ones((3, 3)))[None, :side, :side], 1)[0]
        out[i] = ((t - t.mean()) / t.std()).ravel()
    return out


def rendered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", side: int = 96, frame: int = 84) -> DataFrame:
    """Images derived from vectors: the sum of a seeded texture for each component, seen through a window whose place, brightness
    and contrast hang on the row's id, so that close vectors are cropped and edited copies of each other."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                out = []
                for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if v is None or i is None or not len(v) or None in v:
                        out.append(None)
                        continue
                    x = np.nan_to_num(np.array(v, np.float64), posinf=0, neginf=0)
                    if len(x) not in known:
                        known[len(x)] = _textures(len(x), side)
                    board = np.tanh((x / max(np.linalg.norm(x), 1e-9)).astype(np.float32) @ known[len(x)]).reshape(side, side)
                    h = (i * 2654435761) % (1 << 32)
                    top, left = h % (side - frame + 1), (h >> 8) % (side - frame + 1)
                    view = board[top : top + frame, left : left + frame]
                    out.append(np.clip(128 + 90 * view * (0.8 + (h >> 16) % 32 / 80) + (h >> 24) % 24 - 12, 0, 255).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([None if o is None else f(o) for o in out], k) for f, k in ((lambda o: o.shape[0], pa.int64()), (lambda o: o.shape[1], pa.int64()), (lambda o: o.tobytes(), pa.binary())))], names=["media_id", "height", "width", "pixels"])

    return vectors.select(F.col(id_col).cast("long").alias("media_id"), vec_col).mapInArrow(run, "media_id bigint, height bigint, width bigint, pixels binary")
