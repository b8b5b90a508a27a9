"""Media columns: chroma audio fingerprints and their alignment.

Sound is cut into frames, each frame's spectrum folded into twelve pitch classes and smoothed over
time. On the integral image of frames by classes, 16 rectangle filters each give two bits: a packed
32-bit number for each position. Recordings are aligned by offset: the bits that differ at each
difference of positions decide. Blocks of recordings are compared at once, by products of matrices:
first along few directions, which never makes a distance larger, then by all bits of the pairs that
are left, so no pair within the bound is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, save

RATE = 8000
FRAME, HOP = 2048, 512
#: Width in frames of the widest filter; a recording of fewer frames has no fingerprint.
WIDTH = 8
#: Share of differing bits up to which two recordings are taken for the same.
MOST_ERRORS = 0.15
#: Positions that must overlap.
LEAST_OVERLAP = 16
#: Recordings and positions of a block at most; a recording of more positions is a block of its own.
BLOCK, BLOCK_SPOTS = 512, 1 << 15
#: The bound on two recordings' distance: positions that are taken together, the directions kept of their 32 bits
#: each, and how many runs of positions the directions are fitted to; the share of pairs left from which all bits are compared.
POOL, AXES, FITTED, DENSE = 4, 32, 8192, 1 / 16
_LEVELS = np.array([-0.12, 0.0, 0.12])
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _filters():
    """(kind, first class, classes, frames): sixteen, from coarse to fine."""
    return [(kind, low, high, wide) for wide, kinds in ((8, (0, 1)), (6, (2, 3)), (4, (0, 2)), (3, (1, 4))) for kind in kinds for low, high in ((0, 12), (3, 8))]


_WINDOW = np.hanning(FRAME).astype(np.float32)
_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_LOW, _HIGH = int(np.searchsorted(_HZ, 55)), int(np.searchsorted(_HZ, 2200, "right"))
_FOLD = np.zeros((_HIGH - _LOW, 12), np.float32)
_FOLD[np.arange(_HIGH - _LOW), np.round(12 * np.log2(_HZ[_LOW:_HIGH] / 440)).astype(int) % 12] = 1


def _chroma(pcm: np.ndarray) -> np.ndarray:
    """Frames x pitch classes of one recording, in blocks of frames."""
    n = max(0, (len(pcm) - FRAME) // HOP + 1)
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP] if n else ()
    image = np.zeros((n, 12))
    for at in range(0, n, 1024):
        wave = np.fft.rfft(frames[at : at + 1024] * _WINDOW, axis=1)[:, _LOW:_HIGH]
        image[at : at + 1024] = (wave.real**2 + wave.imag**2) @ _FOLD
    return image


def _prints(images: np.ndarray) -> np.ndarray:
    """Recordings x positions of packed numbers, of images (recordings x frames x classes) of one length.

    Each step treats a recording by itself, so its prints don't depend on which others are beside it.
    """
    count, frames, _ = images.shape
    n = frames - WIDTH + 1
    if n < 1 or not count:
        return np.zeros((count, 0), np.uint32)
    around = np.zeros((count, frames + 4, 12))
    around[:, 2:-2] = images
    smooth = sum(w * around[:, i : i + frames] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    smooth /= np.maximum(np.sqrt((smooth**2).sum(2, keepdims=True)), 1e-9)
    total = np.zeros((count, frames + 1, 13))
    total[:, 1:, 1:] = smooth.cumsum(1).cumsum(2)

    def area(x0, x1, y0, y1):
        return total[:, x1 : x1 + n, y1] - total[:, x0 : x0 + n, y1] - total[:, x1 : x1 + n, y0] + total[:, x0 : x0 + n, y0]

    out = np.zeros((count, n), np.uint32)
    for kind, y0, high, wide in _filters():
        y1 = min(12, y0 + high)
        ym, xm = (y0 + y1) // 2, wide // 2
        third = max(1, (y1 - y0) // 3)
        whole = area(0, wide, y0, y1)
        if kind == 0:
            a = area(0, wide, ym, y1)
        elif kind == 1:
            a = area(0, xm, y0, y1) * wide / (2 * xm)
        elif kind == 2:
            a = area(0, xm, ym, y1) + area(xm, wide, y0, ym)
        elif kind == 3:
            a = area(0, wide, y0 + third, y1 - third) * (y1 - y0) / (2 * max(1, y1 - y0 - 2 * third))
        else:
            a = area(wide // 3, wide - wide // 3, y0, y1) * wide / (2 * max(1, wide - 2 * (wide // 3)))
        ratio = (a + 0.01) / np.maximum(whole - a + 0.01, 0.01)
        level = sum((ratio > edge).astype(np.uint32) for edge in np.exp(_LEVELS))
        out = (out << np.uint32(2)) | _GRAY[level]
    return out


def _sound(pcm) -> np.ndarray:
    """Samples in single precision, empty for null and for silence; what is no finite number is 0."""
    if pcm is None or not len(pcm):
        return np.zeros(0, np.float32)
    pcm = np.nan_to_num(np.asarray(pcm, np.float32), posinf=0, neginf=0)
    return pcm if np.any(pcm) else pcm[:0]


def fingerprints_of(sounds: list[np.ndarray]) -> list[np.ndarray]:
    """Unsigned 32-bit numbers, one a position, for each sound; recordings of one length go through the filters together."""
    images = [_chroma(_sound(s)) for s in sounds]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(sounds)
    by: dict[int, list[int]] = {}
    for i, image in enumerate(images):
        by.setdefault(len(image), []).append(i)
    for some in by.values():
        for i, own in zip(some, _prints(np.stack([images[i] for i in some]))):
            out[i] = own
    return out


def fingerprint(pcm: np.ndarray | None) -> np.ndarray:
    """Unsigned 32-bit numbers, one a position; none for null, silence or too short sound."""
    return fingerprints_of([pcm])[0]


def _fingerprinted(rows: DataFrame, key: str, value: str, sound) -> DataFrame:
    """key and prints (array<long>, each of 32 bits) of every row, whose sound is sound(value, numbers not null)."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                values = part.column(1)
                ends = [0, *np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)).tolist()]
                flat = np.asarray(pc.fill_null(values.flatten(), 0).to_numpy(zero_copy_only=False), float)
                found = fingerprints_of([sound(flat[x:y]) for x, y in zip(ends[:-1], ends[1:])])
                sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
                prints = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), prints], ["key", "prints"])

    return in_arrow(rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")), run, f"key {kind}, prints array<long>").withColumnRenamed("key", key)


def fingerprints(media: DataFrame, key: str, pcm: str) -> DataFrame:
    """key and prints (array<long>, each of 32 bits) of every row; pcm: array of numbers at RATE a second.

    Null, empty, silent and too short recordings have none; null samples are 0. Repeated rows are
    fingerprinted each; a very long recording is gone through in blocks of frames; an empty table
    gives an empty one; media's other columns don't matter.
    """
    return _fingerprinted(media, key, pcm, lambda samples: samples)


def tune(vector: np.ndarray | None, note: int = 512) -> np.ndarray:
    """A melody of a vector: each value a note over three octaves with two overtones."""
    v = np.zeros(0) if vector is None else np.nan_to_num(np.asarray([x or 0 for x in vector] if isinstance(vector, list) else vector, float), posinf=0, neginf=0)
    if not len(v):
        return np.zeros(0, np.float32)
    pitch = 220 * 2 ** (np.clip(np.round(v * 16), -12, 24) / 12)
    once = np.exp(1j * (2 * np.pi * np.cumsum(np.repeat(pitch, note)) / RATE))
    twice = once * once
    return (once.imag + 0.5 * twice.imag + 0.25 * (twice * once).imag).astype(np.float32)


def tunes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and prints of each row's melody, as fingerprints(); the sound itself never leaves the task.

    Null and empty vectors have no sound and no prints.
    """
    return _fingerprinted(vectors, key, vector, tune)


def _grid(sizes: np.ndarray, words: bytes) -> np.ndarray:
    """A row of prints per recording, 0 behind its end."""
    held = np.arange(sizes.max()) < sizes[:, None]
    grid = np.zeros(held.shape, np.uint32)
    grid[held] = np.frombuffer(words, np.uint32)
    return grid


def _signs(sizes: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """A row per recording: +1 or -1 for each bit of its prints, 0 behind its end."""
    bits = np.unpackbits(grid.view(np.uint8), axis=1).astype(np.float32)
    return (2 * bits - 1) * np.repeat(np.arange(grid.shape[1]) < sizes[:, None], 32, axis=1)


def _axes(signs: np.ndarray) -> np.ndarray:
    """POOL x 32 x AXES: the orthonormal directions in which POOL positions differ most, of at most FITTED such runs."""
    n = signs.shape[1] // 32 // POOL
    runs = signs[:, : 32 * POOL * n].reshape(-1, 32 * POOL)[:FITTED].astype(float)
    return np.linalg.eigh(np.cov(runs, rowvar=False, bias=True))[1][:, -AXES:].astype(np.float32).reshape(POOL, 32, AXES)


def _shadows(sizes: np.ndarray, signs: np.ndarray, axes: np.ndarray, asks: bool) -> list[np.ndarray]:
    """By the first position, below POOL, a row per recording with AXES + 2 numbers for each POOL positions from there on, 0 where it has ended.

    The product of such a row of a query with one of another recording is the square of their distance along the axes.
    """
    signs = signs.reshape(len(signs), -1, 32)
    count, n = len(signs), signs.shape[1] - POOL + 1
    along = sum(signs[:, i : i + n] @ axes[i] for i in range(POOL))
    square = (along**2).sum(2)
    out = np.empty((count, n, AXES + 2), np.float32)
    out[:, :, :AXES] = -2 * along if asks else along
    out[:, :, AXES], out[:, :, AXES + 1] = (square, 1) if asks else (1, square)
    out *= (np.arange(n) + POOL <= sizes[:, None])[:, :, None]
    return [out[:, first::POOL].reshape(count, -1) for first in range(POOL)]


def _squares(q_far: list[np.ndarray], far: list[np.ndarray], a: int, b: int, lap: int) -> np.ndarray:
    """Queries x recordings, of lap positions from a on and from b on: at most 4 times the bits that differ."""
    rows = lambda of, at: of[at % POOL][:, (AXES + 2) * (at // POOL) :][:, : (AXES + 2) * (lap // POOL)]
    return rows(q_far, a) @ rows(far, b).T


def _met(q_sizes: np.ndarray, q_words: bytes, sizes: np.ndarray, words: bytes):
    """(row of q, row, bit_error, offset, overlap) of every offset at which two recordings align, as arrays.

    A distance along fewer directions than there are bits is never above the bits' own, so pairs that are too far
    apart by that are left out; the bits of the others are compared. Where many are left, all bits are.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    q_grid, grid = _grid(q_sizes, q_words), _grid(sizes, words)
    q_signs, signs = _signs(q_sizes, q_grid), _signs(sizes, grid)
    axes = _axes(q_signs)
    q_far, far = _shadows(q_sizes, q_signs, axes, True), _shadows(sizes, signs, axes, False)
    n_q, n = q_grid.shape[1], grid.shape[1]
    for offset in range(LEAST_OVERLAP - n, n_q - LEAST_OVERLAP + 1):
        a, b = max(offset, 0), max(-offset, 0)
        lap = min(n_q - a, n - b)
        u, v = q_sizes - a, sizes - b
        one = (u == u[0]).all() and (v == v[0]).all()
        overlap = np.minimum(u[0], v[0]) if one else np.minimum(u[:, None], v)
        near = _squares(q_far, far, a, b, lap) <= np.float32(4 * ((MOST_ERRORS + 0.001) * 32 * overlap + 1))  # what is added is for rounding
        if not one:
            near &= overlap >= LEAST_OVERLAP
        dense = np.count_nonzero(near) > DENSE * near.size
        if dense:
            same = q_signs[:, 32 * a : 32 * (a + lap)] @ signs[:, 32 * b : 32 * (b + lap)].T
            near &= same >= (1 - 2 * MOST_ERRORS) * 32 * overlap - 1
        i, j = np.divmod(np.flatnonzero(near), len(sizes))
        overlap = np.minimum(u[i], v[j]).astype(np.int64)
        if dense:
            wrong = (32 * overlap - same[i, j].astype(np.int64)) // 2
        else:
            wrong = np.zeros(len(i), np.int64)
            for at in range(0, len(i), some := max(1, (1 << 20) // lap)):
                part = slice(at, at + some)
                differ = np.bitwise_count(q_grid[:, a : a + lap][i[part]] ^ grid[:, b : b + lap][j[part]])
                wrong[part] = (differ * (np.arange(lap) < overlap[part, None])).sum(1)
        error = wrong / (32 * overlap)
        good = error <= MOST_ERRORS
        found.append((i[good], j[good], error[good], np.full(good.sum(), offset), overlap[good]))
    return [np.concatenate(x) for x in zip(*found)]


def _blocks(classes: DataFrame, kind: str) -> DataFrame:
    """Rows of up to BLOCK classes: ids, sizes and the prints one after another."""

    def run(batches):
        for b in batches:
            prints = b.column(1)
            sizes = prints.value_lengths().to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < b.num_rows:
                end = min(at + BLOCK, max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK_SPOTS, "right")) - 1))
                words = prints.slice(at, end - at).flatten().to_numpy(zero_copy_only=False).astype(np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).slice(at, end - at).to_pylist()], pa.list_(b.column(0).type)), pa.array([sizes[at:end].tolist()], pa.list_(pa.int32())), pa.array([words], pa.binary())], ["ids", "sizes", "words"])
                at = end

    return classes.select("id", "prints").mapInArrow(run, f"ids array<{kind}>, sizes array<int>, words binary")


def align(prints: DataFrame, key: str, every: int = 50) -> DataFrame:
    """One row per recording: key, class_id, n_prints, n_matches, query_id, offset, overlap, bit_error.

    Queries are the recordings whose key is divisible by every, against all, at all offsets. Recordings
    with equal prints are one class, named by its smallest key; a class is a query if any of its keys is.
    n_matches counts the query classes, its own apart, that align; query_id is the one with the least
    bit_error, then the smallest, and null without any; offset is its position less this one's, the
    smallest of those with that bit_error. Recordings without prints match nothing. An empty table gives
    an empty one.

    Every class meets every query: a block of classes and one of queries are one row, and what is left
    of it is a row for each class that met any. The work grows with classes times queries.
    """
    kind = dict(prints.dtypes)[key]
    rows = save(prints.select(F.col(key).alias("key"), "prints", F.sha2(F.array_join("prints", ","), 256).alias("sha")), "prints")
    heard = rows.filter(F.size("prints") > 0)
    classes = save(heard.groupBy("sha").agg(F.min("key").alias("id"), F.first("prints").alias("prints"), F.max(F.coalesce(F.col("key") % every == 0, F.lit(False))).alias("asks")), "classes")
    able = classes.filter(F.size("prints") >= LEAST_OVERLAP)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = save(_blocks(able, kind).repartition(parts), "blocks")
    asked = save(_blocks(able.filter("asks"), kind), "asked").select(F.col("ids").alias("q_ids"), F.col("sizes").alias("q_sizes"), F.col("words").alias("q_words"))

    def meet(batches):
        for b in batches:
            for x in range(b.num_rows):
                ids, sizes, words, q_ids, q_sizes, q_words = (b.column(c)[x].as_py() for c in range(6))
                sizes, q_sizes = np.array(sizes), np.array(q_sizes)
                i, j, error, offset, overlap = _met(q_sizes, q_words, sizes, words)
                best = {}
                for i, j, *rest in zip(i.tolist(), j.tolist(), error.tolist(), offset.tolist(), overlap.tolist()):
                    if q_ids[i] != ids[j]:
                        mine = best.setdefault(j, {})
                        mine[i] = min(mine.get(i, rest), rest)
                out = [(ids[j], len(m), *min((e, q_ids[i], o, n) for i, (e, o, n) in m.items())) for j, m in best.items()]
                id_type = b.column(0).type.value_type
                types = [id_type, pa.int64(), pa.float64(), id_type, pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["id", "met", "bit_error", "q", "offset", "overlap"])

    good = blocks.select("ids", "sizes", "words").crossJoin(asked).mapInArrow(meet, f"id {kind}, met long, bit_error double, q {kind}, offset int, overlap int")
    top = good.groupBy("id").agg(F.sum("met").alias("n_matches"), F.min(F.struct("bit_error", "q", "offset", "overlap")).alias("best"))
    named = classes.select("sha", "id").join(top, "id", "left")
    salt = F.pmod(F.xxhash64("key"), F.lit(64))
    own = rows.withColumn("salt", salt)
    parts = own.select("sha", "salt").distinct().join(named, "sha")
    return own.join(parts, ["sha", "salt"], "left").select(
        F.col("key").alias(key), F.col("id").alias("class_id"), F.size("prints").cast("long").alias("n_prints"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.col("best.q").alias("query_id"), F.col("best.offset").alias("offset"), F.col("best.overlap").alias("overlap"), F.col("best.bit_error").alias("bit_error"),
    )
