"""MinHash bands and sketches: which rows of a corpus are worth an exact comparison.

An item (a line, a document's shingle set) is known by a 64-bit hash ``lh``. It has BANDS band hashes, each of ROWS minima, and a
sketch of the low byte of every minimum. Items that share a band and agree in AGREE bytes of their sketches are likely
alike; a set of likely items is named by two sums of hashes of its members, so the set that several bands find is one.

A band of more than ``most`` items would cost the square of its size. Its items are instead sorted in two orders, each by the band
and then by the other sketch bytes, and every item meets the nearest half block on both sides. A pair at similarity 0.8 agrees
with probability 0.87 in the first two such bytes of one order or the other, for each wide band that it shares, and items alike in
more bytes stand nearer; the work is linear in the band. Blocks are cut by rank, so no block and no task grows with a band.

That order only finds most links cheaply. Once links are verified, unlinked_sets() has every item of a wide band outside the band's largest
component meet all others of the band by their sketches, in pairs of blocks, so that no two items that share a band stay uncompared but
those that their sizes tell apart: sets whose sizes differ by more than the least similarity allows cannot be alike.

Rows of bands travel packed, many of a bucket of bands to a Spark row, as there are many and each is short.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, distinct, mix, saved

#: Bands and hashes in each: pairs at similarity 0.8 share a band with probability 0.997.
BANDS, ROWS = 8, 3
_RNG = np.random.default_rng(20)
#: Multipliers and shifts of the hash functions whose minima are taken.
MULTIPLIERS = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
SHIFTS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
#: Bytes of a sketch, and how many must agree for two items to be compared: at similarity 0.8 fewer do with probability 0.0002.
SKETCH, AGREE = BANDS * ROWS, 12
#: Columns of a sketch, eight bytes each.
WORDS = [f"s{i}" for i in range(SKETCH // 8)]
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
#: The low bits of a band hash: its number, and a flag for rows that only say that an item occurs again.
_NUMBER, _AGAIN = np.uint64(7), np.uint64(8)


def longs(cols: list[str]) -> str:
    return ", ".join(f"{c} long" for c in cols)


def band_hashes(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the minima (items x SKETCH), the band hashes (items x BANDS) and the sketches (items x SKETCH bytes)."""
    wide = low.astype(np.uint64).reshape(-1, BANDS, ROWS)
    out = np.repeat(_BAND_SALT[None], len(low), axis=0)
    for j in range(ROWS):
        out = mix(out + wide[:, :, j])
    out = (out & ~np.uint64(15)) | np.arange(BANDS, dtype=np.uint64)
    return out.view(np.int64), low.astype(np.uint8)


def again_hashes(lh: np.ndarray) -> np.ndarray:
    """Band hashes of rows that only say that an item occurs again."""
    return ((mix(lh.view(np.uint64)) & ~np.uint64(15)) | _AGAIN).view(np.int64)


def _parts(alike: np.ndarray) -> np.ndarray:
    """Component of each row of a group, from its matrix of agreements."""
    part, todo = np.arange(len(alike)), alike.sum(axis=1) > 1
    while todo.any():
        first = front = np.flatnonzero(todo)[:1]
        todo[first] = False
        while len(front):
            front = np.flatnonzero(alike[front].any(axis=0) & todo)
            part[front] = first[0]
            todo[front] = False
    return part


def _agreed(a: np.ndarray, b: np.ndarray, half: bool = False):
    """In how many bytes each sketch of a agrees with each of b: tiles (row, column, counts) that a core's cache holds; half: a is b, and tiles below its diagonal are left out."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for i in range(0, a.shape[1], 64):
        for j in range(i if half else 0, b.shape[1], 2048):
            own, other = a[:, i : i + 64, None], b[:, None, j : j + 2048]
            same = (own[0] == other[0]).view(np.uint8)
            for p in range(1, SKETCH):
                same += (own[p] == other[p]).view(np.uint8)
            yield i, j, same


def _alike(sketches: np.ndarray) -> np.ndarray:
    """Which sketches of a group agree enough, each with each."""
    out = np.zeros((len(sketches), len(sketches)), bool)
    for i, j, same in _agreed(sketches, sketches, half=True):
        near = same >= AGREE
        out[i : i + near.shape[0], j : j + near.shape[1]] = near
        out[j : j + near.shape[1], i : i + near.shape[0]] |= near.T
    return out


def _likely(key, lh, sketches):
    """For rows sorted by key: the set (x, y) that each is in, and whether it is in any."""
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(key)))
    one, two = mix(lh.view(np.uint64)), mix(lh.view(np.uint64) + np.uint64(1))
    x, y, keep = np.zeros(len(key), np.uint64), np.zeros(len(key), np.uint64), np.zeros(len(key), bool)
    for n in range(2, 33):  # small groups, all of a size at once
        some = starts[sizes == n]
        for a in range(0, len(some), step := max(1, (1 << 17) // (n * n))):
            places = some[a : a + step, None] + np.arange(n)
            own = sketches[places]
            alike = (own[:, :, None] == own[:, None]).sum(axis=3, dtype=np.uint8) >= AGREE
            picked = (alike.sum(axis=2) > 1).any(axis=1)
            if not picked.any():
                continue
            places, alike = places[picked], alike[picked]
            part = np.broadcast_to(np.arange(n), places.shape)
            while not np.array_equal(part, less := np.where(alike, part[:, None], n).min(axis=2)):
                part = less
            same = part[:, :, None] == part[:, None]
            x[places] = np.where(same, one[places][:, None], np.uint64(0)).sum(axis=2)
            y[places] = np.where(same, two[places][:, None], np.uint64(0)).sum(axis=2)
            keep[places] = alike.sum(axis=2) > 1
    for a, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        part = _parts(_alike(sketches[a : a + n]))
        sums = np.zeros((2, n), np.uint64)
        np.add.at(sums[0], part, one[a : a + n])
        np.add.at(sums[1], part, two[a : a + n])
        x[a : a + n], y[a : a + n] = sums[0][part], sums[1][part]
        keep[a : a + n] = np.bincount(part, minlength=n)[part] > 1
    return x, y, keep


#: Rows, of 40 bytes, that _sifter() takes together at least: Arrow's batches are small, as other rows hold texts.
_SIFTED = 16_384
#: Kinds of rows that the sifters give.
_SET, _WIDE, _REPEAT, _APART = 0, 1, 2, 3


def _rows(kind: int, key, lh, sketches, x=None, y=None) -> dict:
    zero = np.zeros(len(lh), np.int64)
    words = sketches.view(np.int64).reshape(-1, SKETCH // 8) if kind in (_WIDE, _APART) else np.zeros((len(lh), SKETCH // 8), np.int64)
    names = {"x": zero if x is None else x.view(np.int64), "y": zero if y is None else y.view(np.int64), "lh": lh, "band": key if kind in (_WIDE, _APART) else zero}
    return {"kind": np.full(len(lh), kind, np.int32)} | names | {c: words[:, i] for i, c in enumerate(WORDS)}


def _whole(key, lh, sketches, most: int | None):
    """What whole groups give: different rows by key."""
    if not len(key):
        return
    if most:
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(key)))
        large = np.repeat(sizes > most, sizes)
        if large.any():
            yield _rows(_WIDE, key[large], lh[large], sketches[large])
            key, lh, sketches = key[~large], lh[~large], sketches[~large]
            if not len(key):
                return
    x, y, keep = _likely(key, lh, sketches)
    if keep.any():
        yield _rows(_SET, None, lh[keep], None, x[keep], y[keep])


#: Buckets of bands, rows that a task packs at once, that are sifted together at least, and of a bucket that is not sorted in its task.
BUCKETS, _PACKED, _TAKEN, _APART_ROWS = 8192, 400_000, 100_000, 1_000_000
PACKED = "bucket int, rows binary"


class Packer:
    """Rows (band, lh, sketch words) of 40 bytes, gathered and given as one row (bucket, rows) for each bucket of bands."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, band: np.ndarray, lh: np.ndarray, words: np.ndarray):
        self.parts.append(np.column_stack((band, lh, words)))
        self.n += len(band)
        if self.n >= _PACKED:
            yield from self.given()

    def given(self):
        if not self.n:
            return
        rows = np.concatenate(self.parts)
        self.parts, self.n = [], 0
        bucket = (rows[:, 0].view(np.uint64) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        bounds = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(rows)]))
        step = 512  # buckets of a batch
        for a in range(0, len(bounds) - 1, step):
            some = bounds[a : a + step + 1]
            data = pa.py_buffer(rows[some[0] : some[-1]])
            places = pa.py_buffer(((some - some[0]) * rows.itemsize * rows.shape[1]).astype(np.int32))
            yield {"bucket": bucket[some[:-1]].astype(np.int32), "rows": pa.Array.from_buffers(pa.binary(), len(some) - 1, [None, places, data])}


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2 + SKETCH // 8)
    return np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1]), np.ascontiguousarray(rows[:, 2:]).view(np.uint8)


def _bucket_sifter(most: int, large: int):
    """Packed rows arrive by bucket: what _sifter() gives, and the rows of a bucket of more than ``large`` rows apart, unsorted."""

    def make():
        done: list = []  # packed rows of whole buckets
        own: list = []  # of the bucket that may go on
        now: dict = {"bucket": None, "rows": 0, "done": 0, "apart": False}

        def sifted():
            packed = done[:]
            done.clear()
            now["done"] = 0
            if not packed:
                return
            key, lh, sketches = _unpacked(packed)
            order = np.argsort(key)
            by = key[order]
            more = by[1:] == by[:-1]
            again = by.view(np.uint64) & _AGAIN != 0
            if again.any():
                yield _rows(_REPEAT, None, distinct(lh[order[again]]), None)
            order = order[(np.append(more, False) | np.insert(more, 0, False)) & ~again]  # an item alone in its band meets none
            if not len(order):
                return
            order = order[np.lexsort((lh[order], key[order]))]
            key, lh = key[order], lh[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (lh[1:] != lh[:-1])))
            if len(twice := distinct(lh[~new & (key.view(np.uint64) & _NUMBER == 0)])):
                yield _rows(_REPEAT, None, twice, None)
            yield from _whole(key[new], lh[new], sketches[order[new]], most)

        def apart():
            for i in range(0, len(own), 8):
                yield _rows(_APART, *_unpacked(own[i : i + 8]))
            own.clear()

        def closed():
            if not now["apart"]:
                done.extend(own)
                now["done"] += now["rows"]
            own.clear()
            now.update(rows=0, apart=False)

        def f(batch):
            for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if bucket != now["bucket"]:
                    closed()
                    now["bucket"] = bucket
                    if now["done"] >= _TAKEN:
                        yield from sifted()
                own.append(rows)
                now["rows"] += len(rows) // (16 + SKETCH)
                if now["rows"] > large:
                    now["apart"] = True
                    yield from apart()

        def rest():
            closed()
            yield from sifted()

        f.last = rest
        return f

    return make


def _opener():
    def f(batch):
        key, lh, sketches = _unpacked(batch.column("rows").to_pylist())
        words = sketches.view(np.int64)
        return {"band": key, "lh": lh} | {c: words[:, i] for i, c in enumerate(WORDS)}

    return f


def _sifter(key_name: str, most: int | None):
    """Rows arrive by (key, lh): members of likely sets, the rows of groups of more than ``most`` items, and items that repeat."""

    def make():
        held: list = []  # rows of the group that may go on
        wide: list = []  # key of the group that is being handed on
        waiting: list = []  # batches that are sifted together

        def f(batch):
            waiting.append(batch)
            return _joined(taken()) if sum(map(len, waiting)) >= _SIFTED else None

        def taken():
            batch = pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting.clear()
            return [x for b in batch for x in found(b)]

        def found(batch):
            key, lh = batch.column(key_name).to_numpy(), batch.column("lh").to_numpy()
            words = np.stack([batch.column(c).to_numpy() for c in WORDS], axis=1)
            if most:
                again = key.view(np.uint64) & _AGAIN != 0
                if again.any():
                    yield _rows(_REPEAT, None, distinct(lh[again]), None)
                    key, lh, words = key[~again], lh[~again], words[~again]
            rows = key, lh, np.ascontiguousarray(words).view(np.uint8).reshape(-1, SKETCH)
            key, lh, sketches = [np.concatenate((a, b)) for a, b in zip(held, rows, strict=True)] if held else rows
            if not len(key):
                return
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (lh[1:] != lh[:-1])))
            if most and len(twice := distinct(lh[~new & (key.view(np.uint64) & _NUMBER == 0)])):
                yield _rows(_REPEAT, None, twice, None)
            key, lh, sketches = key[new], lh[new], sketches[new]
            at = 0
            if wide:  # rows that go on with the group that is being handed on; its last row was handed on already
                at = int((key == wide[0]).sum())
                if at > 1:
                    yield _rows(_WIDE, key[1:at], lh[1:at], sketches[1:at])
                if at == len(key):
                    held[:] = [key[-1:], lh[-1:], sketches[-1:]]
                    return
                wide.clear()
            earlier = np.flatnonzero(key != key[-1])
            n = max(at, int(earlier[-1]) + 1 if len(earlier) else 0)
            yield from _whole(key[at:n], lh[at:n], sketches[at:n], most)
            if most and len(key) - n > most:
                yield _rows(_WIDE, key[n:], lh[n:], sketches[n:])
                wide.append(key[-1])
                n = len(key) - 1
            held[:] = [key[n:], lh[n:], sketches[n:]]

        def rest():
            parts = taken() if waiting else []
            return _joined(parts + (list(_whole(*held, most)) if held and not wide else []))

        f.last = rest
        return f

    return make


def _joined(parts: list[dict]) -> dict | None:
    if len(parts) < 2:
        return parts[0] if parts else None
    return {c: pa.concat_arrays([pa.array(p[c]) for p in parts]) for c in parts[0]}


def _order(step: int, band: int, length: int = 16) -> list[int]:
    """Places of sketch bytes in an order of a band, without the bytes of the band's own minima."""
    own = range(ROWS * band, ROWS * (band + 1))
    return [p for i in range(SKETCH) if (p := (ROWS * (band + 1) + (step - 1) * 2 + step * i) % SKETCH) not in own][:length]


#: For each order and band the sketch bytes that sort it: the steps share no factor with the length of a sketch.
_ORDERS = np.array([[_order(step, b) for b in range(BANDS)] for step in (1, 5)])


def _orderer():
    def f(batch):
        band, lh = batch.column("band").to_numpy(), batch.column("lh").to_numpy()
        words = np.stack([batch.column(c).to_numpy() for c in WORDS], axis=1)
        sketches = np.ascontiguousarray(words).view(np.uint8).reshape(-1, SKETCH)
        number = (band.view(np.uint64) & _NUMBER).astype(np.int64)
        parts = []
        for o, places in enumerate(_ORDERS):
            keys = np.take_along_axis(sketches, places[number], axis=1).copy().view(">i8").astype(np.int64)
            parts.append({"o": np.full(len(lh), o, np.int32), "band": band, "k0": keys[:, 0], "k1": keys[:, 1], "lh": lh} | {c: words[:, i] for i, c in enumerate(WORDS)})
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    return f


def in_rank_blocks(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """rows with a column at, such that rows of any half block that stand together in the order of ``by`` share an at; each row has two."""
    order = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    ends = sorted((r["p"], r["n"]) for r in order.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each task of the sort
    before, at = [], 0
    for p, n in ends:
        before.append((p, at))
        at += n
    parts = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"_p": pa.array([p for p, _ in before], pa.int64()), "_before": pa.array([n for _, n in before], pa.int64())})))
    ranked = order.join(parts, F.shiftright("_id", 33) == F.col("_p")).withColumn("_r", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    half = block // 2
    return ranked.select(*rows.columns, F.explode(F.array(F.expr(f"2 * (_r div {block})"), F.expr(f"2 * ((_r + {half}) div {block}) + 1"))).alias("at"))


def likely_sets(packed: DataFrame, most: int = 4096, block: int = 32, large: int = _APART_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From packed rows (band, lh, sketch): saved tables (x, y, lh) of likely sets, (lh) of items that came from two tasks or were marked again, and (band, lh, sketch) of bands of more than ``most`` items.

    A task sorts the buckets of bands that it gets one by one; a bucket of more than ``large`` rows is left to Spark's sort.
    """
    schema = "kind int, " + longs(["x", "y", "lh", "band", *WORDS])
    sifted = saved(arrow_pass(packed.repartition("bucket").sortWithinPartitions("bucket"), _bucket_sifter(most, large), schema), "sifted")
    apart = sifted.where(F.col("kind") == _APART).select("band", "lh", *WORDS)
    if not apart.isEmpty():
        again = arrow_pass(apart.repartition("band").sortWithinPartitions("band", "lh"), _sifter("band", most), schema)
        sifted = sifted.where(F.col("kind") != _APART).union(saved(again, "sifted-apart"))
    wide = sifted.where(F.col("kind") == _WIDE).select("band", "lh", *WORDS)
    met = sifted.where(F.col("kind") == _SET).select("x", "y", "lh")
    if not wide.isEmpty():
        ordered = arrow_pass(wide, _orderer, "o int, " + longs(["band", "k0", "k1", "lh", *WORDS]))
        near = in_rank_blocks(ordered, ["o", "band", "k0", "k1", "lh"], block).select("at", "lh", *WORDS)
        met = met.union(arrow_pass(near.repartition("at").sortWithinPartitions("at", "lh"), _sifter("at", None), schema).select("x", "y", "lh"))
    met = saved(met.dropDuplicates(), "likely")
    return met, sifted.where(F.col("kind") == _REPEAT).select("lh"), wide


#: Items of a wide band that meet others together, and members of a set besides them.
_TOGETHER = 512


def _sets_with(minors, every) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, lh) of sets that hold every likely pair of one of some minor items and any item of another root; minors and every: (lh, root, sketches)."""
    pairs = []
    for i, j, same in _agreed(minors[2], every[2]):
        near = same >= AGREE
        if near.any():
            near &= minors[1][i : i + near.shape[0], None] != every[1][None, j : j + near.shape[1]]
            left, right = np.nonzero(near)
            pairs.append((left + i, right + j))
    if not sum(len(x) for x, _ in pairs):
        return []
    own, other = (np.concatenate(x) for x in zip(*pairs, strict=True))
    part = np.arange(len(minors[0]))  # minors that meet a common item share a part
    while True:
        least = np.full(len(every[0]), len(part))
        np.minimum.at(least, other, part[own])
        less = part.copy()
        np.minimum.at(less, own, least[other])
        if np.array_equal(less, part):
            break
        part = less
    out = []
    for p in np.unique(part[own]).tolist():
        ours = part[own] == p
        left, right = minors[0][np.unique(own[ours])], every[0][np.unique(other[ours])]
        for i in range(0, len(right), _TOGETHER):
            lh = distinct(np.concatenate((left, right[i : i + _TOGETHER])))
            names = [np.broadcast_to(mix(lh.view(np.uint64) + np.uint64(salt)).sum(dtype=np.uint64), len(lh)) for salt in (0, 1)]
            out.append((*names, lh))
    return out


def _meeter():
    """Rows arrive by (band, a, b, left): sets of likely pairs that have different roots, of an item at left with one at right, or of two at left where none is at right."""
    held: dict = {"key": None, "rows": []}

    def sets():
        if not held["rows"]:
            return None
        left, *rows = [np.concatenate(x) for x in zip(*held["rows"], strict=True)]
        held["rows"].clear()
        minors, others = [tuple(c[side] for c in rows) for side in (left, ~left)]
        out = []
        for i in range(0, len(minors[0]), _TOGETHER):
            some = tuple(c[i : i + _TOGETHER] for c in minors)
            out += _sets_with(some, others if len(others[0]) else tuple(c[i:] for c in minors))
        if not out:
            return None
        x, y, lh = (np.concatenate(c) for c in zip(*out, strict=True))
        return {"x": x.view(np.int64), "y": y.view(np.int64), "lh": lh}

    def f(batch):
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "a", "b")], axis=1)
        words = np.ascontiguousarray(np.stack([batch.column(c).to_numpy() for c in WORDS], axis=1)).view(np.uint8).reshape(-1, SKETCH)
        rows = batch.column("left").to_numpy(zero_copy_only=False), batch.column("lh").to_numpy(), batch.column("root").to_numpy(), words
        bounds = np.concatenate(([0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1, [len(keys)]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b > a:
                if (key := tuple(keys[a])) != held["key"]:
                    if (out := sets()) is not None:
                        yield out
                    held["key"] = key
                held["rows"].append(tuple(c[a:b] for c in rows))

    f.last = sets
    return f


def unlinked_sets(wide: DataFrame, roots: DataFrame, block: int = 16_384, least: float = 0.8) -> DataFrame | None:
    """(x, y, lh) of sets that hold every likely pair of a wide band whose two items have different roots; None where each band has one root.

    wide: (band, lh, sketch) of likely_sets(); roots: (lh, root) of all its items. With a column size, of items' sets, pairs whose sizes
    exclude a similarity of ``least`` may be left out: items are put in classes, and only those of one class or two neighbours meet.
    Items outside the band's largest component (minors) and those in it (majors) are dealt to blocks; blocks of minors meet each other, once,
    and blocks of majors. A task holds the sketches of two blocks. Likely sets are cut at 1,024 members.
    """
    # The classes are a little wider than the least ratio of sizes, so rounding puts no two such sizes two classes apart.
    kind = F.floor(F.log("size") / math.log(1.0001 / least)).cast("long") if "size" in roots.columns else F.lit(0).cast("long")
    rows = saved(wide.join(roots, "lh").select("band", "lh", "root", kind.alias("kind"), *WORDS), "wide")
    counts = rows.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("n")).where("m.c < n")
    open_bands = saved(counts.select("band", F.col("m.root").alias("major")), "open")
    if open_bands.isEmpty():
        return None
    both = rows.join(F.broadcast(open_bands), "band").withColumn("minor", F.col("root") != F.col("major"))
    units = saved(both.groupBy("band", "kind", "minor").agg(F.ceil(F.count("*") / block).cast("long").alias("parts")), "units")
    facing = F.struct(F.col("o.kind").alias("kind"), F.col("o.minor").alias("minor"), F.col("o.parts").alias("parts"))
    met = (F.col("u.band") == F.col("o.band")) & (F.abs(F.col("u.kind") - F.col("o.kind")) <= 1) & (F.col("u.minor") | F.col("o.minor"))
    near = units.alias("u").join(units.alias("o"), met).groupBy("u.band", "u.kind", "u.minor", "u.parts").agg(F.collect_list(facing).alias("facing"))
    at = lambda kind, part: F.shiftleft(kind, 32) + part
    own = at(F.col("kind"), F.pmod(F.xxhash64("lh", "band"), F.col("parts")))
    dealt = both.join(F.broadcast(near), ["band", "kind", "minor"]).select("band", "lh", "root", *WORDS, "minor", own.alias("own"), F.explode("facing").alias("facing"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("facing.parts") - 1)).alias("part")).withColumn("other", at(F.col("facing.kind"), F.col("part")))
    minor, facing_minor, own, other = F.col("minor"), F.col("facing.minor"), F.col("own"), F.col("other")
    a = F.when(~minor, other).when(~facing_minor, own).otherwise(F.least(own, other))
    b = F.when(~minor, 2 * own + 1).when(~facing_minor, 2 * other + 1).otherwise(2 * F.greatest(own, other))
    left = minor & (~facing_minor | (own <= other))
    dealt = dealt.select("band", a.alias("a"), b.alias("b"), left.alias("left"), "lh", "root", *WORDS)
    dealt = dealt.repartition("band", "a", "b").sortWithinPartitions("band", "a", "b", "left")
    return saved(arrow_pass(dealt, _meeter, longs(["x", "y", "lh"])).dropDuplicates(), "unlinked")
