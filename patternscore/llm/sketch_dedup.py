"""MinHash near-dedup: components of documents whose shingle sets are similar, by SetSketch registers.

Each distinct set has a row with its size and registers. Sets that share a band of registers are a group; groups with the same members count once.
Within a group the joint likelihood of registers and sizes tells which sets may be similar. What it links is verified on the full
sets, taken from the texts, and components of the links are the result. Neither pairs of a group nor links pass through the driver.

A group of more than ``most`` sets, or ``mass`` shingles, is cut into blocks that share some of its sets. Where a group's sets are not one component
after that, those outside its largest component meet all others, block by block, so no pair that shares a band stays uncompared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, arrow_pass, maybe_in, mix, saved, text_bytes, text_hash
from .graph import components
from .near_copies import set_links, shingle_set
from .setsketch import BANDS, REGISTERS, band_keys, least_words, likely_parts, likely_parts_of_many, registers

#: Sets of a group that all of its blocks hold, about.
_SHARED = 32


def _signer(k: int):
    def make():
        def f(batch):
            low = np.zeros((batch.num_rows, REGISTERS), np.uint32)
            sid, size = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                h = shingle_set(text, k)
                if len(h):
                    sid[i], size[i], low[i] = mix(h).sum(dtype=np.uint64), len(h), least_words(h)
            own = registers(low)
            return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "sid": sid.view(np.int64), "size": size, "k": [r.tobytes() if n else None for r, n in zip(own, size, strict=True)]}

        return f

    return make


def signed_sets(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, th (hash of the text), sid (hash of the set), size and k (registers, two bytes each; null for an empty set) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), text_bytes().alias("text"))
    return arrow_pass(texts, _signer(shingle), "doc_id long, th long, sid long, size long, k binary")


def _unpacked(batch):
    ks = [None if k is None else np.frombuffer(k, np.uint16).tolist() for k in batch.column("k").to_pylist()]
    return {c: batch.column(c) for c in ("doc_id", "sid", "size")} | {"registers": ks}


def set_registers(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, sid, size and registers (an array, null for an empty set) of every row; setsketch.merged() makes those of unions."""
    return arrow_pass(signed_sets(docs, shingle), lambda: _unpacked, "doc_id long, sid long, size long, registers array<int>")


def _matrix(ks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ks), np.uint16).reshape(-1, REGISTERS)


def _bands(batch):
    n = batch.num_rows
    return {"key": band_keys(_matrix(batch.column("k").to_pylist())).ravel(), "sid": np.repeat(batch.column("sid").to_numpy(), BANDS), "size": np.repeat(batch.column("size").to_numpy(), BANDS)} if n else None


#: Sets of a group that is judged together with others, and pairs that are judged together, about.
_SMALL, _PAIRS = 32, 20_000


def _named(sid: np.ndarray, part: np.ndarray) -> dict | None:
    """The sets of each part of two or more, under a name that its members give."""
    many = np.bincount(part)
    x, y = np.zeros(len(many), np.uint64), np.zeros(len(many), np.uint64)
    np.add.at(x, part, mix(sid.view(np.uint64)))
    np.add.at(y, part, mix(sid.view(np.uint64) + np.uint64(1)))
    own = many[part] > 1
    return {"x": x[part][own].view(np.int64), "y": y[part][own].view(np.int64), "sid": sid[own]} if own.any() else None


def _parted(keys: list[str], least: float):
    """Rows arrive by keys and sid: the sets of each part of a group that may be similar."""

    def make():
        held: dict = {"key": None, "rows": []}
        small: dict = {"rows": [], "groups": [], "pairs": 0}

        def judged(rows, parts):
            sid, size, ks = zip(*rows, strict=True)
            size = np.array(size, np.int64)
            return _named(np.array(sid, np.int64), parts(_matrix(ks), size))

        def closed():
            rows, n = held["rows"], len(held["rows"])
            held["rows"] = []
            if n > _SMALL:
                yield judged(rows, lambda k, size: likely_parts(k, size, least))
            elif n > 1:
                small["rows"] += rows
                small["groups"].append(n)
                small["pairs"] += n * (n - 1) // 2
                if small["pairs"] > _PAIRS:
                    yield rest()

        def rest():
            rows, groups = small["rows"], small["groups"]
            small.update(rows=[], groups=[], pairs=0)
            return judged(rows, lambda k, size: likely_parts_of_many(k, size, groups, least)) if rows else None

        def f(batch):
            for *key, sid, size, k in zip(*(batch.column(c).to_pylist() for c in (*keys, "sid", "size", "k")), strict=True):
                if key != held["key"]:
                    yield from filter(None, closed())
                    held["key"] = key
                elif sid == held["rows"][-1][0]:
                    continue
                held["rows"].append((sid, size, k))

        def last():
            yield from filter(None, [*closed(), rest()])

        f.last = last
        return f

    return make


def _verifier(k: int, least: float):
    def make():
        held: dict = {"key": None, "ids": [], "sets": []}

        def links():
            found = set_links(held["ids"], held["sets"], least) if len(held["ids"]) > 1 else []
            held.update(ids=[], sets=[])
            return found

        def f(batch):
            out = []
            for *key, sid, text in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "sid", "text")), strict=True):
                if key != held["key"]:
                    out += links()
                    held["key"] = key
                held["ids"].append(sid)
                held["sets"].append(shingle_set(text, k))
            return {"u": [u for u, _ in out], "v": [v for _, v in out]} if out else None

        def last():
            out = links()
            return {"u": [u for u, _ in out], "v": [v for _, v in out]} if out else None

        f.last = last
        return f

    return make


#: Sets, and their shingles, of a group that are not cut into blocks.
MOST, MASS = 2000, 4_000_000


class Search:
    """Links between the distinct sets of a table of documents; groups: more groups (key, sid, size) of sets than the bands."""

    def __init__(self, docs: DataFrame, each: DataFrame, shingle: int, least: float, most: int = MOST, mass: int = MASS, groups: DataFrame | None = None):
        self.docs, self.each, self.shingle, self.least, self.most, self.mass, self.groups = docs, each, shingle, least, most, mass, groups
        self.sets = each.where("sid <> 0").dropDuplicates(["sid"]).select("sid", "size", "k", "th")

    def members(self) -> DataFrame:
        """key, n (sets in the group), blocks and sid, of one of each kind of groups of two sets or more."""
        bands = arrow_pass(self.sets.select("sid", "size", "k"), lambda: _bands, "key long, sid long, size long")
        bands = saved(bands if self.groups is None else bands.union(self.groups), "bands")
        groups = bands.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("mass"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where("n > 1")
        blocks = F.greatest(F.ceil(F.col("n") / self.most), F.ceil(F.col("mass") / self.mass)).cast("int").alias("blocks")
        kinds = groups.groupBy("x", "y", "n", "mass").agg(F.min("key").alias("key")).select("key", "n", blocks)
        return saved(bands.select("key", "sid").join(kinds, "key"), "members")

    def links(self, met: DataFrame, keys: list[str]) -> DataFrame:
        """Verified links within the groups of ``keys``. Rows are few for the work that they make, so the number of tasks is given: it would shrink with the bytes."""
        tasks = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = met.join(self.sets.select("sid", "size", "k"), "sid").repartition(tasks, *keys).sortWithinPartitions(*keys, "sid")
        parts = saved(arrow_pass(rows.select(*keys, "sid", "size", "k"), _parted(keys, self.least), "x long, y long, sid long").distinct(), "likely")
        one = saved(parts.select("sid").distinct().join(self.sets.select("sid", "th"), "sid"), "met")
        maybe = maybe_in(BitFilter.of(one, "th"))(F.col("th"))
        texts = self.docs.select(text_hash().alias("th"), text_bytes().alias("text")).where(maybe)
        held = texts.join(one, "th").groupBy("sid").agg(F.first("text").alias("text"))
        dealt = parts.join(held, "sid").select("x", "y", "sid", "text").repartition("x", "y").sortWithinPartitions("x", "y", "sid")
        return saved(arrow_pass(dealt, _verifier(self.shingle, self.least), "u long, v long").distinct(), "links")

    def all_links(self) -> DataFrame:
        met = self.members()
        own = F.pmod(F.xxhash64("sid", "key"), F.col("blocks")).cast("int")
        shared = F.pmod(F.xxhash64("key", "sid"), F.col("n")) < _SHARED
        places = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(shared, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
        found = self.links(met.select("key", "sid", F.explode(places).alias("block")), ["key", "block"])
        wide = met.where("blocks > 1")
        if wide.isEmpty():
            return found
        rooted = wide.join(components(found), F.col("sid") == F.col("node"), "left").select("key", "n", "blocks", "sid", F.coalesce("root", "sid").alias("root"))
        rooted = saved(rooted, "rooted")
        largest = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("c"))
        open_keys = largest.where("m.c < c").select("key", F.col("m.root").alias("major"), F.ceil((F.col("c") - F.col("m.c")) / self.most).cast("int").alias("others"))
        open_keys = saved(open_keys, "open")
        if open_keys.isEmpty():
            return found
        both = rooted.join(open_keys, "key")
        at, other = F.pmod(F.xxhash64("sid", "key"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("sid", "key"), F.col("others")).cast("int")
        every = both.select("key", "sid", at.alias("block"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("with"))
        minor = both.where("root <> major").select("key", "sid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), other.alias("with"))
        return found.union(self.links(every.union(minor), ["key", "block", "with"]))


def similar_sets(docs: DataFrame, shingle: int = 4, least: float = 0.8, most: int = MOST, mass: int = MASS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Sets of ``least`` similarity or more are linked, component_id is the smallest doc_id that links reach. A row without words is linked with nothing.
    Null texts are empty; a null doc_id is a component_id only where no other is reached; kept tells rows whose doc_id
    is their component_id. Rows that repeat each get their row, other columns are ignored, an empty table has no rows.
    """
    each = saved(signed_sets(docs, shingle), "sets")
    roots = components(Search(docs, each, shingle, least, most, mass).all_links())
    own = each.where("sid <> 0").groupBy("sid").agg(F.min("doc_id").alias("low"))
    own = saved(own.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "low", F.coalesce("root", "sid").alias("root")), "roots")
    named = own.join(own.groupBy("root").agg(F.min("low").alias("low_id")), "root").select("sid", "low_id")
    out = each.select("doc_id", "sid", "size").join(named, "sid", "left")
    least_id = F.when(F.col("sid") == 0, F.col("doc_id")).otherwise(F.col("low_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), least_id.alias("component_id"), F.col("doc_id").eqNullSafe(least_id).alias("kept"))
