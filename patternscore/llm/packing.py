"""Best-fit packing of tokenised documents in bulk-synchronous rounds.

Pieces of more than half a sequence open one each. Then rounds repeat: the pieces that have no place and the gaps that are left are
range-sorted together by size, so a task holds the pieces and gaps of a range of sizes and sweeps them from large to small; each
piece takes its successor, the smallest gap that holds it, and what is left of the gap stays in the sweep. Pieces whose range has no
gap left get gaps of the next larger ranges: each range says how much it lacks or has over, the order of the ranges settles who
gets which stretch of the ranked gaps, and a second sweep places those pieces. Gaps are updated and the next round sorts again.
When a round places little, the largest pieces (those over half of the longest) open new sequences, best-fit among themselves.
The driver sees two rows for each task of a sort. Texts are read once and never shuffled.
"""

from __future__ import annotations

import os
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, saved, text_bytes

#: Chunks of a text that a task remembers the tokens of.
_MEMO = 800_000
#: Pieces and gaps that one task sweeps.
_PER_TASK = 250_000
#: A round that places a smaller share of its pieces is the last before new sequences are opened.
_LEAST_PLACED = 0.05
#: Kinds of rows: a piece that has its place, a piece that has none, a gap, and what a range has over (seq) and lacks (cum).
_PLACED, _FREE, _GAP, _SUM = 0, 1, 2, 3


class Tokens:
    """ids of a text as little-endian uint32 bytes.

    A space before a character that is no white space always starts a new token of the byte-level pre-tokeniser, so a
    text without double spaces is cut there and the ids of each chunk are remembered; other texts, and those that hold the
    string of a special token, are encoded whole. New chunks of a batch are encoded as one text and told apart by the byte
    lengths of their tokens. Offsets into the text are not asked for, which halves the time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)  # byte-level: a character a byte
        self.memo: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Of chunks that each start with a space and a character that is none."""
        if not chunks:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) for c in chunks])) + 1
        raw, at, out = ids.tobytes(), 0, []
        for e in (4 * ends).tolist():
            out.append(raw[at:e])
            at = e
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        memo, cut, whole = self.memo, [], []
        if len(memo) > _MEMO:
            memo.clear()
        new: set[str] = set()
        for i, text in enumerate(texts):
            first, *rest = text.split(" ")
            unknown = [p for p in rest if p not in memo]
            if any(not p or p[0].isspace() for p in unknown) or any(x in text for x in self.special):
                whole.append(i)
                continue
            cut.append((i, first, rest))
            new.update(unknown)
        fresh = list(new)
        own = dict(zip(fresh, self._encode_chunks([" " + p for p in fresh]), strict=True))
        memo.update((p, ids) for p, ids in own.items() if len(p) <= 64)
        out = [b""] * len(texts)
        for (i, _, rest), ids in zip(cut, self._encode([first for _, first, _ in cut]), strict=True):
            out[i] = ids + b"".join([memo[p] if p in memo else own[p] for p in rest])
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One per Python worker, so later tasks find its memory filled."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def piece_bounds(n: int, most: int) -> list[int]:
    """Starts of the pieces of n tokens, and n: whole pieces but for the first."""
    if n <= most:
        return [0, n]
    first = n % most or most
    return [0, *range(first, n, most), n]


def _piecer(path: str, most: int, end: int, with_ids: bool):
    def make():
        tokens, tail = tokens_of(path), np.array([end], "<u4").tobytes()

        def f(batch):
            names = ("doc_id", "piece", "start", "length", "ids_crc32") + ("ids",) * with_ids
            out = {k: [] for k in names}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.batch([t.decode() for t in batch.column("text").to_pylist()]), strict=True):
                ids += tail
                at = piece_bounds(len(ids) // 4, most)
                for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    part = ids[4 * a : 4 * b]
                    for k, v in zip(names, (doc, p, a, b - a, zlib.crc32(part), part), strict=False):
                        out[k].append(v)
            return out

        return f

    return make


class Sweep:
    """Gaps by room; a piece takes the smallest that holds it. ``opening``: a piece that no gap holds opens a sequence."""

    def __init__(self, most: int, opening: bool = False):
        self.most, self.opening, self.rooms, self.mask = most, opening, {}, 0

    def add(self, seq: int, room: int) -> None:
        if room:
            self.rooms.setdefault(room, []).append(seq)
            self.mask |= 1 << room

    def place(self, piece: int, length: int) -> tuple[int, int] | None:
        """Sequence and offset."""
        fits = self.mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            seq = self.rooms[room].pop()
            if not self.rooms[room]:
                del self.rooms[room]
                self.mask ^= 1 << room
        elif self.opening:
            seq, room = piece, self.most
        else:
            return None
        self.add(seq, room - length)
        return seq, self.most - room

    def left(self) -> list[tuple[int, int]]:
        """(sequence, room) of the gaps, small ones first."""
        return [(seq, room) for room in sorted(self.rooms) for seq in self.rooms[room]]


_SWEPT = "kind int, cell int, id long, seq long, size int, at int, cum long"


def _sweeper(most: int, opening: bool, by_cell: bool):
    """Rows (kind, cell, id, size) arrive from large to small, by cell or all of one: where pieces go, and what is left.

    A gap that is left has, as cum, the rooms before it among the gaps that any piece of a smaller range fits, or else -1.
    """

    def make():
        now: dict = {"cell": None, "sweep": None, "low": most, "lacking": 0}

        def closed(out):
            if now["sweep"] is None:
                return
            cum = 0
            for seq, room in now["sweep"].left():
                fits = room >= now["low"]
                out.append((_GAP, now["cell"], seq, 0, room, 0, cum if fits else -1))
                cum += room * fits
            if cum or now["lacking"]:
                out.append((_SUM, now["cell"], 0, cum, 0, 0, now["lacking"]))

        def begin(cell, out):
            closed(out)
            now.update(cell=cell, sweep=Sweep(most, opening), low=most, lacking=0)

        def columns(out):
            names = ("kind", "cell", "id", "seq", "size", "at", "cum")
            return dict(zip(names, map(np.array, zip(*out, strict=True)), strict=True)) if out else None

        def f(batch):
            out: list = []
            cells = batch.column("cell").to_pylist() if by_cell else [TaskContext.get().partitionId()] * batch.num_rows
            for cell, kind, i, size in zip(cells, *(batch.column(c).to_pylist() for c in ("kind", "id", "size")), strict=True):
                if cell != now["cell"]:
                    begin(cell, out)
                now["low"] = size
                if kind == _GAP:
                    now["sweep"].add(i, size)
                elif (found := now["sweep"].place(i, size)) is None:
                    now["lacking"] += size
                    out.append((_FREE, cell, i, 0, size, 0, -1))
                else:
                    out.append((_PLACED, cell, i, found[0], size, found[1], -1))
            return columns(out)

        def last():
            out: list = []
            closed(out)
            return columns(out)

        f.last = last
        return f

    return make


def stretches(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(cell, from, to, target): which stretch of a range's spare room goes to which smaller range.

    ranges: (cell, room over, length lacking) from large sizes to small. A range takes from the nearest larger one first.
    """
    out, spare = [], []
    for cell, over, lacking in ranges:
        while lacking > 0 and spare:
            giver, a, b = spare.pop()
            taken = min(b - a, lacking)
            out.append((giver, a, a + taken, cell))
            lacking -= taken
            if a + taken < b:
                spare.append((giver, a + taken, b))
        if over:
            spare.append((cell, 0, over))
    return out


def sequences(short: DataFrame, most: int, per_task: int = _PER_TASK) -> DataFrame:
    """id, sequence_id and at of pieces short(id, length) of under ``most`` tokens; a sequence has the id of the piece that opened it."""
    rows = short.select("id", F.col("length").cast("int").alias("size"))
    large = rows.where(F.col("size") > most // 2)
    gaps = large.select("id", (F.lit(most) - F.col("size")).alias("size"))
    free, placed = rows.where(F.col("size") <= most // 2), [large.select("id", F.col("id").alias("seq"), F.lit(0).alias("at"))]
    before = None  # pieces that had no place before the last round of matching

    def kept(swept: DataFrame, kind: int) -> DataFrame:
        return swept.where(F.col("kind") == kind)

    def swept(rows: DataFrame, n: int, opening: bool) -> DataFrame:
        by = [F.desc("size"), F.desc("kind"), F.col("id")]
        dealt = rows.repartitionByRange(max(1, -(-n // per_task)), *by).sortWithinPartitions(*by)
        return saved(arrow_pass(dealt, _sweeper(most, opening, False), _SWEPT), "swept")

    while True:
        state = free.agg(F.count("*").alias("n"), F.max("size").alias("top"), F.min("size").alias("low")).first()
        if not state["n"]:
            break
        few = before is not None and before - state["n"] < _LEAST_PLACED * before
        gaps = gaps.where(F.col("size") >= state["low"])  # what is smaller holds no piece any more
        n_gaps = gaps.count()
        if few or not n_gaps:
            opens = F.col("size") > state["top"] // 2
            out = swept(free.where(opens).select(F.lit(_FREE).alias("kind"), "id", "size"), state["n"], True)
            placed.append(kept(out, _PLACED).select("id", "seq", "at"))
            gaps, free = gaps.union(kept(out, _GAP).select("id", "size")), free.where(~opens)
            before = None
            continue
        both = free.select(F.lit(_FREE).alias("kind"), "id", "size").union(gaps.select(F.lit(_GAP).alias("kind"), "id", "size"))
        first = swept(both, state["n"] + n_gaps, False)
        placed.append(kept(first, _PLACED).select("id", "seq", "at"))
        free, gaps = kept(first, _FREE), kept(first, _GAP)
        sums = kept(first, _SUM).select("cell", "seq", "cum").collect()  # a row for each task of the sort
        moves = stretches(sorted((r["cell"], r["seq"], r["cum"]) for r in sums))
        if moves:
            plan = F.broadcast(short.sparkSession.createDataFrame(pa.table([pa.array(x, t) for x, t in zip(zip(*moves, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["giver", "a", "b", "target"])))  # under two rows for each task
            found = gaps.join(plan, (F.col("cell") == F.col("giver")) & (F.col("cum") >= F.col("a")) & (F.col("cum") < F.col("b")), "left")
            found = saved(found.select("id", "size", "target"), "gaps")
            meet = free.select(F.lit(_FREE).alias("kind"), "cell", "id", "size").union(found.where("target IS NOT NULL").select(F.lit(_GAP).alias("kind"), F.col("target").alias("cell"), "id", "size"))
            meet = meet.repartition("cell").sortWithinPartitions("cell", F.desc("size"), F.desc("kind"), "id")
            second = saved(arrow_pass(meet, _sweeper(most, False, True), _SWEPT), "swept")
            placed.append(kept(second, _PLACED).select("id", "seq", "at"))
            free, gaps = kept(second, _FREE), kept(second, _GAP).select("id", "size").union(found.where("target IS NULL").select("id", "size"))
        free, gaps = free.select("id", "size"), gaps.select("id", "size")
        before = state["n"]
    return reduce(DataFrame.union, placed).select("id", F.col("seq").alias("sequence_id"), F.col("at").cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, most: int = 1024, end: int = 2, with_ids: bool = False, per_task: int = _PER_TASK) -> DataFrame:
    """Pieces of all documents and their place in sequences of at most ``most`` tokens.

    Returns doc_id, piece, start, length, ids_crc32 (little-endian uint32 ids), sequence_id, offset (and ids with
    ``with_ids``). A document is its token ids and ``end``; a null text is empty, so it is one piece of one token. The string of a
    special token in a text gives that token's id, as the tokenizer does by default. A row is
    a document even if others repeat it; pieces are told apart by a row number; other columns are ignored.
    tokenizer: a path that every executor can open. per_task: pieces and gaps that a task sweeps.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = saved(arrow_pass(rows, _piecer(tokenizer, most, end, with_ids), columns, rows=200).withColumn("id", F.monotonically_increasing_id()), "pieces")
    full, short = pieces.where(F.col("length") == most), pieces.where(F.col("length") < most)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    placed = short.join(sequences(short, most, per_task), "id").select(*keep, "sequence_id", "offset")
    # Whole sequences take the piece's own number too, below zero.
    return placed.unionByName(full.select(*keep, (-1 - F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
