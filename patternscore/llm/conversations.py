"""Conversation structure repair: the cheapest edits after which the roles read (system? (user assistant)+)?.

A lazily determinised weighted automaton does the work. From the last turn to the first it carries, for each of the four places
in the grammar, what the rest costs at best. Such a vector less its minimum is a state; (state, kind of turn) leads to a state
and a weight, computed once and then looked up, so a scan of a conversation is a walk through a table and the sum of its weights
is the cost. The edits follow from the first turn to the last over arcs that cost just what the vectors say.

Spark deals conversations to tasks. One of more than ``most`` (turns, plus one for each 1,000 characters) is cut by rank into pieces
of that size: pieces report what leads from place to place at what cost, these compose to the vector at each piece's end and the
place at its start, and then pieces are repaired like conversations of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_total
from .common import SPACES, arrow_pass, saved

# Costs of the edits, and what a truncated turn that stays costs besides.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: What stands before: nothing, a system turn, a user turn, an assistant turn.
PLACES = range(4)
#: The place after a turn that the grammar asks for (a user's, or an assistant's after a user's).
_NEXT = (2, 2, 3, 2)
#: Where a turn of initial s, u, a or other may stay, and the place after it.
_KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
_FAR = 1 << 60
#: Kinds of turns: 2 * initial + truncated, and one that must go.
_GONE, _KINDS = 8, 9
FAULTS = ("", "blank", "duplicate", "truncated")


def _with_inserts(v: list[int]) -> tuple[int, ...]:
    """Costs from each place when turns may be inserted first."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + u), min(v[1], INSERT + u), u, a


#: What is left to pay after the last turn.
END = _with_inserts([0, _FAR, _FAR, 0])


class Automaton:
    """States are cost vectors less their minimum; arcs and moves are computed when first asked for."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.arcs: list[list] = []
        self.traces: list[list] = []

    def state(self, v) -> tuple[int, int]:
        least = min(v)
        key = tuple(x - least if x < _FAR else _FAR for x in v)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
            self.arcs.append([None] * _KINDS)
            self.traces.append([None] * _KINDS)
        return self.ids[key], least

    def before(self, after: int, kind: int) -> tuple[int, int]:
        """State before a turn of a kind, and its weight."""
        if self.arcs[after][kind] is None:
            v, extra, out = self.vectors[after], TRUNCATED * (kind & 1), []
            for q in PLACES:
                best = DELETE + v[q]
                if kind != _GONE:
                    best = min(best, REROLE + extra + v[_NEXT[q]])
                    if (to := _KEEP[kind >> 1].get(q)) is not None:
                        best = min(best, extra + v[to])
                out.append(min(best, _FAR))
            self.arcs[after][kind] = self.state(_with_inserts(out))
        return self.arcs[after][kind]

    def moves(self, after: int, kind: int) -> list[tuple[str, int] | None]:
        """For each place before a turn: the letters of the least tight moves up to the turn's own, and the place after it."""
        if self.traces[after][kind] is None:
            state, weight = self.before(after, kind)
            now, v, extra = self.vectors[state], self.vectors[after], TRUNCATED * (kind & 1)
            out: list[tuple[str, int] | None] = []
            for q in PLACES:
                letters = ""
                while now[q] < _FAR:
                    left = now[q] + weight
                    to = None if kind == _GONE else _KEEP[kind >> 1].get(q)
                    if DELETE + v[q] == left:
                        out.append((letters + "D", q))
                    elif INSERT + now[_NEXT[q]] == now[q]:
                        letters, q = letters + "I", _NEXT[q]
                        continue
                    elif to is not None and extra + v[to] == left:
                        out.append((letters + "K", to))
                    else:
                        out.append((letters + "R", _NEXT[q]))
                    break
                else:
                    out.append(None)
            self.traces[after][kind] = out
        return self.traces[after][kind]

    def scan(self, kinds: list[int], end) -> tuple[list[int], int]:
        """States after each turn, from the costs after the last one, and the sum of all weights."""
        state, total = self.state(end)
        after = [state] * len(kinds)
        for i in range(len(kinds) - 1, -1, -1):
            after[i] = state
            state, w = self.before(state, kinds[i])
            total += w
        return [*after, state], total

    def costs(self, kinds: list[int], end) -> tuple[int, ...]:
        """Costs from each place before the turns."""
        states, total = self.scan(kinds, end)
        return tuple(x + total if x < _FAR else _FAR for x in self.vectors[states[-1]])

    def trace(self, kinds: list[int], end, place: int) -> tuple[list[str], int]:
        """Letters of each turn, and the place after the last one."""
        after, letters = self.scan(kinds, end)[0], []
        for s, kind in zip(after, kinds):
            own, place = self.moves(s, kind)[place]
            letters.append(own)
        return letters, place


def _role(place: int) -> str:
    return "user" if place == 2 else "assistant"


def _grouped(keys: list[str], columns: list[str], per_group):
    """Rows arrive group by group; per_group(key, rows) gives output rows of a whole group, as dicts of lists."""

    def make():
        held: dict = {"key": None, "rows": []}
        machine = Automaton()

        def f(batch):
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *columns)), strict=True):
                key = row[: len(keys)]
                if key != held["key"]:
                    if held["rows"]:
                        yield per_group(machine, held["key"], held["rows"])
                    held.update(key=key, rows=[])
                held["rows"].append(row[len(keys) :])

        def last():
            return per_group(machine, held["key"], held["rows"]) if held["rows"] else None

        f.last = last
        return f

    return make


def _summary(machine: Automaton, key, rows):
    """What a piece costs from each place (rows) to each place (columns)."""
    kinds = [r[0] for r in rows]
    columns = [machine.costs(kinds, [0 if q == to else _FAR for q in PLACES]) for to in PLACES]
    return {"cid": [key[0]], "piece": [key[1]], "costs": [[columns[to][q] for q in PLACES for to in PLACES]]}


def _exits(machine: Automaton, key, rows):
    """The place after a piece for each place before it; -1 for one that nothing leads on from."""
    kinds, end = [r[0] for r in rows], rows[0][1]
    after = machine.scan(kinds, end)[0]
    out = []
    for q in PLACES:
        for s, kind in zip(after, kinds):
            q = machine.moves(s, kind)[q][1]
        out.append(q)
    return {"cid": [key[0]], "piece": [key[1]], "exits": [out]}


def _folded(keys: list[str], columns: list[str], start, step):
    """A value carried along the rows of a key: each row gets what stood before it."""

    def make():
        held: dict = {"key": None, "value": None}

        def f(batch):
            out: list = []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in (*keys, *columns)), strict=True):
                if key != held["key"]:
                    held.update(key=key, value=start)
                out.append(held["value"])
                held["value"] = step(held["value"], *row)
            return {"cid": batch.column("cid"), "piece": batch.column("piece"), "value": out}

        return f

    return make


def _composed(later, costs):
    """Costs from each place before a piece, from those after it."""
    v = [min(costs[4 * q + to] + later[to] for to in PLACES) for q in PLACES]
    return [min(x, _FAR) for x in v]


_EDITS = "cid string, piece int, seq int, edit string, turn long, was string, fault int, role string, text string"


def _repaired(machine: Automaton, key, rows):
    kinds, (place, end, last) = [r[0] for r in rows], rows[0][1:4]
    letters, _ = machine.trace(kinds, end, place)
    out: list[tuple] = []
    for own, (_, _, _, _, turn, role, text, fault) in zip(letters, rows, strict=True):
        for x in own[:-1]:
            place = _NEXT[place]
            out.append(("I", None, None, 0, _role(place), ""))
        x = own[-1]
        if x == "D":
            out.append(("D", turn, role, fault, None, None))
            continue
        place = _NEXT[place] if x == "R" else _KEEP[min("sua".find(role[:1]) % 4, 3)][place]
        out.append((x, turn, role, fault, _role(place) if x == "R" else role, text))
    while last and place in (1, 2):
        place = _NEXT[place]
        out.append(("I", None, None, 0, _role(place), ""))
    names = ("edit", "turn", "was", "fault", "role", "text")
    return {"cid": [key[0]] * len(out), "piece": [key[1]] * len(out), "seq": list(range(len(out)))} | {c: [r[i] for r in out] for i, c in enumerate(names)}


def _pieces(rows: DataFrame, columns: list[str], per_group, schema: str) -> DataFrame:
    dealt = rows.repartition("cid", "piece").sortWithinPartitions("cid", "piece", "turn", "role", "text", "copy")
    return arrow_pass(dealt, _grouped(["cid", "piece"], columns, per_group), schema)


def conv_key() -> Column:
    """conv_id as text; null is a space."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def judged(turns: DataFrame) -> DataFrame:
    """cid, turn, role, text, copy (of rows alike), fault (a number of FAULTS) and kind of every turn."""
    own = turns.select(conv_key().alias("cid"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    alike = own.groupBy("cid", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("same", F.sha2("text", 256))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    first = alike.groupBy("cid", "role", "same").agg(F.min(order).alias("first"))
    each = alike.join(first, ["cid", "role", "same"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    repeats = (F.col("copy") > 1) | (order > F.col("first"))
    fault = F.when(end == "", 1).when(repeats, 2).when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    known = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    out = each.select("cid", "turn", "role", "text", "copy", fault.alias("fault"), known.alias("known"))
    return out.withColumn("kind", F.when(F.col("fault").isin(1, 2), _GONE).otherwise(2 * F.col("known") + (F.col("fault") == 3).cast("int"))).drop("known")


def repair(turns: DataFrame, most: int = 20_000) -> DataFrame:
    """The edits of every conversation of a table (conv_id, turn, role, text), in the order of (cid, piece, seq).

    A row for each turn and each inserted one: cid (conv_id as text, a space for null), edit (K keep, R rerole, D delete, I insert), turn,
    was (its role), fault (see FAULTS) and, unless it is deleted, role and text as repaired. Of cheapest edits, the
    least string of letters is taken. Turns are taken by turn (nulls first), then role, text; null roles and texts are one space. A turn is
    blank (white space only), else a duplicate (role and text seen earlier), else truncated (no [.!?] at its end). Blank turns and duplicates
    are deleted. Rows that repeat are duplicates, other columns are ignored, an empty table has no edits, and
    a text of any length is read whole.
    """
    rows = saved(judged(turns).withColumn("weight", 1 + F.expr("length(text) div 1000")), "turns")
    large = rows.groupBy("cid").agg(F.sum("weight").alias("w")).where(F.col("w") > most).select("cid")
    whole = rows.join(large, "cid", "left_anti").withColumn("piece", F.lit(0))
    plain = whole.withColumns({"place": F.lit(0), "ends": F.array(*[F.lit(x).cast("long") for x in END]), "last": F.lit(True)})
    columns = ["kind", "place", "ends", "last", "turn", "role", "text", "fault"]
    out = _pieces(plain, columns, _repaired, _EDITS)
    if large.isEmpty():
        return out
    ranked = running_total(rows.join(large, "cid", "left_semi"), ["cid", "turn", "role", "text", "copy"], F.col("weight"), "total").withColumn("total", F.col("total") - F.col("weight"))
    starts = ranked.groupBy("cid").agg(F.min("total").alias("start"))
    cut = saved(ranked.join(starts, "cid").withColumn("piece", F.expr(f"cast((total - start) div {most} as int)")).drop("total", "start"), "pieces")
    costs = _pieces(cut, ["kind"], _summary, "cid string, piece int, costs array<long>")
    ends = saved(arrow_pass(costs.repartition("cid").sortWithinPartitions("cid", F.desc("piece")), _folded(["cid"], ["costs"], list(END), _composed), "cid string, piece int, value array<long>").withColumnRenamed("value", "ends"), "ends")
    exits = _pieces(cut.join(ends, ["cid", "piece"]), ["kind", "ends"], _exits, "cid string, piece int, exits array<int>")
    places = arrow_pass(exits.repartition("cid").sortWithinPartitions("cid", "piece"), _folded(["cid"], ["exits"], 0, lambda q, to: to[q]), "cid string, piece int, value int").withColumnRenamed("value", "place")
    final = ends.groupBy("cid").agg(F.max("piece").alias("final"))
    known = saved(ends.join(places, ["cid", "piece"]).join(final, "cid").withColumn("last", F.col("piece") == F.col("final")).drop("final"), "known")
    return out.unionByName(_pieces(cut.join(known, ["cid", "piece"]), columns, _repaired, _EDITS))
