"""Dependence structures over binned columns and the likelihoods that follow from them. Spark counts; the search sees one number per column set."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, permutations
from math import exp, lgamma, log, prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .ranks import first_row
from .scoring import pattern


def counted_patterns(binned: DataFrame, columns: list[str]) -> DataFrame:
    """Different rows of the columns with their number n; of a group's bins there are at most bins ** columns."""
    return binned.groupBy(*columns).agg(F.count("*").alias("n"))


def _log_factorial(n: Column) -> Column:
    """ln n!, exact to 12 digits: Stirling's series about n + 8, less the eight factors."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - sum((F.ln(n + F.lit(float(i))) for i in range(1, 9)), F.lit(0.0))


class SetSums:
    """For column sets: the sum of n ln n over their value counts n, and how many values occur; unknown sets share a job."""

    def __init__(self, patterns: DataFrame):
        self.patterns, self.known, self.tables = patterns, {}, {}

    def ask(self, sets: set[frozenset]) -> None:
        new = [s for s in sets if s not in self.known]
        if not new:
            return
        each = F.array(*[F.struct(F.lit(i).alias("i"), (pattern(sorted(s)) if s else F.lit("")).alias("v")) for i, s in enumerate(new)])
        counts = self.patterns.select("n", F.inline(each)).groupBy("i", "v").agg(F.sum("n").alias("n"))
        for r in counts.groupBy("i").agg(F.sum(F.col("n") * F.ln("n")).alias("h"), F.count("*").alias("k"), F.sum("n").alias("n")).collect():  # a row per set
            self.known[new[r["i"]]] = (r["h"], r["k"], r["n"])

    def k2(self, node: str, parents: frozenset) -> float:
        """Log marginal likelihood of a node under uniform priors of its table's rows; needs ask_counts()."""
        return self.tables[parents | {node}, node]

    def ask_counts(self, families: set[tuple[str, frozenset]]) -> None:
        """For k2(): counts of (parents, node) come from Spark with their log factorials summed, a number for each family."""
        new = [(n, ps) for n, ps in families if (ps | {n}, n) not in self.tables]
        if not new:
            return
        each = F.array(*[F.struct(F.lit(i).alias("i"), (pattern(sorted(ps)) if ps else F.lit("")).alias("g"), pattern([n]).alias("v")) for i, (n, ps) in enumerate(new)])
        cells = self.patterns.select("n", F.inline(each)).groupBy("i", "g", "v").agg(F.sum("n").alias("n"))
        rows = cells.groupBy("i", "g").agg(F.sum("n").alias("n"), F.sum(_log_factorial(F.col("n"))).alias("f"))
        kinds = F.element_at(F.array(*[F.lit(self.known[frozenset([n])][1]) for n, _ in new]), F.col("i") + 1)
        score = _log_factorial(kinds - 1) - _log_factorial(F.col("n") + kinds - 1) + F.col("f")
        for r in rows.groupBy("i").agg(F.sum(score).alias("s")).collect():  # a row for each family
            n, ps = new[r["i"]]
            self.tables[ps | {n}, n] = r["s"]

    def bic(self, node: str, parents: frozenset) -> float:
        own, given, one = self.known[parents | {node}], self.known[parents], self.known[frozenset([node])]
        free = (one[1] - 1) * prod(self.known[frozenset([p])][1] for p in parents)
        return own[0] - given[0] - 0.5 * log(own[2]) * free


def _reaches(parents: dict[str, frozenset], start: str, end: str) -> bool:
    """Whether start is end or one of its forebears."""
    todo, seen = [end], set()
    while todo:
        x = todo.pop()
        if x == start:
            return True
        if x not in seen:
            seen.add(x)
            todo += parents[x]
    return False


def hill_climb(binned: DataFrame, columns: list[str], most_parents: int | None = None, score: str = "bic") -> dict[str, list[str]]:
    """Parents of each column: the arc whose addition, removal or reversal raises the score (bic or k2) most, until none does.

    Ties go to the first move by name. An empty table or a single column has no arcs.
    """
    sums, parents = SetSums(saved(counted_patterns(binned, columns), "patterns")), {c: frozenset() for c in columns}
    most = len(columns) if most_parents is None else most_parents
    sums.ask({frozenset()} | {frozenset([c]) for c in columns})
    if len(columns) < 2 or frozenset() not in sums.known:
        return {c: [] for c in columns}
    of = sums.bic if score == "bic" else sums.k2
    while True:
        moves = []
        for a, b in permutations(sorted(columns), 2):
            if a in parents[b]:
                less = parents | {b: parents[b] - {a}}
                moves.append(((a, b, "drop"), less))
                if len(parents[a]) < most and not _reaches(less, a, b):
                    moves.append(((a, b, "turn"), less | {a: parents[a] | {b}}))
            elif len(parents[b]) < most and not _reaches(parents, b, a):
                moves.append(((a, b, "add"), parents | {b: parents[b] | {a}}))
        changed = [[c for c in columns if new[c] != parents[c]] for _, new in moves]
        if score == "bic":
            sums.ask({s for (_, new), cs in zip(moves, changed, strict=True) for c in cs for s in (new[c], new[c] | {c})})
        else:
            sums.ask_counts({(c, ps) for (_, new), cs in zip(moves, changed, strict=True) for c in cs for ps in (new[c], parents[c])})
        gain = lambda m, cs: sum(of(c, m[1][c]) - of(c, parents[c]) for c in cs)
        best = max(zip(moves, changed, strict=True), key=lambda x: gain(*x))
        if gain(*best) <= 1e-9:
            return {c: sorted(parents[c]) for c in columns}
        parents = best[0][1]


def learned_networks(binned: DataFrame, groups: list[list[str]], most_parents: int | None = None) -> dict[int, dict[str, list[str]]]:
    """Parents by group: BIC, and K2 where BIC finds no arc; groups of one column are left out."""
    out = {}
    for i, g in enumerate(groups):
        if len(g) > 1:
            found = hill_climb(binned, g, most_parents)
            out[i] = found if any(found.values()) else hill_climb(binned, g, most_parents, "k2")
    return out


def dependence_test(sums: SetSums, a: str, b: str, given: frozenset) -> tuple[float, int]:
    """G statistic of a and b given other columns, and its degrees of freedom, from the sums of n ln n over value counts."""
    sets = given | {a, b}, given | {a}, given | {b}, given
    h = [sums.known[frozenset(s)][0] for s in sets]
    kinds = {c: sums.known[frozenset([c])][1] for c in (a, b)}
    free = (kinds[a] - 1) * (kinds[b] - 1) * prod(sums.known[frozenset([c])][1] for c in given)
    return 2 * (h[0] - h[1] - h[2] + h[3]), max(1, free)


def chi_square_tail(x: float, free: int) -> float:
    """P(chi-square > x), by the series of the lower or the continued fraction of the upper incomplete gamma function."""
    a, y = free / 2, max(0.0, x) / 2
    if y == 0:
        return 1.0
    front = exp(-y + a * log(y) - lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = y + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def skeleton(binned: DataFrame, columns: list[str], alpha: float = 0.05, most_given: int = 3) -> tuple[set[frozenset], dict[frozenset, frozenset]]:
    """Undirected arcs of the PC search and the sets that separated the other pairs: pairs stay while no set of neighbours makes them independent.

    Each level asks Spark for all its column sets in one job; neighbours are those of the level's start, so the order of columns does not matter.
    """
    sums = SetSums(saved(counted_patterns(binned, columns), "patterns"))
    sums.ask({frozenset()} | {frozenset([c]) for c in columns})
    arcs, apart = {frozenset(p) for p in combinations(sorted(columns), 2)}, {}
    if frozenset() not in sums.known:
        return set(), {}
    for size in range(most_given + 1):
        near = {c: {x for arc in arcs if c in arc for x in arc if x != c} for c in columns}
        tests = []
        for arc in sorted(arcs, key=sorted):
            a, b = sorted(arc)
            given = {frozenset(s) for x, y in ((a, b), (b, a)) for s in combinations(sorted(near[x] - {y}), size)}
            tests += [(arc, a, b, s) for s in sorted(given, key=sorted)]
        if not tests:
            break
        sums.ask({frozenset(x) for _, a, b, s in tests for x in (s, s | {a}, s | {b}, s | {a, b})})
        for arc, a, b, s in tests:
            if arc in arcs and chi_square_tail(*dependence_test(sums, a, b, s)) > alpha:
                arcs.discard(arc)
                apart[arc] = s
    return arcs, apart


def pc_arcs(binned: DataFrame, columns: list[str], alpha: float = 0.05, most_given: int = 3) -> dict[str, list[str]]:
    """Parents of each column by the PC search: colliders first, then arcs that would make a new collider or a cycle the other way; the rest by name."""
    arcs, apart = skeleton(binned, columns, alpha, most_given)
    into: set[tuple[str, str]] = set()
    for b in sorted(columns):
        for a, c in combinations(sorted({x for arc in arcs if b in arc for x in arc if x != b}), 2):
            if frozenset((a, c)) not in arcs and b not in apart.get(frozenset((a, c)), frozenset()):
                into |= {(x, b) for x in (a, c) if (b, x) not in into}

    def parents() -> dict[str, frozenset]:
        return {c: frozenset(a for a, b in into if b == c) for c in columns}

    def settle() -> bool:
        for arc in sorted(arcs, key=sorted):
            for a, b in (sorted(arc), sorted(arc)[::-1]):
                if (a, b) in into or (b, a) in into:
                    continue
                forced = any((x, a) in into and frozenset((x, b)) not in arcs for x in columns if x not in (a, b)) or _reaches(parents(), a, b)
                if forced and not _reaches(parents(), b, a):
                    into.add((a, b))
                    return True
        return False

    while True:
        while settle():
            pass
        left = [sorted(arc) for arc in sorted(arcs, key=sorted) if not {tuple(sorted(arc)), tuple(sorted(arc)[::-1])} & into]
        if not left:
            return {c: sorted(ps) for c, ps in parents().items()}
        a, b = left[0]
        into.add((a, b) if not _reaches(parents(), b, a) else (b, a))


def factorised_log_likelihood(binned: DataFrame, parents: dict[str, list[str]], name: str = "ll", table_of: DataFrame | None = None) -> DataFrame:
    """binned with the sum over nodes of ln P(node | parents); what ``table_of`` (the rows themselves) never shows counts -10.

    Without parents this is the independence model. Nulls are a value of their own.
    """
    out, terms = binned, []
    for i, (node, given) in enumerate(parents.items()):
        family = pattern([*given, node]).alias("_v"), (pattern(given) if given else F.lit("")).alias("_g")
        counts = (binned if table_of is None else table_of).groupBy(*family).agg(F.count("*").alias("_n"))
        # A saved table of at most bins ** columns rows: looking it up never counts the rows again.
        table = saved(counts.select("_v", F.ln(F.col("_n") / F.sum("_n").over(Window.partitionBy("_g"))).alias(f"_{i}")), "conditional")
        out = out.join(table, pattern([*given, node]) == F.col("_v"), "left").drop("_v")
        terms.append(F.coalesce(f"_{i}", F.lit(-10.0)))
    return out.withColumn(name, sum(terms, F.lit(0.0))).drop(*[f"_{i}" for i in range(len(terms))])


def distance_log_likelihood(binned: DataFrame, columns: list[str], name: str = "ll") -> DataFrame:
    """binned with -5 * distance from the mean code / greatest distance; -1 where all rows are alike."""
    means = first_row(binned, *[F.avg(c) for c in columns])
    d = F.sqrt(sum((F.pow(F.col(c) - F.lit(m), F.lit(2.0)) for c, m in zip(columns, means, strict=True)), F.lit(0.0)))
    top = first_row(binned, F.max(d))[0] or 0.0
    return binned.withColumn(name, -5 * d / F.lit(top) if top > 0 else F.lit(-1.0))


# What a node adds whose parents' values were never seen, and one whose own value was never seen with them.
UNSEEN_PARENTS, NEVER = -5.0, -10.0
#: Cells of all tables of a model at most: they are part of the plan.
_CELLS = 1 << 20


@dataclass(frozen=True)
class ConditionalTables:
    """ln P(node | parents) of every node of every group's network, as flat tables that a mixed-radix code of the bins addresses.

    A table has (bins + 1) ** (parents + 1) cells, null being a value, so a row's likelihood is one lookup for each node: no join, and
    one pass over the rows for all groups. Values that fitting did not see are unseen.
    """

    bins: int
    networks: dict[int, dict[str, list[str]]]
    cells: dict[tuple[int, str], list[float]]

    @classmethod
    def fit(cls, binned: DataFrame, networks: dict[int, dict[str, list[str]]], bins: int) -> ConditionalTables:
        """networks: parents of each node by group. One job counts all families; the driver sees at most as many rows as there are cells."""
        nodes = [(g, n, ps) for g, net in networks.items() for n, ps in net.items()]
        if sum((bins + 1) ** (len(ps) + 1) for _, _, ps in nodes) > _CELLS:
            raise ValueError(f"tables of more than {_CELLS} cells: learn networks with fewer parents")
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(cls._code([*ps, n], bins)).alias("code")) for i, (_, n, ps) in enumerate(nodes)])
        counts: dict[int, dict[int, int]] = {i: {} for i in range(len(nodes))}
        for r in binned.select(F.inline(each)).groupBy("i", "code").agg(F.count("*").alias("n")).collect():  # a row for each cell
            counts[r["i"]][r["code"]] = r["n"]
        cells = {}
        for i, (g, n, ps) in enumerate(nodes):
            out = [UNSEEN_PARENTS] * (bins + 1) ** (len(ps) + 1)
            for first in range(0, len(out), bins + 1):
                own = [counts[i].get(first + d, 0) for d in range(bins + 1)]
                if sum(own):
                    out[first : first + bins + 1] = [log(c / sum(own)) if c else NEVER for c in own]
            cells[g, n] = out
        return cls(bins, networks, cells)

    @staticmethod
    def _code(columns: list[str], bins: int) -> str:
        code = "0"
        for c in columns:
            code = f"({code} * {bins + 1} + coalesce(`{c}`, {bins}))"
        return f"cast({code} as int)"

    def log_likelihood(self, group: int) -> Column:
        """The group's sum over its nodes, of binned rows."""
        terms = F.lit(0.0)
        for n, ps in self.networks[group].items():
            table = F.split(F.lit(",".join(map(repr, self.cells[group, n]))), ",").cast("array<double>")  # folded to a constant
            terms = terms + F.coalesce(F.get(table, F.expr(self._code([*ps, n], self.bins))), F.lit(UNSEEN_PARENTS))
        return terms


#: Ways to learn structures; another one is independence.
STRUCTURES = ("independence", "bic", "hc", "pc")


def learn_structures(binned: DataFrame, groups: list[list[str]], method: str = "hc", most_parents: int | None = None) -> dict[int, dict[str, list[str]]]:
    """Parents by group: hill climbing (bic; hc takes K2 where BIC finds no arc), the PC search, or no arcs at all. Every group has a network."""
    if method == "bic":
        found = {i: hill_climb(binned, g, most_parents) for i, g in enumerate(groups) if len(g) > 1}
    elif method == "hc":
        found = learned_networks(binned, groups, most_parents)
    elif method == "pc":
        found = {i: pc_arcs(binned, g) for i, g in enumerate(groups) if len(g) > 1}
    else:
        found = {}
    return {i: found.get(i, {c: [] for c in g}) for i, g in enumerate(groups)}


def network_info(spark, networks: dict[int, dict[str, list[str]]]) -> DataFrame:
    """group_id, n_features, features, n_nodes, n_edges of each network."""
    rows = [(i, len(net), ",".join(net), len(net), sum(map(len, net.values()))) for i, net in networks.items()]
    return spark.createDataFrame(rows, "group_id long, n_features long, features string, n_nodes long, n_edges long")
