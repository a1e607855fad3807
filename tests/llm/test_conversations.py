import random
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import pytest

from patternscore.llm.conversations import repair
from patternscore.llm.q_conversations import op13_conversation_repair, repaired_digest

SPACE = " \t\n\x0b\f\r"


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 0:
            continue
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        out += [(c, t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    return out


def brute_repair(turns):
    """turns: (turn, role, text) in order. Cheapest edits by plain recursion over all of them."""
    faults, seen = [], set()
    for _, r, x in turns:
        last = x.rstrip(SPACE)[-1:]
        faults.append("blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last not in ".!?" else "")
        seen.add((r, x))

    def after(place, initial):
        """Places by what stands before: '' at first, then the last initial."""
        return initial if place + initial in ("s", "u", "su", "ua", "au") else None

    @lru_cache(None)
    def best(i, place, inserted):
        out = []
        if i == len(turns) and place in ("", "a"):
            out.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if after(place, role[0]):
                    c, a, kept = best(i, role[0], inserted + 1)
                    out.append((c + 3, "I" + a, (f"{role}:", *kept)))
        if i < len(turns):
            _, r, x = turns[i]
            c, a, kept = best(i + 1, place, 0)
            out.append((c + 4, "D" + a, kept))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                for letter, role, cost in (("K", r, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if role and after(place, role[0]):
                        c, a, kept = best(i + 1, role[0], 0)
                        out.append((c + cost + more, letter + a, (f"{role}:{x}", *kept)))
        return min(out, key=lambda o: o[:2]) if out else (10**9, "", ())

    cost, audit, kept = best(0, "", 0)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(kept).encode()).hexdigest()


def brute(rows):
    left = {}
    for c, t, r, x in brute_damage(rows):
        left.setdefault(c, []).append((t, r, x))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(((c, *brute_repair(tuple(sorted(left.get(c, []), key=order)))) for c in {r[0] for r in rows}), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, cid string, piece int"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, rows):
    got = repaired_digest(spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3))
    assert [r for r in sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)] == brute(rows)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No!", "Why?", "well", "so it is", "", " \t", "Yes. ", "É.", "end.\n"]
    rows = []
    for c in range(400):
        at = 0
        for _ in range(rng.choice([1, 2, 3, 5, 9, 14])):
            at += rng.choice([0, 1, 1, 1, 3])
            rows.append((c, at, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Users"]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}."))
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (500, None, "user", None), (500, None, "assistant", "A."), (501, 2, None, "A."), (502, 1, "user", "x" * 200_000)]
    rows += [(503, 7, "user", "Same.")] * 3
    check(spark, rows)


@pytest.mark.parametrize("most", [1, 3, 7])
def test_pieces_are_repaired_as_one(spark, most):
    """Conversations cut into pieces get the edits that they get whole."""
    rng = random.Random(most)
    rows = [(c, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{i}.", f"{i}!", f"{i}"])) for c in range(6) for i in range(rng.choice([2, 20, 45]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda n: sorted((r["cid"], r["piece"], r["seq"], r["edit"], r["turn"], r["role"], r["text"]) for r in repair(df, n).collect())
    strip = lambda found: [(c, *r) for c, _, _, *r in found]
    assert strip(sorted(((c, p, s, e, str(t), str(r), str(x)) for c, p, s, e, t, r, x in key(most)))) == strip(sorted((c, p, s, e, str(t), str(r), str(x)) for c, p, s, e, t, r, x in key(10_000)))


def test_query_over_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_conversation_repair(spark, "/root/testdata/sf0.01")
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert repaired_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
