import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from patternscore.llm.packing import Sweep, Tokens, pack, piece_bounds, sequences, stretches

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def encode(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return t.encode(text or "", add_special_tokens=False).ids + [2]


ROWS = [(1, None), (2, ""), (3, "Hello, world. It's\n a test"), (4, "two  spaces \n\n x"), (5, " lead"), (6, "trail "), (7, "été 日本 \U0001f600 "), (8, "word " * 3000 + "end"), (9, "x" * 5000), (9, "x" * 5000), (10, "a b  c"), (11, "<|endoftext|> a"), (12, "a b<|endoftext|>c <|endoftext|>"), (12, "a b<|endoftext|>c <|endoftext|>"), (None, "null id")]
ROWS += [(100 + i, " ".join(random.Random(i).choice(["ab", "Cde,", "fgh.\nIj", "12", "-"]) for _ in range(random.Random(i).randrange(700)))) for i in range(60)]


def best_fit(lengths):
    """Sequences that one-by-one best fit opens, longest piece first."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 1024) - x)
    return len(rooms)


def test_ids_pieces_and_sequences(spark):
    df = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, length int").repartition(5)
    got = pack(df, PATH, with_ids=True).collect()
    want = sorted((repr(d), p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for d, t in ROWS for ids in [encode(t)] for p, (a, b) in enumerate(zip(piece_bounds(len(ids), 1024), piece_bounds(len(ids), 1024)[1:], strict=False)))
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) == best_fit([r["length"] for r in got])


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def placed_well(spark, lengths, per_task, most=1024):
    """Number of sequences, after every piece was found once and every sequence without gaps."""
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    got = sequences(df, most, per_task).collect()
    assert sorted(r["id"] for r in got) == list(range(len(lengths)))
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], lengths[r["id"]]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(seqs)


def lengths_of(kind, rng, n):
    if kind == "even":
        return [rng.randrange(1, 1024) for _ in range(n)]
    if kind == "small":
        return [rng.randrange(1, 30) for _ in range(n)]
    if kind == "hot":  # a third of all pieces have one length
        return [300 if rng.random() < 1 / 3 else rng.randrange(1, 600) for _ in range(n)]
    return [min(1023, int(rng.expovariate(1 / 120)) + 1) for _ in range(n)]


@pytest.mark.parametrize("kind", ["even", "small", "hot", "falling"])
def test_one_task_is_best_fit_and_many_are_near(spark, kind):
    lengths = lengths_of(kind, random.Random(kind), 1500)
    best = best_fit(lengths)
    assert placed_well(spark, lengths, 10**6) == best
    assert placed_well(spark, lengths, 200) <= best + 12  # a task may leave one sequence part filled


def test_sweep_takes_the_successor():
    s = Sweep(1024)
    for seq, room in ((1, 500), (2, 300), (3, 301)):
        s.add(seq, room)
    assert s.place(9, 301) == (3, 723) and s.place(10, 301) == (1, 524) and s.place(11, 301) is None
    assert s.place(12, 199) == (1, 825) and s.left() == [(2, 300)]
    assert Sweep(10, opening=True).place(7, 4) == (7, 0)


def test_stretches_settle_who_gets_what():
    assert stretches([(0, 100, 0), (1, 50, 0), (2, 0, 70), (3, 5, 40), (4, 0, 1)]) == [(1, 0, 50, 2), (0, 0, 20, 2), (0, 20, 60, 3), (3, 0, 1, 4)]


def test_memo_forgets_nothing(monkeypatch):
    monkeypatch.setattr("patternscore.llm.packing._MEMO", 2)
    t = Tokens(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() + [2] for x in t.batch([r[1] or "" for r in ROWS])] == [encode(r[1]) for r in ROWS]
