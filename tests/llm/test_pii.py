import hashlib
import random
import re

from patternscore.llm.pii import KINDS, candidate_spans, find_pii, reliabilities

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def said(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def card(rng, n=16):
    d = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def corpus():
    rng = random.Random(6)
    bits = ["a@b.c_d@e.f", "x.y+z%1@mail.example.com", "a@b@c.de", "@x.y", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1", "1.2..3.4.5.6", "007.0.0.255", "+1 (743) 555-3824", "+49.30.1234567-", "+1", "++12345678901", "+1234567890123456", "4111 1111 1111 1111", "4111-1111-1111-1112", "12345678901234567890123", "\U0001f600é", "日本", "call 743-555-3824 now", "mail me: joe (at) site (dot) com", "phone: (212) 555-0199", "\n", " word ", "order 4000-1234", "."]
    rows = []
    for d in range(150):
        parts = [rng.choice([*bits, card(rng), " ".join(re.findall("....", card(rng))), card(rng, 14), card(rng, 19)]) for _ in range(rng.randrange(8))]
        rows.append((d, rng.choice(["", " ", ", "]).join(parts)))
    rows += [(900, None), (901, ""), (902, "9" * 120_000), (903, "a" * 120_000), (904, "a.b-" * 30_000 + "@c"), (905, "1." * 50_000), (906, "x@y.z " * 2000), (907, "+" + "1 " * 40_000), (908, "a@b" + ".c" * 30_000), (909, "7 " * 60_000), (910, "word " * 24_000), (5, rows[5][1]), (None, "me@here.org")]
    return rows


def test_base_spans_match_plain_regexes(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], "doc_id long, text string, spans string, kind int")
    got = sorted((tuple(r) for r in find_pii(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()), key=repr)
    want = []
    for d, t in rows:
        b = brute(t)
        want.append((d, *[sum(k == i for _, k, _ in b) for i in range(4)], hashlib.sha256(said(b).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_spans_hold_base_and_added_ones(spark):
    rows = [(i, f"text {i} phone +1 (743) 555-38{i:02d} and mail u{i}@mail.example.com , ip 10.0.0.{i} then") for i in range(60)]
    rows += [(100, "please call phone (743) 555-3824 today"), (101, "nothing at all 12 here"), (102, "token 9743-555-38245")]
    got = {r["doc_id"]: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        spans = got[d]["spans"].split(",") if got[d]["spans"] else []
        assert set(said([x]) for x in brute(t)) <= set(spans)
    assert got[100]["spans"] == "phone:18:32"
    assert got[101]["spans"] == "" and got[102]["spans"] == ""


def test_full_ipv6_addresses_are_judged(spark):
    rows = [(i, f"text {i} from ip 10.0.0.{i} then") for i in range(60)]
    v6 = {100: "2001:0db8:85a3:0000:0000:8a2e:0370:7334", 101: "fe80:0:0:0:202:b3ff:fe1e:8329"}
    rows += [(d, f"the address {v} answers") for d, v in v6.items()]
    rows += [(110 + i, f"hash is 9{i}:3e:a7:0{i}:5c:d1:44:b{i} end") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in candidate_spans(df).collect()}
    assert all(len(s) == 1 for s in found.values())
    got = {r["doc_id"]: r for r in find_pii(df).collect()}
    for d, v in v6.items():
        assert got[d]["spans"] == f"ip:12:{12 + len(v)}" and got[d]["n_ip"] == 0
    assert all(got[110 + i]["spans"] == "" for i in range(5))
    assert all(got[i]["spans"] == said(brute(t)) for i, t in rows[:60])


def test_planted_looser_forms_and_decoys(spark):
    """Precision and recall of added spans: the looser forms are planted in prose beside things that only look like them."""
    rng = random.Random(12)
    say = lambda *w: rng.choice(w)
    rows, want = [], {}

    def put(d, before, span, kind, after, good):
        text = f"{rng.choice(['so', 'well', 'then'])} {before} {span}{after}"
        rows.append((d, text))
        at = text.index(span)
        want[d] = f"{kind}:{at}:{at + len(span)}" if good else ""

    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for i in range(300):
        rows.append((i, f"{say('call', 'phone', 'tel')} +1 {rng.randrange(201, 989)} 555 {n(4)} or {say('mail', 'contact', 'write')} u{i}@site{i % 7}.com , {say('server', 'host', 'ip')} 10.0.{i % 200}.7 ; card {card(rng)}."))
    good = {
        "phone": lambda: (say("call", "phone", "tel", "fax"), say(f"({rng.randrange(201, 989)}) {rng.randrange(201, 989)}-{n(4)}", f"0{rng.randrange(30, 99)} {rng.randrange(200, 989)} {n(4)}")),
        "email": lambda: (say("mail", "contact", "write"), say(f"joe{n(2)} (at) site{n(1)} (dot) com", f"ann{n(2)} at place{n(1)} dot org", f"bo{n(2)}[at]inst{n(1)}.edu")),
        "ip": lambda: (say("server", "host", "address"), say(f"2001:db8::{n(3)}:{n(2)}", f"fe80::{n(3)}", f"2001:db8:0:0:{n(3)}:8a2e:{n(3)}:1")),
    }
    bad = {
        "phone": lambda: (say("order", "invoice", "serial", "isbn"), f"{rng.randrange(100, 199)}-{rng.randrange(100, 199)}-{n(4)}"),
        "ip": lambda: (say("hash", "token", "build", "id"), ":".join(f"{rng.randrange(256):02x}" for _ in range(8))),
    }
    d = 1000
    for kinds, ok in ((good, True), (bad, False)):
        for kind, make in kinds.items():
            for _ in range(40):
                before, span = make()
                put(d, before, span, kind, say(" today", ".", ", thanks", " then"), ok)
                d += 1
    got = {r["doc_id"]: r["spans"] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(bool(w) and got[k] == w for k, w in want.items())
    false = sum(not w and got[k] != "" for k, w in want.items())
    assert hits / sum(bool(w) for w in want.values()) >= 0.9
    assert false <= 0.05 * sum(not w for w in want.values())
    assert all(got[i] == said(brute(t)) for i, t in rows[:300])


def test_no_rows_and_no_spans(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_pii(none).collect() == []
    r = find_pii(spark.createDataFrame([(1, "clean")], "doc_id long, text string")).first()
    assert r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_reliabilities_find_the_good_labelers():
    rng = random.Random(0)
    seen = {}
    for _ in range(6000):
        y = rng.random() < 0.4
        votes = tuple((1 if (rng.random() < a) == y else -1) if rng.random() < 0.8 else 0 for a in (0.95, 0.9, 0.85, 0.7, 0.5))
        seen[votes] = seen.get(votes, 0) + 1
    prior, odds = reliabilities([(0, v, n) for v, n in seen.items()])
    gain = [odds[(0, i, 1)] - odds[(0, i, -1)] for i in range(5)]
    assert gain[0] > gain[2] > gain[3] > 0.5 and abs(gain[4]) < 0.5
    assert abs(1 / (1 + 2.718281828 ** -prior[0]) - 0.4) < 0.05


def test_contexts_are_those_of_the_text(spark):
    rows = corpus()[:150]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = 0
    for r, (_, text) in zip(sorted(candidate_spans(df).collect(), key=lambda r: r["doc_id"]), rows, strict=True):
        for s in r["spans"]:
            assert text[s["start"] : s["end"]] == s["value"] and s["left"] == text[max(0, s["start"] - 40) : s["start"]]
            assert s["right"][:1] == text[s["end"] : s["end"] + 1] and text[s["end"] :].startswith(s["right"])
            seen += 1
    assert seen > 200


def test_a_text_of_very_many_matches(spark):
    """100,000 mails, and 30,000 spans of which 20,000 are looser forms, each text in one task."""
    import time

    many, mixed = "ab@cd.com " * 100_000, "ab@cd.com or call (212) 555-0199 or joe (at) site (dot) com " * 10_000
    began = time.time()
    got = {r["doc_id"]: r for r in find_pii(spark.createDataFrame([(1, many), (2, mixed)], "doc_id long, text string").repartition(2)).collect()}
    assert got[1]["n_email"] == 100_000 and got[2]["n_email"] == 10_000
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(f"email:{10 * i}:{10 * i + 9}" for i in range(100_000)).encode()).hexdigest()
    assert time.time() - began < 150
