"""Personal data by weak supervision, in DataFrame and SQL functions only.

One pass finds every candidate span: the base patterns (which stay whatever the method says) and looser ones. Labelers
(format, checksum, gazetteers, context words, surroundings) vote for, against or not at all on each. Expectation-maximisation
estimates each labeler's reliability without labels; votes take few values, so the count of each vote pattern says all that it needs.
The resulting probabilities train a logistic span classifier on votes, shapes and the word before the span, which decides which looser spans are added.
"""

from __future__ import annotations

from functools import reduce
from math import exp, log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive quantifiers keep Java's matcher off its stack; look-behinds spare starts that cannot match. Both leave the matches as they are.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # shorter runs are no cards
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms of the same kinds. A name has 64 characters at most and a label of a domain 63, as mail and host names are defined.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}(?:\x20?(?:\(at\)|\[at\])\x20?[a-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[a-z0-9-]{1,63})+|\x20@\x20[a-z0-9-]{1,63}(?:\x20?\.\x20?[a-z0-9-]{2,63})+|\x20at\x20[a-z0-9-]{1,63}(?:\x20dot\x20[a-z0-9-]{2,63})+)",
    "ip": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(./-])(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}|\(?0[1-9][0-9]{1,3}\)?[/\x20-]{1,3}[0-9]{3,4}[\x20-]?[0-9]{3,4})(?![0-9-])",
}
#: Cheap patterns that a text must hold for a base or a looser match to be possible.
NEEDS = {
    ("email", True): r"@",
    ("ip", True): r"[0-9]\.[0-9]++\.[0-9]",
    ("card", True): r"[0-9](?:[\x20-]?[0-9]){13}",
    ("phone", True): r"\+[0-9]",
    ("email", False): r"[(\[][aA][tT][)\]]|\x20@\x20|(?i:\x20at\x20[a-z0-9-]+\x20dot\x20)",
    ("ip", False): r"::|:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:",
    ("card", False): r"[0-9]\.[0-9]{4}\.[0-9]",
    ("phone", False): r"[0-9][.\x20-][0-9]{4}|0[1-9][0-9]{1,3}\)?[/\x20-]",
}
#: Matches of a text are gathered in runs of so many, so that a text of very many matches stays cheap.
_RUN = 128

# Gazetteers and context words of the labelers.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co")
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|courriel|correo|reach)\b",
    "ip": r"(?i)\b(?:ip(?:v[46])?|address|host|server|adresse|login|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono|whatsapp|sms)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|invoice|order|serial|section|chapter|build|token|hash|sha|id|price|page)\b"
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
COUNTRY_CODES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"

#: Ranges in use of IPv6 (global, unique local, link-local, multicast, and zero for loopback and the like), and eight single bytes: a key's fingerprint or a hardware address.
V6_STARTS = r"(?i)^(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]|ff[0-9a-f]{2}|0{0,4}):"
BYTES = r"^(?:[0-9A-Fa-f]{2}:){7}[0-9A-Fa-f]{2}$"

#: Characters before and after a span that labelers look at, and buckets of the word before it that the classifier knows.
LEFT, RIGHT, NEAR = 40, 20, 32

VOTES = ("format", "checksum", "gazetteer", "context", "surroundings")


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once: within a lambda, an expression that is not bound is computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _valid(kind: str, value: Column, base: bool) -> Column:
    if kind == "ip" and base:  # the looser form, IPv6, is well formed by its pattern
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, kind: str, base: bool) -> Column:
    """Structs of all matches, leftmost and non-overlapping: the text is cut into (gap, match) pairs, whose lengths give the places.

    What stands before a match is the end of the gaps and matches so far, what stands after it the beginning of the next ones, so nothing is
    looked up in the text and the work grows with its length.
    """
    pattern = f"([\\s\\S]*?)(?:({(BASE if base else LOOSE)[kind]})|\\z)"
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("found"))
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), *[F.lit("").alias(c) for c in ("value", "left", "right")])), 2, 1)

    def placed(cut: Column) -> Column:
        def place(acc: Column, i: Column) -> Column:
            gap, value = F.get(cut["gaps"], i), F.get(cut["found"], i)
            at, left = acc["at"] + F.length(gap), F.right(F.concat(acc["tail"], gap), F.lit(LEFT))
            after = [F.coalesce(F.substring(F.get(cut[c], i + 1), 1, RIGHT), F.lit("")) for c in ("gaps", "found")]
            right = F.substring(F.concat(*after), 1, RIGHT)
            one = F.array(F.struct(at.alias("start"), value.alias("value"), left.alias("left"), right.alias("right")))
            out = F.when(value == "", acc["out"]).otherwise(F.concat(acc["out"], one))
            return F.struct((at + F.length(value)).alias("at"), F.right(F.concat(left, value), F.lit(LEFT)).alias("tail"), out.alias("out"))

        def place_run(acc: Column, run: Column) -> Column:
            own = F.sequence(run * _RUN, F.least(run * _RUN + (_RUN - 1), F.size(cut["found"]) - 1))
            start = F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), none.alias("out"))
            return F.aggregate(own, start, place, lambda r: F.struct(r["at"].alias("at"), r["tail"].alias("tail"), F.concat(acc["out"], r["out"]).alias("out")))

        runs = F.sequence(F.lit(0), F.floor((F.size(cut["found"]) - 1) / _RUN).cast("int"))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")), place_run, lambda acc: acc["out"])

    def span(x: Column) -> Column:
        names = {"start": x["start"], "kind": F.lit(KINDS.index(kind)), "end": x["start"] + F.length(x["value"]), "base": F.lit(base), "valid": _valid(kind, x["value"], base), "value": x["value"], "left": x["left"], "right": x["right"]}
        return F.struct(*[c.alias(n) for n, c in names.items()])

    return F.when(text.rlike(NEEDS[kind, base]), F.transform(_bound(cut, placed), span)).otherwise(F.array().cast(_SPANS))


def _alone(spans: Column) -> Column:
    """Base spans, and the others that overlap none. Base spans are looked through by runs, sorted by their starts."""
    base = F.array_sort(F.transform(F.filter(spans, lambda s: s["base"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def runs(b: Column) -> Column:
        def run(r: Column) -> Column:
            own = F.slice(b, r * _RUN + 1, F.lit(_RUN))
            return F.struct(F.array_min(own)["start"].alias("low"), F.array_max(F.transform(own, lambda s: s["end"])).alias("high"), own.alias("own"))

        return F.when(F.size(b) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(b) - 1) / _RUN).cast("int")), run)).otherwise(F.array())

    def clear(r: Column) -> Column:
        meets = lambda s: F.exists(r, lambda x: (x["low"] < s["end"]) & (x["high"] > s["start"]) & F.exists(x["own"], lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
        return F.filter(spans, lambda s: s["base"] | ~meets(s))

    return _bound(_bound(base, runs), clear)


_SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,valid:boolean,value:string,left:string,right:string>>"


def candidate_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: all base matches and looser candidates of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [_matches(F.col("text"), k, b) for k in KINDS for b in (True, False)]
    # Looser matches are all candidates. A base match that fails its test is one of a kind only if it is a long digit run.
    keep = F.filter(F.concat(*parts), lambda s: ~s["base"] | s["valid"] | ((s["kind"] == 2) & F.length(_digits(s["value"])).between(14, 19)))
    spans = F.transform(keep, lambda s: s.withField("base", s["base"] & s["valid"]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", spans.alias("spans"))


def _by_kind(cases: dict[int, Column]) -> Column:
    out = F.lit(0)
    for k, c in cases.items():
        out = F.when(F.col("kind") == k, c).otherwise(out)
    return out.cast("int")


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return out.when(no, -1).otherwise(0) if no is not None else out.otherwise(0)


def labeled(spans: DataFrame) -> DataFrame:
    """A row per candidate with its votes (1, 0, -1) and shapes."""
    value, digits = F.col("value"), _digits(F.col("value"))
    strict = F.col("base")
    v6 = value.contains(":")
    votes = {
        "format": _vote(strict, ~F.col("valid")),
        "checksum": _by_kind({1: _vote(F.col("valid") & ~(v6 & value.rlike(BYTES)), v6 & value.rlike(BYTES)), 2: _vote(_luhn(digits), ~_luhn(digits)), 3: _vote(F.length(digits).between(10, 15), F.length(digits) < 10)}),
        "gazetteer": _by_kind({
            0: _vote(F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAIN_ENDS), ~value.rlike(r"[A-Za-z]{2,}$")),
            1: F.when(v6, _vote(value.rlike(V6_STARTS), ~value.rlike(V6_STARTS))).otherwise(_vote(value.rlike(r"^(?:10|127|192\.168|172)\.") | value.rlike(r"^[1-9][0-9]{1,2}\."), value.rlike(r"^0"))),
            2: _vote(digits.rlike(CARD_STARTS), ~digits.rlike(r"^[2-6]")),
            3: _vote(F.when(value.startswith("+"), digits.rlike(COUNTRY_CODES)).otherwise(digits.rlike(r"^(?:[2-9]..[2-9]|0[1-9])")), digits.rlike(r"^(?:0000|1234)")),
        }),
        "context": _vote(reduce(lambda a, k: a | ((F.col("kind") == k) & F.col("left").rlike(CONTEXT[KINDS[k]])), range(len(KINDS)), F.lit(False)), F.col("left").rlike(AGAINST)),
        "surroundings": _vote(F.col("left").rlike(r"(?:^|[\s(\[<:;,\"'])$") & F.col("right").rlike(r"^(?:$|[\s)\]>.;,!?\"'])"), F.col("left").rlike(r"[A-Za-z0-9]$") | F.col("right").rlike(r"^[A-Za-z0-9]")),
    }
    shapes = {"long": (F.length(value) > 20).cast("int"), "grouped": value.rlike(r"[0-9][ .()-]+[0-9]").cast("int"), "letters": value.rlike("[A-Za-z]").cast("int"), "loose": (~strict).cast("int")}
    word = F.lower(F.regexp_extract("left", r"(\p{L}+)\P{L}*$", 1))
    near = F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(word), F.lit(NEAR))).cast("int")
    return spans.select(*spans.columns, *[v.cast("int").alias(k) for k, v in votes.items()], *[v.alias(f"is_{k}") for k, v in shapes.items()], near.alias("near"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> tuple[dict[int, float], dict[tuple[int, int, int], float]]:
    """Expectation-maximisation over counted vote patterns (kind, votes, count).

    Returns the log odds of each kind's prior and the log odds that each (kind, labeler, vote) adds. Labelers err
    independently given the truth; counts start from the majority and are smoothed, and a labeler starts better than chance.
    """
    odds = {}
    belief = [1 / (1 + exp(-1.0 * sum(v))) for _, v, _ in patterns]
    prior: dict[int, float] = {}
    for _ in range(rounds):
        yes: dict = {}
        no: dict = {}
        for (kind, votes, n), p in zip(patterns, belief, strict=True):
            for key in [(kind,), *[(kind, i, v) for i, v in enumerate(votes)]]:
                yes[key] = yes.get(key, 0.0) + n * p
                no[key] = no.get(key, 0.0) + n * (1 - p)
        prior = {k[0]: log((yes[k] + 1) / (no[k] + 1)) for k in yes if len(k) == 1}
        odds = {}
        for k in (k for k in yes if len(k) == 3):
            kind, _, v = k
            lead = max(v, 0), max(-v, 0)  # a pseudo-vote for the labeler being right
            odds[k] = log((yes[k] + 1 + lead[0]) / (yes[(kind,)] + 4)) - log((no[k] + 1 + lead[1]) / (no[(kind,)] + 4))
        belief = []
        for kind, votes, _ in patterns:
            z = prior[kind] + sum(odds[(kind, i, v)] for i, v in enumerate(votes))
            belief.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
    return prior, odds


def _log_odds(prior: dict, odds: dict) -> Column:
    out = F.lit(0.0)
    for k, z in prior.items():
        out = out + F.when(F.col("kind") == k, z).otherwise(0.0)
    for (k, i, v), z in odds.items():
        out = out + F.when((F.col("kind") == k) & (F.col(VOTES[i]) == v), z).otherwise(0.0)
    return out


def _features() -> list[tuple[str, Column]]:
    flags = [(f"f_{k}", F.col("kind") == i) for i, k in enumerate(KINDS)]
    flags += [(f"f_{n}_{'yes' if v > 0 else 'no'}", F.col(n) == v) for n in VOTES for v in (1, -1)]
    flags += [(f"f_{n}", F.col(f"is_{n}") == 1) for n in ("long", "grouped", "letters", "loose")]
    flags += [(f"f_near_{i}", F.col("near") == i) for i in range(NEAR)]
    return [(n, c.cast("double")) for n, c in flags]


def span_classifier(rows: DataFrame, prior: dict, odds: dict) -> Column | None:
    """Log odds of a span under a logistic regression on votes, shapes and the word before the span, trained on the estimated probabilities."""
    shapes = ["is_long", "is_grouped", "is_letters", "is_loose", "near"]
    counted = rows.groupBy("kind", *VOTES, *shapes).agg(F.count("*").cast("double").alias("n"))  # a bounded number of patterns
    p = 1 / (1 + F.exp(-_log_odds(prior, odds)))
    soft = counted.select("*", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * p).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - p)).alias("weight")))).alias("t"))
    names = [n for n, _ in _features()]
    train = VectorAssembler(inputCols=names, outputCol="x").transform(soft.select("t.label", "t.weight", *[c.alias(n) for n, c in _features()])).select("label", "weight", "x").where("weight > 1e-9")
    if train.select("label").distinct().count() < 2:
        return None
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-3, maxIter=50).fit(train)
    out = F.lit(float(fit.intercept))
    for w, (_, f) in zip(fit.coefficients, _features(), strict=True):
        out = out + f * F.lit(float(w))
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256 and spans: kind:start:end in code points,
    end exclusive, by start and then kind. Base matches stay; a looser candidate is added if the classifier gives it
    ``least`` probability and it overlaps no base match. Null and empty texts have none; rows that repeat each get their row;
    other columns are ignored.
    """
    found = saved(candidate_spans(docs), "spans")
    # What overlaps a base match is no candidate and no evidence: the base match stands for it.
    bases = F.size(F.filter("spans", lambda s: s["base"]))
    found = found.select("doc_id", F.when((bases == 0) | (bases == F.size("spans")), F.col("spans")).otherwise(_alone(F.col("spans"))).alias("spans"))
    rows = saved(labeled(found.select(F.explode("spans").alias("s")).select("s.*")), "span-votes")
    counted = rows.groupBy("kind", *VOTES).count().collect()  # at most 4 * 3**5 patterns
    patterns = sorted((r["kind"], tuple(r[v] for v in VOTES), r["count"]) for r in counted)
    added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    score = None
    if patterns:
        score = span_classifier(rows, *reliabilities(patterns))
    dropped(rows)
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: s["base"]), place)
    if score is None:
        more = found.select("doc_id", base.alias("base"), added.alias("added"))
    else:
        numbered = found.withColumn("uid", F.monotonically_increasing_id())
        numbered = saved(numbered.select("uid", "doc_id", base.alias("base"), F.filter("spans", lambda s: ~s["base"]).alias("loose")), "spans")
        loose = labeled(numbered.select("uid", F.explode("loose").alias("s")).select("uid", "s.*"))
        good = loose.where(score > log(least / (1 - least))).groupBy("uid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
        more = numbered.join(good, "uid", "left").select("doc_id", "base", F.coalesce("added", added).alias("added"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint) AS n_{k}") for i, k in enumerate(KINDS)]
    return more.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))
