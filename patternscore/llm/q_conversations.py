"""op13: all conversations, damaged by a fixed rule and repaired. SQL has neither crc32 nor the edits, so the tests hold it against brute force."""

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass
from .conversations import FAULTS, conv_key, repair


def damaged(conversations: DataFrame) -> DataFrame:
    """By crc32('conv_id:turn') % 20, nulls as one space: 0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(conv_key(), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    changed = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


_COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
_LEGAL = {"su", "ua", "au"}
_DIGEST = "cid string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digester():
    """Edits arrive in order; a conversation's texts go into its hash one by one, so only its letters are kept."""

    def make():
        held: dict = {}

        def row():
            h = held
            gaps = 0 if h["low"] is None else h["high"] - h["low"] + 1 - h["turns"]
            values = (h["cid"], gaps, *h["faults"][1:], h["illegal"], h["cost"], "".join(h["audit"]), h["sha"].hexdigest())
            return dict(zip([c.split()[0] for c in _DIGEST.split(", ")], ([v] for v in values), strict=True))

        def f(batch):
            for cid, edit, turn, was, fault, role, text in zip(*(batch.column(c).to_pylist() for c in ("cid", "edit", "turn", "was", "fault", "role", "text")), strict=True):
                if cid != held.get("cid"):
                    if held:
                        yield row()
                    held.update(cid=cid, low=None, high=None, turns=0, faults=[0] * len(FAULTS), illegal=0, cost=0, audit=[], sha=sha256(), before=None, any=False)
                h = held
                if edit != "I":
                    if turn is not None and turn != h["high"]:
                        h["low"], h["high"], h["turns"] = turn if h["low"] is None else h["low"], turn, h["turns"] + 1
                    h["faults"][fault] += 1
                    h["illegal"] += h["before"] is not None and h["before"] + was[:1] not in _LEGAL
                    h["before"] = was[:1]
                h["cost"] += _COSTS[edit] + 3 * (edit in "KR" and fault == 3)
                h["audit"].append(edit)
                if edit != "D":
                    h["sha"].update(f"{chr(10) * h['any']}{role}:{text}".encode())
                    h["any"] = True

        f.last = lambda: row() if held else None
        return f

    return make


def repaired_digest(conversations: DataFrame) -> DataFrame:
    """A row for every conv_id, whether or not the damage left any of its turns."""
    edits = repair(damaged(conversations))
    found = arrow_pass(edits.repartition("cid").sortWithinPartitions("cid", "piece", "seq"), _digester(), _DIGEST)
    ids = conversations.select("conv_id", conv_key().alias("cid")).distinct()
    columns = [c.split() for c in _DIGEST.split(", ")[1:]]
    empty = {"audit": "", "repaired_sha256": sha256().hexdigest()}
    return ids.join(found, "cid", "left").select("conv_id", *[F.coalesce(F.col(c), F.lit(empty.get(c, 0)).cast(kind)).alias(c) for c, kind in columns])


def op13_conversation_repair(spark, sf_dir):
    return repaired_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL: dict = {}
