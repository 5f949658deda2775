"""An offline rule-based labeler, as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.windows import previous_speakers, tiles


def vocative(text, others):
    """The first of ``others`` who is named in ``text`` as a word, letter case ignored; null if none is."""
    found = F.filter(others, lambda o: F.coalesce(F.rlike(text, F.concat(F.lit(r"(?iu)\b\Q"), o, F.lit(r"\E\b"))), F.lit(False)))
    return F.get(found, F.lit(0))


def heuristic_labels(turns: DataFrame, rosters: DataFrame, step: int = 40, context: int = 10, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """(conversation_id, turn_id, addressees, confidence, rationale, labeler) for every turn.

    A speaker alone addresses UNKNOWN; else whoever is named; else the only other speaker; else the last speaker before who is not
    the turn's own, within the window and its context; else GROUP. With ``noise`` that share of turns gets another answer, chosen
    by the MD5 of conversation, turn, seed and draw: the same in any run, order and engine.
    """
    targets = previous_speakers(tiles(turns, step, context)).where("role = 'TARGET'").join(rosters, "conversation_id", "left")
    others = F.filter(F.coalesce("speakers", F.array().cast("array<string>")), lambda s: s != F.col("speaker"))
    rows = targets.withColumn("__others", others).withColumn("__named", vocative(F.col("text"), F.col("__others")))
    guess = (
        F.when(F.size("__others") == 0, F.lit("UNKNOWN"))
        .when(F.col("__named").isNotNull(), F.col("__named"))
        .when(F.size("__others") == 1, F.get("__others", F.lit(0)))
        .when(F.col("previous").isNotNull(), F.col("previous"))
        .otherwise(F.lit("GROUP"))
    )
    rows = rows.withColumn("__guess", guess)
    if noise > 0:
        digest = lambda salt: F.md5(F.concat_ws("|", "conversation_id", "turn_id", F.lit(f"{seed}|{salt}")))
        draw = lambda salt, n: F.pmod(F.conv(F.substring(digest(salt), 1, 8), 16, 10).cast("bigint"), n)
        options = F.concat(F.filter("__others", lambda o: o != F.col("__guess")), F.array(F.lit("GROUP")))
        flip = (draw(1, F.lit(1_000_000)) < int(noise * 1_000_000)) & (F.size("__others") > 0)
        rows = rows.withColumn("__guess", F.when(flip, F.get(options, draw(2, F.size(options)).cast("int"))).otherwise(F.col("__guess")))
    return rows.select(
        "conversation_id", "turn_id", F.array("__guess").alias("addressees"), F.lit(0.5).alias("confidence"),
        F.lit("heuristic").alias("rationale"), F.lit(f"heuristic(noise={noise:g})").alias("labeler"),
    )
