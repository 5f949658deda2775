"""Labels back in the transcripts they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.current import current_conversations, current_turns


def merged_turns(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """``turns`` with addressees, addressee_confidence, addressee_rationale of ``labels`` (one per turn); null where there is none."""
    return turns.join(
        labels.select(
            "conversation_id", "turn_id", "addressees",
            F.col("confidence").alias("addressee_confidence"), F.col("rationale").alias("addressee_rationale"),
        ),
        ["conversation_id", "turn_id"], "left",
    )


def merged_conversations(conversations: DataFrame, labels: DataFrame) -> DataFrame:
    """Current conversations with all their columns, the turns with the three fields of :func:`merged_turns`, ordered by start and turn_id.

    A conversation without turns stays, with an empty list.
    """
    fields = ["turn_id", "speaker", F.col("t_start").alias("start"), F.col("t_end").alias("end"), "text", "overlap", "addressees", "addressee_confidence", "addressee_rationale"]
    rows = merged_turns(current_turns(conversations), labels)
    rows = rows.select("conversation_id", F.struct(F.coalesce("t_start", F.lit(0.0)).alias("k"), F.struct(*fields).alias("t")).alias("x"))
    nested = rows.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("turns"))
    others = [c for c in conversations.columns if c not in ("conversation_id", "turns")]
    heads = current_conversations(conversations, **{c: F.col(c) for c in others})
    turns = F.coalesce("turns", F.array().cast(nested.schema["turns"].dataType))
    return heads.join(nested, "conversation_id", "left").select("conversation_id", *others, turns.alias("turns"))


def transcript_lines(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """(conversation_id, turn_id, t_start, line): ``[start-end] speaker -> addressees: text``, padded; ``?`` where a turn has no label."""
    rows = merged_turns(turns, labels)
    to = F.coalesce(F.array_join("addressees", "+"), F.lit("?"))
    line = F.format_string(
        "[%7.2f-%7.2f] %3s -> %-10s: %s", F.coalesce("t_start", F.lit(0.0)), F.coalesce("t_end", F.lit(0.0)), F.coalesce("speaker", F.lit("")), to, F.coalesce("text", F.lit(""))
    )
    return rows.select("conversation_id", "turn_id", "t_start", line.alias("line"))


def transcripts(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """(conversation_id, text): all lines of a conversation in the order of their turns."""
    rows = transcript_lines(turns, labels).withColumn("x", F.struct(F.coalesce("t_start", F.lit(0.0)).alias("s"), "turn_id", "line"))
    return rows.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def coverage(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_turns, n_labelled)."""
    return merged_turns(turns, labels).agg(F.count("*").alias("n_turns"), F.count("addressees").alias("n_labelled"))
