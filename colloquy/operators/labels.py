"""Label sets as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import folded, normalized_labels, strip


def label_rows(label_sets: DataFrame) -> DataFrame:
    """One row per distinct label: conversation_id, turn_id, addressees (trimmed, normalised), confidence, rationale, labeler."""
    label = F.col("l")
    return (
        label_sets.select("conversation_id", F.explode("labels").alias("l"))
        .select(
            "conversation_id",
            label["turn_id"].alias("turn_id"),
            normalized_labels(F.transform(label["addressees"], strip)).alias("addressees"),
            label["confidence"].alias("confidence"),
            label["rationale"].alias("rationale"),
            label["labeler"].alias("labeler"),
        )
        .distinct()
    )


def unit_confidence(confidence):
    """Confidence on the scale from 0 to 1: values over 1 are per cent."""
    return F.when(confidence > 1, confidence / 100).otherwise(confidence)


def one_label_per_turn(label_sets: DataFrame) -> DataFrame:
    """The label of each (conversation_id, turn_id) that counts in an evaluation.

    Tables have no row order in which a last one could win, so the most confident label does (per cent brought to unit scale, null
    last); ties go to the first addressees, joined by ``+``, then the first labeler, then the first rationale.
    """
    order = Window.partitionBy("conversation_id", "turn_id").orderBy(
        F.desc_nulls_last(unit_confidence(F.col("confidence"))),
        F.array_join("addressees", "+"),
        F.asc_nulls_last(folded(F.col("labeler"))),
        F.asc_nulls_last("rationale"),
        F.asc_nulls_last("labeler"),
    )
    ranked = label_rows(label_sets).withColumn("__rank", F.row_number().over(order))
    return ranked.where("__rank = 1").drop("__rank")


def failed_labels(label_sets: DataFrame) -> DataFrame:
    """(n_failed, n_labels): how many labels come from a window that failed, by the mark at the end of their labeler."""
    return label_rows(label_sets).agg(
        F.count_if(F.coalesce("labeler", F.lit("")).endswith("(failed)")).alias("n_failed"), F.count("*").alias("n_labels")
    )
