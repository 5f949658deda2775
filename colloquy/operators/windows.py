"""Tiling a conversation into windows of target turns with leading context, and rendering them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import format_turn

LEGEND = "Lines marked [>> ] are to be labelled; lines marked [CTX] are context only."


def tiles(turns: DataFrame, step: int = 40, context: int = 10) -> DataFrame:
    """Rows (conversation_id, window_id, position, role, the turn's columns): every turn once as TARGET, and as CTX in the windows
    whose first target lies at most ``context`` turns after it.

    ``turns`` has t_start and turn_id, by which the turns of a conversation are ordered; then by a hash of the row. ``step``
    under 1 counts as 1. One shuffle by conversation; the copies are made by a generator in the same stage.
    """
    step, context = max(1, step), max(0, context)
    columns = [c for c in turns.columns]
    key = Window.partitionBy("conversation_id")
    order = key.orderBy(F.coalesce("t_start", F.lit(0.0)), "turn_id", F.xxhash64(*[c for c in columns if c != "conversation_id"]))
    numbered = turns.withColumns({"position": (F.row_number().over(order) - 1).cast("bigint"), "__n": F.count("*").over(key)})
    own = F.floor(F.col("position") / step).cast("bigint")
    last = F.least(F.floor((F.col("__n") - 1) / step), F.floor((F.col("position") + context) / step)).cast("bigint")
    placed = numbered.withColumn("window_id", F.explode(F.sequence(own, last)))
    role = F.when(F.col("window_id") == own, "TARGET").otherwise("CTX")
    return placed.withColumn("role", role).select("conversation_id", "window_id", "position", "role", *[c for c in columns if c != "conversation_id"])


def render(windows: DataFrame, rosters: DataFrame) -> DataFrame:
    """(conversation_id, window_id, text): header with the roster, legend, then a line for each turn, context first.

    ``rosters`` is (conversation_id, speakers). Times have two digits, rounded half up on the decimal form.
    """
    marker = F.when(F.col("role") == "CTX", F.lit("[CTX]")).otherwise(F.lit("[>> ]"))
    line = format_turn(marker, F.col("turn_id"), F.col("t_start"), F.col("t_end"), F.col("speaker"), F.col("text"))
    lines = windows.groupBy("conversation_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    header = F.concat(F.lit("Speakers in this conversation: "), F.array_join("speakers", ", "))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.join(rosters, "conversation_id").select(
        "conversation_id", "window_id", F.concat_ws("\n", header, F.lit(""), F.lit(LEGEND), F.lit(""), body).alias("text")
    )


def time_spans(windows: DataFrame) -> DataFrame:
    """(conversation_id, window_id, span_start, span_end): earliest start and latest end of the targets; 0 where none is known."""
    return (
        windows.where("role = 'TARGET'")
        .groupBy("conversation_id", "window_id")
        .agg(F.coalesce(F.min("t_start"), F.lit(0.0)).alias("span_start"), F.coalesce(F.max("t_end"), F.lit(0.0)).alias("span_end"))
    )


def previous_speakers(windows: DataFrame) -> DataFrame:
    """``windows`` with ``previous``: the last speaker other than the turn's own among the earlier turns of its window, or null."""
    order = Window.partitionBy("conversation_id", "window_id").orderBy("position")
    before = F.lag("speaker").over(order)
    changed = windows.withColumn("__c", F.when(before != F.col("speaker"), before))
    return changed.withColumn("previous", F.last("__c", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")
