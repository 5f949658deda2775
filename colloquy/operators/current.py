"""Which rows count: the latest revision of a conversation, each turn and each copy once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import number, roster, turn_hash


def current_conversations(conversations: DataFrame, **columns: Column) -> DataFrame:
    """One row per conversation_id, of the row with the highest number in ``meta['revision']``.

    ``columns`` are computed on the scan side, before the shuffle, so that only what a caller needs is moved; without any, the
    declared columns are kept. row_number over one key is planned with a group limit on both sides of the shuffle, so a
    conversation with a great many revisions is cut down to one row in every map task.

    Nulls and ties: a missing or non-numeric revision ranks below every number; rows of the same revision are ordered by a hash
    of their content (exact copies are the same either way); rows without id share the id null. An empty table gives an empty one.
    """
    keep = columns or {c: F.col(c) for c in conversations.columns if c != "conversation_id"}
    ranked = conversations.select(
        "conversation_id",
        number(F.try_element_at("meta", F.lit("revision"))).alias("__revision"),
        F.xxhash64("speakers", "turns").alias("__content"),
        *[value.alias(name) for name, value in keep.items()],
    )
    order = Window.partitionBy("conversation_id").orderBy(F.desc_nulls_last("__revision"), F.desc("__content"))
    return (
        ranked.withColumn("__rank", F.row_number().over(order))
        .where("__rank = 1")
        .drop("__rank", "__revision", "__content")
    )


def current_turns(
    conversations: DataFrame, where: Callable[[Column], Column] | None = None, speakers: bool = False, **fields: Callable[[Column], Column]
) -> DataFrame:
    """The distinct turns of current conversations, a row each: conversation_id, with ``speakers`` n_speakers, and the fields.

    ``fields`` map an output name to a function of the turn; by default the six fields under the names turn_id, speaker, t_start,
    t_end, text, overlap. ``where`` keeps turns; it and the fields are evaluated on the scan side, before the one shuffle. The
    result stays partitioned by conversation_id: grouping by it, or by more columns, needs no further shuffle. Turns repeated
    inside a row are removed by a grouping on a hash of the whole turn (linear, and it can spill, unlike array_distinct).
    """
    fields = fields or DEFAULT_FIELDS
    turns = F.col("turns") if where is None else F.filter("turns", where)
    packed = F.transform(turns, lambda t: F.struct(turn_hash(t).alias("__hash"), *[f(t).alias(name) for name, f in fields.items()]))
    extra = {"n_speakers": speaker_count(F.col("speakers"), F.col("turns"))} if speakers else {}
    rows = current_conversations(conversations, __turns=packed, **extra).select(
        "conversation_id", *extra, F.explode("__turns").alias("__turn")
    )
    rows = rows.select("conversation_id", *extra, "__turn.*")
    return rows.distinct().drop("__hash")


def speaker_count(speakers: Column, turns: Column) -> Column:
    """Length of ``speakers``, or where that is null or empty the number of distinct speakers of the turns, as BIGINT."""
    return F.size(roster(speakers, turns)).cast("bigint")


DEFAULT_FIELDS: dict[str, Callable[[Column], Column]] = {
    "turn_id": lambda t: t["turn_id"],
    "speaker": lambda t: t["speaker"],
    "t_start": lambda t: t["start"],
    "t_end": lambda t: t["end"],
    "text": lambda t: t["text"],
    "overlap": lambda t: t["overlap"],
}
