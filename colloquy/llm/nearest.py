"""Nearest record in time for the same entity, within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import clip_offset, folded, meeting_of, millis, turn_hash
from colloquy.operators.current import current_turns


#: Length of the stretches of time within which neighbours are found, in widths of the widest interval.
STRETCH = 1024


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: Sequence[str], time: str, tolerance: int, payload: str
) -> DataFrame:
    """``left`` with the ``payload`` of the nearest ``right`` row of the same entity, where one lies within ``tolerance``.

    Every distinct right time owns the interval of left times that are nearer to it than to its neighbours: from the midpoint to
    the one before up to the midpoint to the one after, cut at the tolerance. The intervals of one entity are disjoint, so a left
    time falls into one at most. For the range join each interval is entered under the time buckets that it touches (two at
    most, a bucket being as wide as the longest interval), and the join is an equi-join on entity and bucket with the bounds as
    a residual. The neighbours are found within stretches of STRETCH tolerances, so that an entity with a large share of all rows is
    spread over time in either step, and no task sees the whole of it.

    ``time`` and ``tolerance`` are whole numbers of one unit; ``entity`` columns and ``time`` bear the same names on both sides.
    Equally near: the earlier right time; equal right times: the smallest payload. Rows with a null entity or time have no
    partner and are not returned. Left rows are never merged; several may share a partner. Left columns other than the entity's,
    whatever their names, come back as they are.
    """
    entity, width = list(entity), 2 * tolerance + 1
    known = lambda d: d.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*entity, time]))
    marks = known(right).groupBy(*entity, F.col(time).alias("__at")).agg(F.min(payload).alias("__payload"))
    # a neighbour further off than both tolerances cuts nothing, so that neighbours are looked for within stretches of time, at whose
    # edges a time is entered on both sides
    stretch = lambda c: F.floor(c / F.lit(STRETCH * width)).cast("bigint")
    at = F.col("__at")
    marks = marks.withColumn("__stretch", F.explode(F.array_distinct(F.array(stretch(at - width), stretch(at), stretch(at + width)))))
    ordered = Window.partitionBy(*entity, "__stretch").orderBy("__at")
    before, after = F.lag("__at").over(ordered), F.lead("__at").over(ordered)
    halfway = lambda a, b: a + F.floor((b - a) / 2).cast("bigint")
    marks = marks.withColumns({"__before": before, "__after": after}).where(F.col("__stretch") == stretch(at))
    before, after = F.col("__before"), F.col("__after")
    intervals = marks.select(
        *[F.col(c).alias(f"__r_{c}") for c in entity],
        "__payload",
        F.greatest(F.col("__at") - tolerance, halfway(before, F.col("__at")) + 1).alias("__low"),
        F.least(F.col("__at") + tolerance, halfway(F.col("__at"), after)).alias("__high"),
    )
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    index = intervals.where("__low <= __high").withColumn(
        "__r_bucket", F.explode(F.sequence(bucket(F.col("__low")), bucket(F.col("__high"))))
    )
    probes = known(left).withColumn("__bucket", bucket(F.col(time)))
    same = [F.col(c) == F.col(f"__r_{c}") for c in entity] + [F.col("__bucket") == F.col("__r_bucket")]
    within = F.col(time).between(F.col("__low"), F.col("__high"))
    condition = within
    for term in same:
        condition = term & condition
    joined = probes.join(index, condition)
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], F.col("__payload").alias(payload))


def clip_turn_partners(
    ext_conversations: DataFrame, instances_metadata: DataFrame, conversations: DataFrame, tolerance_ms: int = 750
) -> DataFrame:
    """(ext_conversation_id, ext_turn_id, conversation_id, turn_id): each clip turn with the nearest turn of its meeting and speaker.

    Times are whole milliseconds, a clip's shifted by its offset. A clip with several metadata rows takes the greatest offset and
    the greatest non-empty meeting among them. Turns without speaker or start, clips of meetings that we do not have, and turns
    with nobody near enough give no row. Copies of a clip row, or of a turn inside one, count once.
    """
    metadata = instances_metadata.groupBy(F.col("conversation_id").alias("__clip")).agg(
        F.max("clip_t0_sec").alias("__t0"), F.max(F.nullif("ami_meeting", F.lit(""))).alias("__meeting")
    )
    clip = F.col("ext_conversation_id")
    turns = ext_conversations.select(
        F.col("conversation_id").alias("ext_conversation_id"),
        F.col("meta").alias("__meta"),
        F.explode(F.filter("turns", lambda t: t["start"].isNotNull() & t["speaker"].isNotNull())).alias("__turn"),
    )
    turns = turns.join(metadata, clip == F.col("__clip"), "left").select(
        clip,
        meeting_of(F.col("__meeting"), F.col("__meta"), clip).alias("conversation_id"),
        folded(F.col("__turn.speaker")).alias("__speaker"),
        (millis(F.col("__turn.start")) + millis(clip_offset(F.col("__t0"), F.col("__meta"), clip))).alias("__ms"),
        F.col("__turn.turn_id").alias("ext_turn_id"),
        turn_hash(F.col("__turn")).alias("__content"),
    )
    ours = current_turns(
        conversations,
        where=lambda t: t["start"].isNotNull() & t["speaker"].isNotNull(),
        __speaker=lambda t: folded(t["speaker"]),
        __ms=lambda t: millis(t["start"]),
        turn_id=lambda t: t["turn_id"],
    )
    found = nearest_in_time(turns.distinct(), ours, ["conversation_id", "__speaker"], "__ms", tolerance_ms, "turn_id")
    return found.select("ext_conversation_id", "ext_turn_id", "conversation_id", "turn_id")
