"""Continuous periods and gaps of the time intervals of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import millis
from colloquy.operators.current import current_turns


#: Length of the slices of time within which the intervals of a key are merged first.
SLICE_MS = 6 * 3_600_000


def _sessions(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, start_ms, end_ms, n): sessions of rows (by, start_ms, end_ms, n), the gap of each row being its own length."""
    length = F.make_interval(secs=((F.col("end_ms") - F.col("start_ms")) / F.lit(1000)).cast("decimal(18,6)"))
    timed = rows.select(*by, F.timestamp_millis("start_ms").alias("__at"), length.alias("__length"), "n")
    merged = timed.groupBy(*by, F.session_window("__at", F.col("__length")).alias("__session")).agg(F.sum("n").alias("n"))
    return merged.select(*by, F.unix_millis("__session.start").alias("start_ms"), F.unix_millis("__session.end").alias("end_ms"), "n")


def merged_periods(intervals: DataFrame, key: str, start_ms: str = "start_ms", end_ms: str = "end_ms", slice_ms: int = SLICE_MS) -> DataFrame:
    """(key, start_ms, end_ms, n): each maximal run of intervals in which every one starts no later than what came before it ends.

    A session window whose gap is the interval's own length makes one session of intervals that overlap or nest; it streams over
    rows sorted by start and holds one session at a time. It is applied twice: to the intervals of a key that begin within one slice
    of time, so that a key with a large share of all rows is spread over its slices, and then to the few sessions that come of
    these. Sessions that merely touch are joined afterwards. If ``intervals`` is already partitioned by ``key`` there is no shuffle.

    Intervals with a null bound, or that end no later than they start, take no part. Ties and repeated intervals all count in n.
    Null keys form one entity. Other columns are ignored. An empty table gives an empty one.
    """
    rows = intervals.where(F.col(start_ms) < F.col(end_ms)).select(
        F.col(key).alias("__key"), F.col(start_ms).alias("start_ms"), F.col(end_ms).alias("end_ms"), F.lit(1).cast("bigint").alias("n")
    )
    slices = rows.withColumn("__slice", F.floor(F.col("start_ms") / F.lit(slice_ms)).cast("bigint"))
    sessions = _sessions(_sessions(slices, ["__key", "__slice"]), ["__key"])
    ordered = Window.partitionBy("__key").orderBy("start_ms", "end_ms")
    starts_anew = F.when(F.col("start_ms") <= F.lag("end_ms").over(ordered), 0).otherwise(1)
    runs = sessions.withColumn("__run", starts_anew).withColumn("__run", F.sum("__run").over(ordered))
    return (
        runs.groupBy("__key", "__run")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"))
        .select(F.col("__key").alias(key), "start_ms", "end_ms", "n")
    )


def gaps_between(periods: DataFrame, key: str, least_ms: int = 0) -> DataFrame:
    """(key, start_ms, end_ms): the silences of at least ``least_ms`` between consecutive periods of one key."""
    following = F.lead("start_ms").over(Window.partitionBy(key).orderBy("start_ms"))
    return (
        periods.select(key, F.col("end_ms").alias("__from"), following.alias("__to"))
        .where((F.col("__to") - F.col("__from") >= least_ms) & (F.col("__to") > F.col("__from")))
        .select(key, F.col("__from").alias("start_ms"), F.col("__to").alias("end_ms"))
    )


def speech_periods_and_gaps(conversations: DataFrame, least_turns: int = 2, least_gap_ms: int = 2000) -> DataFrame:
    """(conversation_id, kind, start_ms, end_ms): per current conversation its periods of ``least_turns`` turns or more, and its gaps.

    One shuffle, by conversation_id; sessions, touching periods and gaps are all found within it. Turns whose start or end is
    null, or that end no later than they start (in ms), take no part; a conversation without other turns gives no row.
    """
    turns = current_turns(
        conversations,
        where=lambda t: millis(t["start"]) < millis(t["end"]),
        start_ms=lambda t: millis(t["start"]),
        end_ms=lambda t: millis(t["end"]),
    )
    periods = merged_periods(turns, "conversation_id")
    following = F.lead("start_ms").over(Window.partitionBy("conversation_id").orderBy("start_ms"))
    both = periods.withColumn("__next", following).select(
        "conversation_id",
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), (F.col("n") >= least_turns).alias("ok")),
                    F.struct(F.lit("gap").alias("kind"), F.col("end_ms").alias("a"), F.col("__next").alias("b"), F.coalesce(F.col("__next") - F.col("end_ms") >= least_gap_ms, F.lit(False)).alias("ok")),
                ),
                lambda x: x["ok"],
            )
        ),
    )
    return both.select("conversation_id", "kind", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
