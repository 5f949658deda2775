"""An independent segmentation of clips laid against our own turns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.columns import clip_offset, is_backchannel, meeting_of, millis, turn_hash
from colloquy.operators.current import current_turns
from colloquy.operators.labels import one_label_per_turn
from colloquy.operators.metrics import record_columns
from colloquy.session import cut_lineage


def clip_facts(ext_conversations: DataFrame, instances_metadata: DataFrame) -> DataFrame:
    """(clip_id, meeting, offset_s): where each clip comes from. Several metadata rows of a clip: the greatest values count."""
    metadata = instances_metadata.groupBy(F.col("conversation_id").alias("__clip")).agg(
        F.max("clip_t0_sec").alias("__t0"), F.max(F.nullif("ami_meeting", F.lit(""))).alias("__meeting")
    )
    clips = ext_conversations.select(F.col("conversation_id").alias("clip_id"), F.col("meta").alias("__meta"))
    joined = clips.join(metadata, F.col("clip_id") == F.col("__clip"), "left")
    return joined.select(
        "clip_id",
        meeting_of(F.col("__meeting"), F.col("__meta"), F.col("clip_id")).alias("meeting"),
        clip_offset(F.col("__t0"), F.col("__meta"), F.col("clip_id")).alias("offset_s"),
    ).distinct()


@dataclass
class Alignment:
    """aligned: (clip_id, clip_turn_id, conversation_id, turn_id, speaker, overlap, backchannel), the last three of our turn;
    clip_turns: every turn of the clips whose meeting we have; clips: (clip_id, meeting, offset_s, known)."""

    aligned: DataFrame
    clip_turns: DataFrame
    clips: DataFrame


def align_clips(ext_conversations: DataFrame, instances_metadata: DataFrame, conversations: DataFrame, tolerance_ms: int = 750, same_text: bool = True) -> Alignment:
    """Each clip turn with the nearest turn of the same meeting and speaker, with ``same_text`` also of the same text, whose start
    is at most ``tolerance_ms`` off. Ties: the earlier start, then the smaller turn_id. One of ours may serve several.

    The join is on meeting, speaker, (text) and a time bucket as wide as the tolerance, of which a turn of ours is entered under
    three: no pair further apart than two buckets is made, however many turns share a meeting and speaker.
    """
    facts = clip_facts(ext_conversations, instances_metadata)
    own = conversations.select("conversation_id").distinct()
    clips = facts.join(own.withColumnRenamed("conversation_id", "meeting"), "meeting", "left_semi")
    turn = F.col("turn")
    theirs = ext_conversations.select(F.col("conversation_id").alias("clip_id"), F.explode("turns").alias("turn")).select(
        "clip_id", turn["turn_id"].alias("clip_turn_id"), turn["speaker"].alias("speaker"), turn["text"].alias("text"), millis(turn["start"]).alias("ms"), turn_hash(turn).alias("content")
    )
    theirs = theirs.distinct().join(clips, "clip_id").withColumn("at", F.col("ms") + millis(F.col("offset_s")))
    ours = current_turns(
        conversations, o_turn=lambda t: t["turn_id"], o_speaker=lambda t: t["speaker"], o_text=lambda t: t["text"], o_at=lambda t: millis(t["start"]),
        o_overlap=lambda t: F.coalesce(t["overlap"], F.lit(False)), o_backchannel=lambda t: is_backchannel(t["text"]),
    ).where("o_at IS NOT NULL")
    width = tolerance_ms + 1
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    ours = ours.withColumn("o_bucket", F.explode(F.sequence(bucket(F.col("o_at")) - 1, bucket(F.col("o_at")) + 1)))
    probe = theirs.withColumn("bucket", bucket(F.col("at")))
    near = (F.col("meeting") == F.col("conversation_id")) & (F.col("speaker") == F.col("o_speaker")) & (F.col("bucket") == F.col("o_bucket"))
    if same_text:
        near &= F.col("text") == F.col("o_text")
    near &= F.abs(F.col("at") - F.col("o_at")) <= tolerance_ms
    best = F.min(F.struct(F.abs(F.col("at") - F.col("o_at")), "o_at", "o_turn", "o_speaker", "o_overlap", "o_backchannel"))
    keys = ["clip_id", "clip_turn_id", "meeting", "content"]
    aligned = probe.join(ours, near).groupBy(*keys).agg(best.alias("b"))
    aligned = aligned.select("clip_id", "clip_turn_id", F.col("meeting").alias("conversation_id"), F.col("b.o_turn").alias("turn_id"), F.col("b.o_speaker").alias("speaker"), F.col("b.o_overlap").alias("overlap"), F.col("b.o_backchannel").alias("backchannel"))
    return Alignment(aligned, theirs, facts.join(own.withColumnRenamed("conversation_id", "meeting").withColumn("known", F.lit(True)), "meeting", "left"))


def align_stats(a: Alignment) -> DataFrame:
    """(clips_matched, clips_skipped, meetings_skipped, turns_total, turns_aligned)."""
    clips = a.clips.agg(
        F.count_if("known").alias("clips_matched"), F.count_if(F.col("known").isNull()).alias("clips_skipped"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col("meeting"))).alias("meetings_skipped"),
    )
    total, aligned = a.clip_turns.agg(F.count("*").alias("turns_total")), a.aligned.agg(F.count("*").alias("turns_aligned"))
    return clips.crossJoin(total).crossJoin(aligned)  # one row each


def external_records(aligned: DataFrame, ext_labels: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, counts): the clips' labels as gold against ours on aligned turns, as records for an evaluation.

    All aligned turns are taken for one conversation, whose speakers are those of the turns labelled on both sides. counts is one
    row: turns_aligned (with both labels), turns_unlabelled. The labelled turns are written once, as both are derived from them.
    """
    theirs = one_label_per_turn(ext_labels).select(F.col("conversation_id").alias("clip_id"), F.col("turn_id").alias("clip_turn_id"), F.col("addressees").alias("gold"))
    ours = one_label_per_turn(labels).select("conversation_id", "turn_id", F.col("addressees").alias("pred"))
    rows = cut_lineage(aligned.join(theirs, ["clip_id", "clip_turn_id"], "left").join(ours, ["conversation_id", "turn_id"], "left"))
    both = F.col("gold").isNotNull() & F.col("pred").isNotNull()
    counts = rows.agg(F.count_if(both).alias("turns_aligned"), F.count_if(~both).alias("turns_unlabelled"))
    known = rows.where(both)
    speakers = known.agg(F.count_distinct("speaker").alias("n_speakers"))  # one row
    return known.crossJoin(speakers).select("clip_id", "clip_turn_id", "conversation_id", "turn_id", "gold", "pred", *record_columns()), counts
