"""Declared schemas and the special addressee names."""

from __future__ import annotations

from pyspark.sql import types as T

GROUP = "GROUP"
UNKNOWN = "UNKNOWN"
SPECIAL = (GROUP, UNKNOWN)

TURN = T.StructType(
    [
        T.StructField("turn_id", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("overlap", T.BooleanType()),
    ]
)

CONVERSATION = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("audio_path", T.StringType()),
        T.StructField("speakers", T.ArrayType(T.StringType())),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("turns", T.ArrayType(TURN)),
    ]
)

LABEL = T.StructType(
    [
        T.StructField("turn_id", T.LongType()),
        T.StructField("addressees", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("labeler", T.StringType()),
    ]
)

LABEL_SET = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("labels", T.ArrayType(LABEL)),
    ]
)

RUN_STATS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("load_seconds", T.DoubleType()),
        T.StructField("generate_seconds", T.DoubleType()),
        T.StructField("wall_seconds", T.DoubleType()),
        T.StructField("n_calls", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("audio_seconds", T.DoubleType()),
        T.StructField("failed_labels", T.LongType()),
    ]
)
