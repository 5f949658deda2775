"""Throughput of labeler runs, audio length, and what to expect of a longer corpus."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audio_seconds(turns: DataFrame) -> DataFrame:
    """One row: the sum over conversations of latest end less earliest start; 0.0 without any."""
    each = turns.groupBy("conversation_id").agg((F.max("t_end") - F.min("t_start")).alias("s"))
    return each.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("audio_seconds"))


def speed_summary(stats: DataFrame) -> DataFrame:
    """One row per run of RUN_STATS: tokens per second, seconds per turn, times real time; denominators of 0 count as 0.01 or 1."""
    tps = F.col("output_tokens") / F.greatest("generate_seconds", F.lit(0.01))
    per_turn = F.col("wall_seconds") / F.greatest("n_turns", F.lit(1))
    real_time = F.col("wall_seconds") / F.greatest("audio_seconds", F.lit(0.01))
    return stats.select("model", "engine", "n_turns", "failed_labels", F.round(tps, 1).alias("tokens_per_second"), F.round(per_turn, 2).alias("seconds_per_turn"), F.round(real_time, 2).alias("times_real_time"))


def projected(stats: DataFrame, hours: float) -> DataFrame:
    """(model, engine, hours_needed): how long each run would take for ``hours`` of audio at its pace of generation alone."""
    return stats.select("model", "engine", F.round(F.lit(float(hours)) * F.col("generate_seconds") / F.greatest("audio_seconds", F.lit(0.01)), 2).alias("hours_needed"))


def write_speed(stats: DataFrame, config: dict, path: str | Path) -> None:
    """{config, results}: a JSON file of what was run and a row for each run, of RUN_STATS with its summary. Runs are few."""
    rows = stats.join(speed_summary(stats).select("model", "engine", "tokens_per_second", "seconds_per_turn", "times_real_time"), ["model", "engine"])
    results = [{k: round(v, 2) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in rows.orderBy("model", "engine").collect()]
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"config": config, "results": results}, ensure_ascii=False, indent=2), encoding="utf-8")
