"""Running a labeler over windows: one call for each, responses kept, resuming, appending, compacting, statistics."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.columns import audio_slice
from colloquy.labelers.base import HeuristicLabeler, Labeler, ModelLabeler, Reply, Request
from colloquy.operators.heuristic import heuristic_labels
from colloquy.operators.parsing import labels_from_responses
from colloquy.operators.windows import render, tiles, time_spans
from colloquy.session import shared_folder

LABEL = "conversation_id string, turn_id bigint, addressees array<string>, confidence double, rationale string, labeler string"
RESPONSE = (
    "conversation_id string, window_id bigint, raw string, error string, load_seconds double, seconds double, input_tokens bigint, output_tokens bigint"
)


def user_prompt(window_text: Column) -> Column:
    """The prompt for a rendered window, a column."""
    return F.concat(F.lit("Conversation window:\n\n"), window_text, F.lit("\n\nLabel every line marked [>> ]."))


def remaining_windows(windows: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The windows of which a target has no label yet in ``done`` (conversation_id, turn_id, labeler): an anti-join.

    A window whose targets all have one is skipped, also where they say that it failed, unless ``retry_failed``. A window that is
    only partly labelled is done anew as a whole.
    """
    if retry_failed:
        done = done.where(~F.coalesce("labeler", F.lit("")).endswith("(failed)"))
    have = done.select("conversation_id", "turn_id").distinct().withColumn("have", F.lit(True))
    targets = windows.where("role = 'TARGET'").join(have, ["conversation_id", "turn_id"], "left")
    complete = targets.groupBy("conversation_id", "window_id").agg(F.every(F.coalesce("have", F.lit(False))).alias("complete")).where("complete")
    return windows.join(complete.select("conversation_id", "window_id"), ["conversation_id", "window_id"], "left_anti")


def prompts_of(windows: DataFrame, rosters: DataFrame, audio_pad: float = 0.5) -> DataFrame:
    """(conversation_id, window_id, prompt, audio_path, audio_start, audio_seconds): what is asked for each window.

    ``rosters`` is (conversation_id, speakers) and may have audio_path; without it, or without a known time, the audio columns are null.
    """
    rows = render(windows, rosters).select("conversation_id", "window_id", user_prompt(F.col("text")).alias("prompt"))
    if "audio_path" not in rosters.columns:
        return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("audio_path", "string"), ("audio_start", "double"), ("audio_seconds", "double"))])
    cut = audio_slice(F.col("span_start"), F.col("span_end"), audio_pad)
    spans = time_spans(windows).select("conversation_id", "window_id", cut["start"].alias("audio_start"), cut["seconds"].alias("audio_seconds"))
    return rows.join(spans, ["conversation_id", "window_id"], "left").join(rosters.select("conversation_id", "audio_path"), "conversation_id", "left").select(
        "conversation_id", "window_id", "prompt", "audio_path", "audio_start", "audio_seconds"
    )


def responses_of(prompts: DataFrame, labeler: ModelLabeler, fail_fast: bool = False) -> DataFrame:
    """RESPONSE rows, one for each prompt; the labeler is opened once per task and asked once per row.

    The frame is lazy: every action on it asks again. Write it before it is used, as :func:`run_labeler` does. An exception of the
    labeler is kept by its name in ``error``, with ``fail_fast`` it fails the job. ``load_seconds`` is on a task's first row alone.
    """
    opened, system = labeler.open, labeler.system

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer, load = None, 0.0
        for batch in batches:
            rows = []
            if answer is None and len(batch):
                began = time.monotonic()
                answer = opened()
                load = time.monotonic() - began
            for conversation, window, prompt, path, start, seconds in batch.itertuples(index=False):
                known = lambda x: None if x is None or x != x else x
                request, began, error = Request(system, prompt, known(path), known(start), known(seconds)), time.monotonic(), None
                try:
                    got = answer(request)
                    reply = got if isinstance(got, Reply) else Reply(got)
                except Exception as problem:  # the labeler's own
                    if fail_fast:
                        raise
                    reply, error = Reply(None), type(problem).__name__
                rows.append((conversation, window, reply.text, error, load, time.monotonic() - began, reply.input_tokens, reply.output_tokens))
                load = 0.0
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESPONSE.split(", ")])

    return prompts.mapInPandas(ask, RESPONSE)


def targets_of(windows: DataFrame, rosters: DataFrame) -> DataFrame:
    """(conversation_id, window_id, turn_id, speaker, speakers): the turns to be labelled."""
    rows = windows.where("role = 'TARGET'").join(rosters.select("conversation_id", "speakers"), "conversation_id", "left")
    return rows.select("conversation_id", "window_id", "turn_id", "speaker", "speakers")


class LabelStore:
    """A shared folder to which responses and labels are appended in numbered batches, complete ones only being read.

    The label of the latest batch counts for a turn. ``compact`` writes what counts as one batch and removes the older ones.
    Responses stay: they are what was paid for, and labels can be made of them again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self, kind: str) -> list[int]:
        """Numbers of the complete batches of ``labels`` or ``responses``, of labels from the last compacted one on."""
        folder = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        found = {n: int(n.rpartition("=")[2]) for n in names if n.startswith(("batch=", "full=")) and self._fs.exists(self._path(f"{self.path}/{kind}/{n}/_SUCCESS"))}
        base = max((k for n, k in found.items() if n.startswith("full=")), default=-1)
        return sorted({k for k in found.values() if k >= base})

    def _folder(self, kind: str, number: int) -> str:
        full = f"{self.path}/{kind}/full={number:08d}"
        return full if self._fs.exists(self._path(f"{full}/_SUCCESS")) else f"{self.path}/{kind}/batch={number:08d}"

    def _read(self, kind: str, numbers: list[int], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, batch bigint")
        for k in numbers:
            out = out.unionByName(self.spark.read.schema(schema).parquet(self._folder(kind, k)).withColumn("batch", F.lit(k).cast("bigint")))
        return out

    def append(self, kind: str, number: int, rows: DataFrame, compacted: bool = False) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/{'full' if compacted else 'batch'}={number:08d}")

    def next_number(self) -> int:
        return max([*self.batches("labels"), *self.batches("responses")], default=0) + 1

    def labels(self) -> DataFrame:
        """LABEL rows: the label that counts for each turn."""
        rows, names = self._read("labels", self.batches("labels"), LABEL), ["addressees", "confidence", "rationale", "labeler"]
        latest = rows.groupBy("conversation_id", "turn_id").agg(F.max_by(F.struct(*names), "batch").alias("l"))
        return latest.select("conversation_id", "turn_id", "l.*")

    def responses(self, numbers: list[int] | None = None) -> DataFrame:
        """RESPONSE rows with the number of their batch."""
        return self._read("responses", self.batches("responses") if numbers is None else numbers, RESPONSE)

    def unparsed(self) -> list[int]:
        """Batches of responses of which no labels were made, as a run was ended between the two."""
        have, base = set(self.batches("labels")), min(self.batches("labels"), default=0)
        return [k for k in self.batches("responses") if k not in have and k >= base]

    def compact(self) -> None:
        numbers = self.batches("labels")
        if len(numbers) < 2:
            return
        old = [self._folder("labels", k) for k in numbers]
        self.append("labels", numbers[-1] + 1, self.labels(), compacted=True)
        for folder in old:
            self._fs.delete(self._path(folder), True)


Progress = Callable[[dict], None]


def run_labeler(
    turns: DataFrame, rosters: DataFrame, labeler: Labeler, store: LabelStore | str | None = None, step: int = 40, context: int = 10, waves: int = 1,
    retry_failed: bool = False, fail_fast: bool = False, on_progress: Progress | None = None,
) -> DataFrame:
    """Label all windows that ``store`` has no labels for, append them to it, and return all its labels (LABEL rows).

    A window is asked once: its response is written before anything reads it, and labels are made from what was written. A run
    that was ended loses at most one of ``waves`` (windows are dealt to them by hash); responses that were written without labels
    are parsed first. ``on_progress`` gets a dict after every wave: wave, waves, windows, labels, failed. Without ``store`` a
    folder of its own in the shared checkpoint folder is used. Labels of conversations that are not among ``turns`` stay.
    """
    spark = turns.sparkSession
    if not isinstance(store, LabelStore):
        store = LabelStore(spark, store or f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}")
    windows = tiles(turns, step, context)

    def keep(number: int, responses: DataFrame, part: DataFrame) -> None:
        answered = targets_of(part, rosters).join(responses.select("conversation_id", "window_id").distinct(), ["conversation_id", "window_id"], "left_semi")
        store.append("labels", number, labels_from_responses(responses, answered, labeler.name))

    for number in store.unparsed():
        keep(number, store.responses([number]), windows)
    for wave in range(max(1, waves)):
        part = remaining_windows(windows, store.labels(), retry_failed)
        if waves > 1:
            part = part.where(F.pmod(F.xxhash64("conversation_id", "window_id"), F.lit(waves)) == wave)
        number = store.next_number()
        if isinstance(labeler, HeuristicLabeler):
            asked = part.where("role = 'TARGET'").select("conversation_id", "turn_id").distinct()
            made = heuristic_labels(turns, rosters, step, context, labeler.noise, labeler.seed)
            store.append("labels", number, made.join(asked, ["conversation_id", "turn_id"], "left_semi"))
        else:
            store.append("responses", number, responses_of(prompts_of(part, rosters, labeler.audio_pad), labeler, fail_fast))
            keep(number, store.responses([number]), windows)
        if on_progress:
            new = store._read("labels", [number], LABEL).agg(F.count("*").alias("n"), F.count_if(F.col("labeler").endswith("(failed)")).alias("failed")).first()
            asked_n = 0 if isinstance(labeler, HeuristicLabeler) else store.responses([number]).count()
            on_progress(dict(wave=wave, waves=waves, windows=asked_n, labels=new.n, failed=new.failed))
    return store.labels()


def run_stats(store: LabelStore, labeler: ModelLabeler, wall_seconds: float, turns: DataFrame) -> DataFrame:
    """One RUN_STATS row of all responses and labels of a store: sums over rows, so that a repeated task counts once."""
    from colloquy.operators.speed import audio_seconds

    used = store.responses().agg(
        F.coalesce(F.sum("load_seconds"), F.lit(0.0)).alias("load_seconds"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("generate_seconds"), F.count("*").alias("n_calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    made = store.labels().agg(F.count("*").alias("n_turns"), F.count_if(F.coalesce("labeler", F.lit("")).endswith("(failed)")).alias("failed_labels"))
    one = used.crossJoin(made).crossJoin(audio_seconds(turns))  # one row each
    return one.select(
        F.lit(labeler.model).alias("model"), F.lit(labeler.engine).alias("engine"), "load_seconds", "generate_seconds", F.lit(float(wall_seconds)).alias("wall_seconds"),
        "n_calls", "input_tokens", "output_tokens", "n_turns", "audio_seconds", "failed_labels",
    )


def with_updates(done: DataFrame, new: DataFrame) -> DataFrame:
    """``done`` with the labels of ``new`` in place of its own where both have a turn; what only one has stays."""
    old = done.join(new.select("conversation_id", "turn_id"), ["conversation_id", "turn_id"], "left_anti")
    return old.unionByName(new.select(*done.columns))
