"""Commands: ``python -m colloquy COMMAND``. Each one reads JSON lines or XML, runs one pipeline, and writes what it is asked for."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.columns import roster
from colloquy.labelers import HeuristicLabeler, get_labeler
from colloquy.labelers.base import ffmpeg_cut
from colloquy.operators import align, ingest, labeling, merge, metrics, report, speed
from colloquy.operators.current import current_conversations, current_turns
from colloquy.operators.labels import failed_labels, one_label_per_turn
from colloquy.sources import jsonl


def rosters_of(conversations: DataFrame) -> DataFrame:
    """(conversation_id, speakers, audio_path) of current conversations."""
    return current_conversations(conversations, speakers=roster(F.col("speakers"), F.col("turns")), audio_path=F.col("audio_path"))


def label(a: argparse.Namespace, spark: SparkSession) -> int:
    """Label conversations with any labeler, resume, write labels and statistics."""
    options = {k: v for k, v in (("model", a.model), ("base_url", a.base_url), ("api_key", a.api_key), ("engine", a.engine)) if v}
    options |= json.loads(a.options)
    if a.labeler.lower() in ("mock", "heuristic"):
        options = dict(noise=a.noise, seed=a.seed)
    elif a.audio:
        options["cut"] = ffmpeg_cut
    labeler = get_labeler(a.labeler, **options)
    conversations = jsonl.read_conversations(spark, a.conversations)
    turns, store, began = current_turns(conversations), labeling.LabelStore(spark, a.store), time.monotonic()
    done = labeling.run_labeler(
        turns, rosters_of(conversations), labeler, store, a.window, a.context, a.waves, a.retry_failed, a.fail_fast,
        lambda p: print(json.dumps(p), file=sys.stderr, flush=True),
    )
    store.compact()
    if a.out:
        jsonl.write_labels(store.labels(), a.out)
    if a.stats and not isinstance(labeler, HeuristicLabeler):
        stats = labeling.run_stats(store, labeler, time.monotonic() - began, turns)
        speed.write_speed(stats, dict(conversations=a.conversations, window=a.window, context=a.context), a.stats)
    del done
    return 0


def evaluate(a: argparse.Namespace, spark: SparkSession) -> int:
    """Compare two label files; the exit code is 0 where the candidate is accepted, else 1."""
    gold, pred = (jsonl.label_sets(jsonl.read_labels(spark, p)) for p in (a.gold, a.pred))
    with metrics.evaluate(gold, pred, jsonl.read_conversations(spark, a.conversations), a.accept_kappa, a.accept_exact) as e:
        for name, side in (("gold", gold), ("pred", pred)):
            n = failed_labels(side).first()
            if n.n_failed:
                print(f"{name}: {n.n_failed} of {n.n_labels} labels come from windows that failed", file=sys.stderr)
        made = report.as_dict(e)
    return _tell(made, a.report)


def _tell(made: dict, path: str | None) -> int:
    print(report.as_text(made))
    if path:
        report.write_report(made, path)
    return 0 if made["acceptance"]["accepted"] else 1


def merged(a: argparse.Namespace, spark: SparkSession) -> int:
    """Put labels into their transcripts, as JSON lines and as text."""
    conversations = jsonl.read_conversations(spark, a.conversations)
    labels, turns = jsonl.read_labels(spark, a.labels), current_turns(conversations)
    jsonl.write_merged(merge.merged_conversations(conversations, labels), a.out)
    if a.text:
        jsonl.write_transcripts(merge.transcripts(turns, labels), a.text)
    n = merge.coverage(turns, labels).first()
    print(f"{n.n_labelled} of {n.n_turns} turns have a label", file=sys.stderr)
    return 0


def compare_external(a: argparse.Namespace, spark: SparkSession) -> int:
    """Lay an external bundle against our own conversations and compare its labels with ours."""
    bundle = jsonl.read_bundle(spark, a.external_conversations, a.external_labels, a.external_metadata)
    conversations, ours = jsonl.read_conversations(spark, a.conversations), jsonl.label_sets(jsonl.read_labels(spark, a.labels))
    found = align.align_clips(bundle.conversations, bundle.metadata, conversations, round(1000 * a.tolerance), not a.any_text)
    records, counts = align.external_records(found.aligned, bundle.labels, ours)
    stats = align.align_stats(found).drop("turns_aligned").first().asDict() | counts.first().asDict()
    print(json.dumps(stats), file=sys.stderr)
    if not stats["turns_aligned"]:
        print("no turn has a label on both sides", file=sys.stderr)
        return 1
    with metrics.evaluate_records(records, bundle.labels) as e:
        made = {"alignment": stats, "external_models": sorted(r.model_id for r in bundle.models.collect())} | report.as_dict(e)
    return _tell(made, a.report)


def prepare_ami(a: argparse.Namespace, spark: SparkSession) -> int:
    """Conversations from word and segment files, with a line of statistics for each meeting."""
    words, segments = (ingest.read_files(spark, p) for p in (a.words, a.segments))
    if a.meetings:
        of = F.get(F.split(F.substring_index("path", "/", -1), r"\."), F.lit(0)).isin(a.meetings)
        words, segments = words.where(of), segments.where(of)
    made = ingest.prepared(words, segments, a.audio_folder)
    jsonl.write_conversations(made, a.out)
    for r in ingest.prepare_stats(jsonl.read_conversations(spark, a.out)).orderBy("conversation_id").toLocalIterator():
        print(f"{r.conversation_id}: {r.n_speakers} speakers, {r.n_turns} turns, {r.n_overlap} overlap ({r.overlap_percent}%), {r.minutes:.1f} min", file=sys.stderr)
    return 0


def demo(a: argparse.Namespace, spark: SparkSession) -> int:
    """The rule-based labeler against itself with a third of the answers changed."""
    conversations = jsonl.read_conversations(spark, a.conversations)
    turns, rosters = current_turns(conversations), rosters_of(conversations)
    made = [jsonl.label_sets(labeling.run_labeler(turns, rosters, HeuristicLabeler(noise, 7))) for noise in (0.0, 0.35)]
    with metrics.evaluate(*made, conversations) as e:
        return _tell(report.as_dict(e), None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="colloquy")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, **needed: str):
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for option, text in needed.items():
            p.add_argument(f"--{option.replace('_', '-')}", required=True, help=text)
        return p

    p = command("label", label, conversations="JSON lines", labeler="gemini, openai, endpoint, local, mock, or another of their names", store="folder of labels and responses")
    for option in ("out", "stats", "model", "base-url", "api-key", "engine"):
        p.add_argument(f"--{option}")
    p.add_argument("--options", default="{}", help="further options of the labeler as JSON")
    for option, default in (("window", 40), ("context", 10), ("waves", 1), ("seed", 0)):
        p.add_argument(f"--{option}", type=int, default=default)
    p.add_argument("--noise", type=float, default=0.0)
    for option in ("audio", "retry-failed", "fail-fast"):
        p.add_argument(f"--{option}", action="store_true")
    p = command("evaluate", evaluate, conversations="JSON lines", gold="labels", pred="labels")
    p.add_argument("--accept-kappa", type=float, default=0.75)
    p.add_argument("--accept-exact", type=float, default=0.80)
    p.add_argument("--report")
    command("merge", merged, conversations="JSON lines", labels="labels", out="folder of JSON lines").add_argument("--text")
    p = command("compare-external", compare_external, external_conversations="clips", external_labels="labels of clips", conversations="JSON lines", labels="labels")
    p.add_argument("--external-metadata")
    p.add_argument("--tolerance", type=float, default=0.75)
    p.add_argument("--any-text", action="store_true", help="texts need not be equal")
    p.add_argument("--report")
    p = command("prepare-ami", prepare_ami, words="pattern of words files", segments="pattern of segments files", out="folder of JSON lines")
    p.add_argument("--audio-folder")
    p.add_argument("--meetings", nargs="*")
    command("demo", demo, conversations="JSON lines")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    return a.run(a, spark or SparkSession.builder.appName("colloquy").getOrCreate())


if __name__ == "__main__":
    raise SystemExit(main())
