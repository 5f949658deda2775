import json
import os

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from colloquy.__main__ import main
from colloquy.operators import align, ingest, metrics, report, speed
from colloquy.schema import LABEL_SET, RUN_STATS
from colloquy.session import shared_folder
from colloquy.sources import jsonl
from colloquy.streaming.incremental import event_windows, label_stream, streamed_labels
from helpers import conversation, conversations, turn


def test_json_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps({"conversation_id": "ä", "turns": [{"turn_id": 0, "speaker": "A", "start": 0, "end": 1, "text": "é"}], "meta": {"t0": 3}}) + "\n\n")
    rows = jsonl.read_conversations(spark, str(p))
    assert rows.first().meta == {"t0": "3"} and rows.first().speakers is None
    jsonl.write_conversations(rows, str(tmp_path / "out"))
    assert jsonl.read_conversations(spark, str(tmp_path / "out")).first().turns[0].text == "é"
    p.write_text('{"conversation_id": "x"}\n')
    with pytest.raises(Exception):
        jsonl.read_conversations(spark, str(p)).collect()


def test_label_variants(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    lines = [
        {"conversation_id": "a", "labels": [{"turn_id": 0, "addressees": ["old"]}]},
        {"conversation_id": "b", "labels": [{"turn_id": 0, "addressee": "Bob"}, {"turn_id": 1, "addressees": "Bob"}]},
        {"conversation_id": "a", "labels": [{"turn_id": 1, "addressees": ["x"]}, {"turn_id": 1, "addressees": ["z", "y", "z", ""], "confidence": 1}]},
    ]
    p.write_text("\n".join(map(json.dumps, lines)) + "\n")
    rows = jsonl.read_labels(spark, str(p))
    got = tuples(rows.select("conversation_id", "turn_id", F.array_join("addressees", "+"), "confidence"))
    assert got == [("a", 1, "y+z", 1.0), ("b", 0, "Bob", None), ("b", 1, "Bob", None)]
    jsonl.write_labels(rows, str(tmp_path / "out"))
    assert jsonl.read_labels(spark, str(tmp_path / "out")).count() == 3


def test_transcript_files_and_config(spark, tmp_path, monkeypatch):
    jsonl.write_transcripts(spark.createDataFrame([("a/b", "x\ny")], "conversation_id string, text string"), str(tmp_path / "t"))
    assert os.path.isdir(tmp_path / "t" / "conversation_id=a_b")
    monkeypatch.setenv("SOME_NAME", "v")
    assert jsonl.resolve_env({"a": ["${SOME_NAME}", "x${SOME_NAME}", "${NOT_THERE}"]}) == {"a": ["v", "x${SOME_NAME}", ""]}


WORDS = """<root xmlns:nite="http://nite.sourceforge.net/">
<w nite:id="w0" starttime="1.0" endtime="1.2">Hello</w><w nite:id="w1" punc="true" starttime="1.2" endtime="1.2">,</w>
<vocalsound nite:id="v2" starttime="1.3" endtime="1.4" type="laugh"/><w nite:id="w3" starttime="1.5" endtime="2.125">there</w><w>lost</w>
<vocalsound nite:id="v4"/><w nite:id="w5">late</w></root>"""
SEGMENTS = """<root xmlns:nite="http://nite.sourceforge.net/">
<segment transcriber_start="0.9" transcriber_end="2.2"><nite:child href="m.A.words.xml#id(w3)..id(w0)"/></segment>
<segment><nite:child href="m.A.words.xml#id(v4)"/></segment><segment><nite:child href="m.A.words.xml#id(w0)..id(zz)"/></segment>
<segment transcriber_start="5.0" transcriber_end="6.0"><nite:child href="m.A.words.xml#id(w5)"/></segment></root>"""


def test_xml(spark):
    files = lambda x, kind: spark.createDataFrame([(f"/d/m.{s}.{kind}.xml", x.replace("m.A", f"m.{s}")) for s in "AB"], "path string, content string")
    words = ingest.read_words(files(WORDS, "words"))
    assert words.where("speaker = 'A'").count() == 6
    rows = ingest.turns_from_spans(words, ingest.read_segments(files(SEGMENTS, "segments"))).orderBy("turn_id").collect()
    assert [(r.turn_id, r.speaker, r.t_start, r.text, r.overlap) for r in rows] == [(0, "A", 1.0, "Hello, there", True), (1, "B", 1.0, "Hello, there", True), (2, "A", 5.0, "late", True), (3, "B", 5.0, "late", True)]


def test_alignment(spark):
    ours = conversations(spark, [conversation("M1", [turn(0, "A", 10.0, 11.0, "x"), turn(1, "A", 11.5, 12.0, "x"), turn(2, "A", 10.0, 11.0, "y")])])
    clips = conversations(spark, [
        conversation("M1_t0010-0020", [turn(0, "A", 0.75, 1.0, "x"), turn(1, "A", 0.7, 1.0, "z"), turn(2, "B", 0.0, 1.0, "x"), turn(3, "A", None, 1.0, "x")]),
        conversation("M9_t0000-0020", [turn(0, "A", 0.75, 1.0, "x")]),
        conversation("clip", [turn(0, "A", 1.0, 2.0, "x")], revision=None),
    ])
    meta = spark.createDataFrame([("clip", 8.249, "M1"), ("clip", None, "")], "conversation_id string, clip_t0_sec double, ami_meeting string")
    a = align.align_clips(clips, meta, ours)
    assert tuples(a.aligned.select("clip_id", "clip_turn_id", "conversation_id", "turn_id")) == [("M1_t0010-0020", 0, "M1", 0)]  # equal distance: the earlier; the last clip is 0.751 s off
    assert tuples(align.align_stats(a)) == [(2, 1, 1, 5, 1)]
    assert tuples(a.clips.select("clip_id", "meeting", "offset_s"))[0] == ("M1_t0010-0020", "M1", 10.0)


def test_external_bundle(spark, tmp_path):
    lines = lambda name, rows: ((tmp_path / name).write_text("\n".join(map(json.dumps, rows))), str(tmp_path / name))[1]
    turns = [turn(i, "AB"[i % 2], 10.0 * i, 10.0 * i + 5, "x") for i in range(4)]
    clips = lines("c", [{"conversation_id": "M_t0010-0050", "turns": [t | {"start": t["start"] - 9.5} for t in turns[1:]]}])
    gold = lines("l", [{"conversation_id": "M_t0010-0050", "labels": [{"turn_id": i, "addressees": "A", "model_id": "big"} for i in (1, 2)]}])
    bundle = jsonl.read_bundle(spark, clips, gold)
    ours = conversations(spark, [conversation("M", turns, ["A", "B"])])
    assert [r.model_id for r in bundle.models.collect()] == ["big"] and bundle.metadata.count() == 0
    a = align.align_clips(bundle.conversations, bundle.metadata, ours)
    mine = spark.createDataFrame([("M", [dict(turn_id=i, addressees=["A"], confidence=1.0, rationale=None, labeler="m") for i in (1, 3)])], LABEL_SET)
    records, counts = align.external_records(a.aligned, bundle.labels, mine)
    assert [(r.turn_id, r.exact, r.n_speakers) for r in records.collect()] == [(1, True, 1)] and tuples(counts) == [(1, 2)]
    out = tmp_path / "report.json"
    lines("ours", [dict(conversation_id="M", turns=turns, speakers=["A", "B"], meta={}, audio_path=None)]), lines("mine", [{"conversation_id": "M", "labels": [{"turn_id": 1, "addressees": ["A"]}]}])
    main(["compare-external", "--external-conversations", clips, "--external-labels", gold, "--conversations", str(tmp_path / "ours"), "--labels", str(tmp_path / "mine"), "--report", str(out)], spark)
    report = json.loads(out.read_text())
    assert report["external_models"] == ["big"] and report["alignment"]["turns_aligned"] == 1 and report["result"]["strata"]["overall"]["exact_match"] == 1.0


def test_commands(spark, tmp_path):
    rows = [conversation("c", [turn(i, "AB"[i % 2], float(i), i + 0.5, "B, go" if i == 0 else "yes") for i in range(5)], ["A", "B", "C"]), conversation("d", [turn(0)], ["A"])]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    at = lambda name: str(tmp_path / name)
    base = ["--conversations", at("c.jsonl"), "--window", "2", "--context", "1"]
    main(["label", *base, "--labeler", "mock", "--store", at("gold"), "--out", at("gold.json")], spark)
    main(["label", *base, "--labeler", "mock", "--noise", "0.35", "--seed", "7", "--store", at("pred"), "--out", at("pred.json")], spark)
    assert main(["evaluate", "--conversations", at("c.jsonl"), "--gold", at("gold.json"), "--pred", at("pred.json"), "--report", at("r.json")], spark) in (0, 1)
    assert json.loads((tmp_path / "r.json").read_text())["result"]["n_scored_turns"] == 6
    main(["merge", "--conversations", at("c.jsonl"), "--labels", at("gold.json"), "--out", at("merged"), "--text", at("text")], spark)
    assert spark.read.json(at("merged")).count() == 2 and os.path.isdir(tmp_path / "text" / "conversation_id=c")
    main(["demo", "--conversations", at("c.jsonl")], spark)
    (tmp_path / "xml").mkdir()
    for who in "AB":
        (tmp_path / "xml" / f"m.{who}.words.xml").write_text(WORDS.replace("m.A", f"m.{who}"))
        (tmp_path / "xml" / f"m.{who}.segments.xml").write_text(SEGMENTS.replace("m.A", f"m.{who}"))
    main(["prepare-ami", "--words", at("xml/*.words.xml"), "--segments", at("xml/*.segments.xml"), "--audio-folder", "/a", "--meetings", "m", "--out", at("ami")], spark)
    made = jsonl.read_conversations(spark, at("ami")).collect()
    assert [(r.conversation_id, r.speakers, len(r.turns), r.audio_path) for r in made] == [("m", ["A", "B"], 4, "/a/m.Mix-Headset.wav")]
    speed.write_speed(spark.createDataFrame([("m", "e", 1.0, 1.0, 2.0, 1, 1, 5, 1, 7200.0, 2)], RUN_STATS), {"window": 2}, tmp_path / "s.json")
    assert json.loads((tmp_path / "s.json").read_text())["results"][0]["tokens_per_second"] == 5.0
    assert speed.projected(spark.createDataFrame([("m", "e", 1.0, 1.0, 2.0, 1, 1, 5, 1, 3600.0, 2)], RUN_STATS), 7200.0).first().hours_needed == 2.0


def test_hundredths_of_times_are_exact():
    assert ingest._times("2.675", "0.125") == (2.675, 0.125, 2.67, 0.12) and ingest._times("x", None) == (None, None, None, None)


def test_a_report_is_not_cut(spark, tmp_path, monkeypatch):
    gold = spark.createDataFrame([("c", [dict(turn_id=i, addressees=["AB"[i]], confidence=1.0, rationale=None, labeler="m") for i in range(2)])], LABEL_SET)
    with metrics.evaluate(gold, gold, conversations(spark, [])) as e:
        assert report.as_dict(e)["result"]["confusion"]["labels"] == ["A", "B"]
        monkeypatch.setattr(report, "MOST_LABELS", 1)
        with pytest.raises(report.TooLarge):
            report.as_dict(e)
        report.write_tables(e, str(tmp_path))
        assert spark.read.parquet(str(tmp_path / "confusion")).count() == 2


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_speed(spark):
    stats = spark.createDataFrame([("m", "e", 1.0, 0.0, 2.0, 1, 1, 5, 0, 0.0, 2)], RUN_STATS)
    assert tuples(speed.speed_summary(stats)) == [("m", "e", 0, 2, 500.0, 2.0, 200.0)]
    assert speed.audio_seconds(spark.createDataFrame([], "conversation_id string, t_start double, t_end double")).first()[0] == 0.0


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = conversations(spark, [conversation("c", [turn(0, "A", 0.0, 1.0), turn(1, "B", 1.0, 2.0)], ["A", "B"])])
    rows.coalesce(1).write.mode("append").json(str(source))
    for _ in range(2):  # the second run finds nothing new
        label_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    for revision, n in (("3", 3), ("2", 4)):  # a later revision comes, then an older one late
        more = conversations(spark, [conversation("c", [turn(i, "AB"[i % 2], float(i), i + 1.0) for i in range(n)], ["A", "B"], revision=revision)])
        more.coalesce(1).write.mode("append").json(str(source))
        label_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.turn_id for r in streamed_labels(spark, str(tmp_path / "out")).collect()) == [0, 1, 2]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double")
    assert event_windows(events.withColumn("ts", F.col("ts").cast("timestamp"))).first().total == 3.0
