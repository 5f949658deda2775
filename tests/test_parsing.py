import json
import math
import uuid

import pytest
from helpers import conversation, conversations, tuples, turn
from pyspark.sql import functions as F

from colloquy.labelers import HeuristicLabeler, ModelLabeler, Reply, Request, get_labeler, labeler_kind
from colloquy.labelers.http import HttpError
from colloquy.operators import labeling, parsing
from colloquy.operators.current import current_turns

FENCE = "```"
BOB = '{"labels":[{"turn_id":0,"addressees":["Bob"]}]}'
FAILED = "failed"
CASES = [
    (BOB, ["Bob"]),
    ('[{"turn_id":0,"addressees":["Bob"]}]', ["Bob"]),
    ('{"turn_id":0,"addressee":"Bob"}', ["Bob"]),
    ('{"turn_id":"0","addressees":"Bob"}', ["Bob"]),
    ('{"turn_id":0.9,"addressees":["Bob"]}', ["Bob"]),
    ('{"turn_id":false,"addressees":["Bob"]}', ["Bob"]),
    ('{"turn_id":"0.5","addressees":["Bob"]}', ["UNKNOWN"]),
    ('[1, "x", null, {"addressees":["Bob"]}]', ["UNKNOWN"]),
    ('{"turn_id":0,"addressees":["UNKNOWN","Bob"]}', ["UNKNOWN"]),
    ('{"turn_id":0,"addressees":["Zed"]}', ["UNKNOWN"]),
    ('{"turn_id":0,"addressees":["Alice"]}', ["UNKNOWN"]),
    ('{"turn_id":0,"addressees":[" Bob "]}', ["Bob"]),
    ('{"turn_id":0,"addressees":{"Bob":1}}', ["Bob"]),
    ('{"turn_id":0,"addressees":null}', FAILED),
    ('{"turn_id":0,"addressees":5}', FAILED),
    ('[{"turn_id":0,"addressees":["Carol"]},{"turn_id":0,"addressees":["Bob"]}]', ["Bob"]),
    ('[{"turn_id":7,"addressees":null},{"turn_id":0,"addressees":["Bob"]}]', ["Bob"]),
    ('<think>{"x":1}</think>' + BOB, ["Bob"]),
    ("<think>never ends", FAILED),
    ("no json at all", FAILED),
    ('{"labels": [', FAILED),
    ("[note] " + BOB, FAILED),
    ('{"labels": null}', FAILED),
    ('{"turn_id":0,"addressees":["Bob"],"rationale":"a } in \\" it"}', ["Bob"]),
    (f"Here:\n{FENCE}json\n{BOB}\n{FENCE}\nor\n{FENCE}[]{FENCE}", ["Bob"]),
    (None, FAILED),
    ("", FAILED),
]


def targets(spark, ids=(0, 1)):
    rows = [("c", 0, i, ["Alice", "Bob"][i], ["Alice", "Bob", "Carol"]) for i in ids]
    return spark.createDataFrame(rows, "conversation_id string, window_id bigint, turn_id bigint, speaker string, speakers array<string>")


def test_edge_table(spark):
    responses = spark.createDataFrame([(f"c{k}", 0, raw) for k, (raw, _) in enumerate(CASES)], "conversation_id string, window_id bigint, raw string")
    wide = targets(spark).drop("conversation_id").crossJoin(responses.select("conversation_id"))
    rows = parsing.labels_from_responses(responses, wide, "m").collect()
    got = {(r.conversation_id, r.turn_id): r for r in rows}
    for k, (raw, expected) in enumerate(CASES):
        zero, one = got[f"c{k}", 0], got[f"c{k}", 1]
        if expected == FAILED:
            assert (zero.addressees, zero.confidence, zero.labeler) == (["UNKNOWN"], 0.0, "m(failed)"), raw
            assert zero.rationale.startswith("labeler failed: ") and one.labeler == "m(failed)", raw
        else:
            assert zero.addressees == expected and zero.labeler == "m", raw
            assert (one.addressees, one.confidence, one.rationale) == (["UNKNOWN"], 0.0, "missing from model output"), raw


@pytest.mark.parametrize("raw,expected", [("true", 1.0), ('"0.9"', None), ("1.7", 1.7), ("null", None)])
def test_confidence(raw, expected):
    error, items = parsing.parse_response('{"turn_id":0,"addressees":["B"],"confidence":%s}' % raw)
    assert error is None and items[0][2] == expected


def test_infinite_turn_id_fails_the_window():
    assert parsing.parse_response('{"turn_id":Infinity}')[0] == "OverflowError"
    assert math.isnan(parsing.parse_response('{"turn_id":0,"confidence":NaN}')[1][0][2])


def counting_labeler(folder):
    """Answers C for every target, fails on windows that hold the word fail, and leaves a file for every call."""

    def open_():
        def answer(request):
            (folder / uuid.uuid4().hex).touch()
            if ": fail" in request.prompt:
                raise RuntimeError("no")
            ids = [int(line.split("turn ")[1].split(")")[0]) for line in request.prompt.split("\n") if line.startswith("[>> ]")]
            return Reply(json.dumps({"labels": [{"turn_id": i, "addressees": ["C"]} for i in ids]}), 10, len(ids))

        return answer

    return ModelLabeler("m", open_, model="m", engine="e")


def test_run_calls_once_per_window_and_resumes(spark, tmp_path):
    rows = conversations(spark, [conversation(c, [turn(i, "AB"[i % 2], float(i), i + 0.5, "fail" if i == 5 else "x") for i in range(6)], ["A", "B", "C"]) for c in "cde"])
    calls = tmp_path / "calls"
    calls.mkdir()
    labeler, n_calls = counting_labeler(calls), lambda: len(list(calls.iterdir()))
    turns, rosters, store, seen = current_turns(rows), rows.select("conversation_id", "speakers"), labeling.LabelStore(spark, str(tmp_path / "store")), []
    run = lambda **k: labeling.run_labeler(turns, rosters, labeler, store, 2, 1, **k)
    first = {(r.conversation_id, r.turn_id): r for r in run(waves=3, on_progress=seen.append).collect()}
    assert len(first) == 18 and n_calls() == 9, "one call for each window, the failing ones too"
    assert all((r.addressees[0], r.labeler) == (("C", "m") if t < 4 else ("UNKNOWN", "m(failed)")) for (_, t), r in first.items())
    assert first["c", 5].rationale == "labeler failed: RuntimeError"
    assert [s["wave"] for s in seen] == [0, 1, 2] and sum(s["windows"] for s in seen) == 9 and sum(s["failed"] for s in seen) == 6
    assert run().count() == 18 and n_calls() == 9
    assert run(retry_failed=True).count() == 18 and n_calls() == 12
    stats = labeling.run_stats(store, labeler, 5.0, turns).first()
    assert (stats.n_calls, stats.input_tokens, stats.output_tokens, stats.n_turns, stats.failed_labels) == (12, 60, 12, 18, 6)
    store.compact()
    assert store.labels().count() == 18 and len(store.batches("labels")) == 1 and run().count() == 18 and n_calls() == 12
    with pytest.raises(Exception, match="RuntimeError"):
        run(retry_failed=True, fail_fast=True)


def test_responses_without_labels_are_parsed_and_not_asked_again(spark, tmp_path):
    rows = conversations(spark, [conversation("c", [turn(i, "AB"[i % 2], float(i), i + 0.5) for i in range(4)], ["A", "B", "C"])])
    (tmp_path / "calls").mkdir()
    labeler, turns, rosters = counting_labeler(tmp_path / "calls"), current_turns(rows), rows.select("conversation_id", "speakers")
    store = labeling.LabelStore(spark, str(tmp_path / "store"))
    windows = labeling.tiles(turns, 2, 1)
    store.append("responses", 1, labeling.responses_of(labeling.prompts_of(windows, rosters), labeler))
    assert store.unparsed() == [1] and store.labels().count() == 0
    assert labeling.run_labeler(turns, rosters, labeler, store, 2, 1).count() == 4 and len(list((tmp_path / "calls").iterdir())) == 2
    heuristic = labeling.run_labeler(turns, rosters, HeuristicLabeler(), str(tmp_path / "h"), 2, 1)
    assert heuristic.count() == 4 and {r.labeler for r in heuristic.collect()} == {"heuristic(noise=0)"}
    other = heuristic.limit(1).withColumn("labeler", F.lit("new"))
    assert sorted(r.labeler for r in labeling.with_updates(heuristic, other).collect())[-1] == "new"


def test_a_window_is_parsed_by_one_python_step(spark):
    responses = spark.createDataFrame([("c", 0, BOB)], "conversation_id string, window_id bigint, raw string")
    plan = parsing.labels_from_responses(responses, targets(spark), "m")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_labelers():
    sent = []

    def chat(method, url, headers, body):
        sent.append((method, url, headers, body))
        if "temperature" in body and body["model"] == "cold":
            raise HttpError(400, "temperature is unsupported with this model")
        return {"choices": [{"message": {"content": BOB}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}

    ask = Request("system", "prompt", "a.wav", 1.0, 2.0)
    answer = get_labeler("GPT", model="cold", api_key="k", send=chat, cut=lambda p, a, s: b"wav").open()
    assert answer(ask) == Reply(BOB, 7, 3) and answer(ask).text == BOB
    assert ["temperature" in b for *_, b in sent] == [True, False, False] and sent[0][3]["modalities"] == ["text"]
    assert sent[0][3]["messages"][1]["content"][1]["input_audio"]["data"] == "d2F2" and sent[0][2] == {"Authorization": "Bearer k"}
    sent.clear()
    assert get_labeler(" Qwen ", base_url="http://h/v1/", send=chat).open()(ask).output_tokens == 3
    assert sent[0][1] == "http://h/v1/chat/completions" and "max_tokens" in sent[0][3] and sent[0][3]["response_format"] == {"type": "json_object"}

    files = iter([{"file": {"name": "files/1", "state": "PROCESSING"}}, {"name": "files/1", "uri": "u", "state": "ACTIVE"}])
    log = []

    def gemini(method, url, headers, body):
        log.append((method, url.rpartition("/")[2]))
        if "generateContent" in url:
            assert body["contents"][0]["parts"][1]["file_data"]["file_uri"] == "u"
            return {"candidates": [{"content": {"parts": [{"text": BOB}]}}], "usageMetadata": {"promptTokenCount": 5}}
        return {} if method == "DELETE" else next(files)

    got = get_labeler("golden", model="g", api_key="k", send=gemini, cut=lambda p, a, s: b"wav", sleep=lambda s: None).open()(ask)
    assert got == Reply(BOB, 5, 0) and [m for m, _ in log] == ["POST", "GET", "POST", "DELETE"]

    local = get_labeler("vLLM", model="x", thinking=False, load=lambda: lambda s, p: (p, 1, 2))
    assert local.name == "x(no-think)" and local.engine == "vllm" and local.open()(ask) == Reply("prompt", 1, 2)
    assert get_labeler("mock", noise=0.35).name == "heuristic(noise=0.35)"
    assert labeler_kind(" VLLM ") == "local"
    for wrong in (lambda: labeler_kind("nobody"), lambda: get_labeler("local", engine="none")):
        with pytest.raises(ValueError):
            wrong()
