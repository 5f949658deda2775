import json

from helpers import conversation, conversations, label, label_sets, tuples, turn
from pyspark.sql import functions as F

from colloquy.operators import metrics
from colloquy.operators.labels import one_label_per_turn
from colloquy.operators.report import as_dict, as_text, write_report


def small(spark):
    c = conversations(spark, [conversation("c", [turn(0, "Alice", 0.0, 1.0, "Bob, ready?"), turn(1, "Bob", 1.0, 2.0, "Yes"), turn(2, "Alice", 2.0, 3.0, "Nice.", True)], ["Alice", "Bob", "Carol"])])
    gold = label_sets(spark, [("c", [label(0, ["Bob"]), label(1, ["Alice"]), label(2, ["Bob"]), label(9, ["Bob"])])])
    pred = label_sets(spark, [("c", [label(0, ["Bob "]), label(1, ["Alice", "Alice", None, ""]), label(2, ["GROUP"])])])
    return gold, pred, c


def test_evaluation_of_three_turns(spark, tmp_path):
    e = metrics.evaluate(*small(spark))
    rows = {r.stratum: r for r in e.summary.collect()}
    assert set(rows) == set(metrics.STRATA)
    assert rows["overall"].n == 3 and abs(rows["overall"].exact_match - 2 / 3) < 1e-9
    assert rows["overlap"].n == 1 and rows["overlap"].exact_match == 0.0
    assert rows["two_party"].n == 0 and rows["two_party"].exact_match is None and rows["two_party"].kappa is None
    assert rows["backchannel"].n == 1
    classes = {r["class"]: r for r in e.per_class.collect()}
    assert classes["Bob"].recall == 0.5 and classes["GROUP"].precision == 0.0
    assert tuples(e.confusion) == [("Alice", "Alice", 1), ("Bob", "Bob", 1), ("Bob", "GROUP", 1)]
    assert e.verdict.first().accepted is False
    report = as_dict(e)
    assert report["result"]["strata"]["two_party"] == {"n": 0} and report["result"]["n_scored_turns"] == 3
    text = as_text(report)
    assert "FAIL" in text and "n/a" in text
    write_report(report, tmp_path / "deep" / "report.json")
    assert json.loads((tmp_path / "deep" / "report.json").read_text()) == report
    assert metrics.dense_confusion(e.records).count() == 9


def test_kappa_values(spark):
    def of(pairs):
        cells = spark.createDataFrame([(g, p, n) for g, p, n in pairs], "gold_label string, pred_label string, n bigint")
        return metrics.kappa(cells.withColumn("s", F.lit(1)), ["s"]).first().kappa

    assert abs(of([("X", "X", 4), ("Y", "Y", 4), ("X", "Y", 1), ("Y", "X", 1)]) - 0.6) < 1e-12
    assert of([("A", "A", 1), ("B", "B", 1)]) == 1.0
    assert of([("A", "A", 2)]) == 1.0
    assert of([("A", "B", 2)]) == of([("B", "A", 2)]) == 0.0


def test_missing_metadata_and_empty_sets(spark):
    gold = label_sets(spark, [("gone", [label(0, []), label(1, ["UNKNOWN", "B"])])])
    pred = label_sets(spark, [("gone", [label(0, None), label(1, ["UNKNOWN"])])])
    rows = metrics.records(gold, pred, conversations(spark, [])).orderBy("turn_id").collect()
    assert [(r.n_speakers, r.overlap, r.backchannel, r.exact, r.jaccard, r.both_single) for r in rows] == [(0, False, False, True, 1.0, False), (0, False, False, True, 1.0, True)]


def test_strata_add_up_and_symmetry(spark):
    gold, pred, c = small(spark)
    a, b = (metrics.summary(metrics.records(x, y, c)).where("stratum = 'overall'").first() for x, y in ((gold, pred), (pred, gold)))
    assert a.kappa == b.kappa and a.micro_f1 == b.micro_f1
    counts = {r.stratum: r.n for r in metrics.summary(metrics.records(gold, pred, c)).collect()}
    assert counts["overlap"] + counts["non_overlap"] == counts["overall"] == counts["two_party"] + counts["multi_party"]


def test_one_label_per_turn(spark):
    rows = label_sets(spark, [("c", [label(0, ["B"], 0.5), label(0, ["A"], 90.0), label(0, ["C"], None), label(1, ["B"], None), label(1, ["A"], None)]), ("c", [label(0, ["B"], 0.5)])])
    assert [(r.turn_id, r.addressees) for r in one_label_per_turn(rows).orderBy("turn_id").collect()] == [(0, ["A"]), (1, ["A"])]


def test_empty_tables(spark):
    none = label_sets(spark, [])
    rows = {r.stratum: r.n for r in metrics.summary(metrics.records(none, none, conversations(spark, []))).collect()}
    assert rows == dict.fromkeys(metrics.STRATA, 0)
