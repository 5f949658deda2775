import numpy as np
import pandas as pd
import pytest
from helpers import conversation, conversations, tuples, turn
from pyspark.sql import functions as F

from colloquy.llm import sampling
from colloquy.llm.sampling import calibrate, draw_sample, duel

TARGETS = "plan_id bigint, category string, min_speakers bigint, max_speakers bigint, overlapped boolean, share_bp bigint, min_turns bigint, sample_size bigint"


def test_calibration_hits_overlapping_targets():
    counts = np.array([100, 200, 300, 50])
    member = np.array([[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 0, 1]], bool)
    p = calibrate(counts, member, np.array([60, 120, 50]))
    assert np.allclose(member @ (counts * p), [60, 120, 50], atol=1e-4) and p.max() <= 1


def test_calibration_saturates():
    counts, member = np.array([10, 1000]), np.array([[1, 1], [1, 0]], bool)
    p = calibrate(counts, member, np.array([500, 10]))
    assert p[0] == 1.0 and abs(counts @ p - 500) < 1e-3
    assert calibrate(np.array([0, 5]), np.array([[1, 0], [0, 1]], bool), np.array([0, 0])).tolist() == [0, 0]


def test_duels_keep_probabilities_and_size():
    p = np.array([0.2, 0.5, 0.7, 0.1, 0.9, 0.6] * 5)
    rng = np.random.default_rng(1)
    hits = np.zeros(len(p))
    for _ in range(4000):
        drawn, open_, rest = duel(p, rng)
        assert len(open_) <= 1 and abs(len(drawn) + rest.sum() - p.sum()) < 1e-6
        hits[drawn] += 1
    assert np.abs(hits / 4000 - p).max() < 0.04


def test_sample(spark):
    rows = [conversation(f"c{i}", [turn(k, "AB"[k % 2], float(k), k + 1.0, f"t{k}", [True, False, None][k % 3]) for k in range(30)], ["A", "B"] if i % 4 else None) for i in range(40)]
    rows += [conversation("big", [turn(k, "ABC"[k % 3], float(k), k + 1.0, "x", True) for k in range(5)], ["A", "B", "C"]), rows[0], conversation("none", None)]
    targets = [
        (1, "two_clear", 2, 2, False, 6000, 0, 300), (1, "two_overlap", 2, 2, True, 3000, 0, 300), (1, "three", 3, 9, True, 1000, 20, 300),
        (2, "small", 3, 3, True, 1, 3, 100), (2, "absent", 8, 9, False, 5000, 1, 100), (2, "null", None, 2, True, 10, 1, 100), (2, "small", 3, 3, True, 1, 3, 100),
    ]
    sample, report = draw_sample(conversations(spark, rows), spark.createDataFrame(targets, TARGETS), chunk_rows=64)
    got = {(r.plan_id, r.category): (r.available, r.wanted, r.drawn, r.gap, r.short) for r in report.collect()}
    assert got[1, "two_clear"] == (800, 180, 180, 0, False)
    assert got[1, "two_overlap"] == (400, 90, 90, 0, False)
    assert got[1, "three"] == (5, 30, 5, 25, True)
    assert got[2, "small"] == (5, 3, 3, 0, False)
    assert got[2, "absent"] == (0, 50, 0, 50, True) and got[2, "null"] == (0, 1, 0, 1, True)
    units = sample.toPandas()
    assert len(units) == 278 and not units.duplicated(["plan_id", "conversation_id", "turn_id"]).any()
    assert abs(units[units.plan_id == 1].weight.sum() - 1205) < 1e-3  # the weights stand for all units that could be drawn


def test_the_draw_does_not_hang_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PART_UNITS", 64)
    rows = [conversation(f"c{i}", [turn(k, "AB"[k % 2], float(k), k + 1.0, f"t{k}", k % 3 == 0) for k in range(25)], ["A", "B"]) for i in range(40)]
    targets = spark.createDataFrame([(1, "a", 2, 2, False, 7000, 0, 200), (1, "b", 2, 2, True, 3000, 0, 200)], TARGETS)
    frame, drawn = conversations(spark, rows), []
    for layout, partitions in ((frame.coalesce(1), 1), (frame.repartition(7), 5)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            drawn.append(tuples(draw_sample(layout, targets, chunk_rows=50)[0].select("conversation_id", "turn_id")))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert drawn[0] == drawn[1] and len(drawn[0]) == 200


def test_cells_and_their_bound(spark, monkeypatch):
    targets = pd.DataFrame([(1, 5, True), (3, 3, False), (2, None, True), (6, 4, True)], columns=["min_speakers", "max_speakers", "overlapped"])
    grid = sampling.Grid(targets)
    n = spark.range(0, 9).select(F.col("id").alias("n"))
    cell = {(r.n, r.o): r.c for o in (True, False) for r in n.select("n", F.lit(o).alias("o"), grid.cell(F.col("n"), F.lit(o)).alias("c")).collect()}
    for row in targets.itertuples(index=False):
        inside = {k for k, c in cell.items() if c in grid.members(row)}
        assert inside == {(k, o) for k, o in cell if o == row.overlapped and row.max_speakers == row.max_speakers and row.min_speakers <= k <= row.max_speakers}
    monkeypatch.setattr(sampling, "MOST_CUTS", 2)
    with pytest.raises(ValueError, match="distinct bounds"):
        sampling.Grid(targets)


def test_empty(spark):
    sample, report = draw_sample(conversations(spark, []), spark.createDataFrame([(1, "a", 1, 2, True, 10000, 1, 10)], TARGETS))
    assert sample.count() == 0 and [(r.available, r.wanted, r.short) for r in report.collect()] == [(0, 10, True)]
    sample, report = draw_sample(conversations(spark, [conversation("c", [turn(0)])]), spark.createDataFrame([], TARGETS))
    assert sample.count() == 0 and report.count() == 0
