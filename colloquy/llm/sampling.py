"""Samples whose category shares match given targets: calibration by exponential tilting, drawing by the pivotal method."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.current import current_turns
from colloquy.session import cut_lineage

#: Most plan categories that are held on the driver (a row each of some hundred bytes), and most distinct bounds of them: the cells
#: of a plan, for which the dual is solved, are twice as many.
MOST_CATEGORIES, MOST_CUTS = 100_000, 2_000
#: About how many units a part of the population holds; parts are dealt by a hash of the keys, their number is a power of two.
PART_UNITS = 1 << 20
NEWTON_STEPS = 60


def population(conversations: DataFrame) -> DataFrame:
    """(conversation_id, turn_id, n_speakers, overlapped): a row for each distinct turn of current conversations; overlap null is false."""
    return current_turns(
        conversations,
        speakers=True,
        turn_id=lambda t: t["turn_id"],
        overlapped=lambda t: F.coalesce(t["overlap"], F.lit(False)),
        __content=lambda t: F.xxhash64(t["speaker"], t["start"], t["end"], t["text"]),
    )


def read_targets(sample_targets: DataFrame) -> pd.DataFrame:
    """The distinct target rows on the driver, with ``wanted``: the larger of min_turns and the rounded-down share."""
    rows = sample_targets.select(
        "plan_id", "category", "min_speakers", "max_speakers", "overlapped", "share_bp", "min_turns", "sample_size"
    ).distinct()
    got = rows.limit(MOST_CATEGORIES + 1).toPandas()
    if len(got) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} plan categories")
    got = got.sort_values(["plan_id", "category", "min_speakers", "max_speakers", "overlapped"], ignore_index=True)
    for name in ("share_bp", "sample_size", "min_turns"):
        got[name] = got[name].fillna(0).astype("int64")
    got["wanted"] = np.maximum(got.min_turns, got.share_bp * got.sample_size // 10000)
    return got


class Grid:
    """The population's cells: elementary ranges of the number of speakers, cut where any target begins or ends, by overlap."""

    def __init__(self, targets: pd.DataFrame):
        low, high = targets.min_speakers.dropna(), targets.max_speakers.dropna() + 1
        self.cuts = np.unique(np.concatenate([low, high]).astype("int64"))
        if len(self.cuts) > MOST_CUTS:
            raise ValueError(f"{len(self.cuts)} distinct bounds of categories, more than {MOST_CUTS}")
        self.size = 2 * (len(self.cuts) + 1)

    def cell(self, n_speakers: Column, overlapped: Column) -> Column:
        """The cell number, an expression: twice the count of cuts at or below the number of speakers, plus one for overlap.

        A search by halves, as nested conditions: some ten comparisons for a turn at the most cuts allowed.
        """

        def below(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(n_speakers >= int(self.cuts[middle]), below(middle + 1, high)).otherwise(below(low, middle))

        return (2 * below(0, len(self.cuts)) + overlapped.cast("int")).cast("int")

    def members(self, row: pd.Series) -> np.ndarray:
        """The numbers of the cells that a target row covers; none where one of its bounds is null."""
        if pd.isna(row.min_speakers) or pd.isna(row.max_speakers) or row.overlapped is None or row.min_speakers > row.max_speakers:
            return np.zeros(0, "int64")
        first = np.searchsorted(self.cuts, row.min_speakers) + 1
        last = np.searchsorted(self.cuts, row.max_speakers + 1) + 1
        return 2 * np.arange(first, last) + int(bool(row.overlapped))


def calibrate(counts: np.ndarray, member: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Inclusion probability of each cell such that the expected number in every category is its ``wanted``.

    Newton iterations on the dual of exponential tilting: the probability of a cell is exp(sum of the multipliers of the
    categories that hold it), starting from an even rate; gradient and Hessian are moments over the cells. Cells driven over 1
    are fixed at 1 and the rest is solved again. ``wanted`` must not exceed what is available. Cells in no category have 0.
    """
    probability = np.zeros(len(counts))
    live = member.any(0) & (counts > 0)
    full = np.zeros(len(counts), bool)
    for _ in range(len(counts) + 1):
        free = live & ~full
        rest = wanted - member[:, full] @ counts[full]
        rows = (member[:, free] @ counts[free] > 0) & (rest > 0)
        none = member[~rows & (rest <= 0)][:, free].any(0)  # categories that want nothing (more)
        ids = np.flatnonzero(free)[~none]
        probability[np.flatnonzero(free)[none]] = 0.0
        if len(ids) == 0 or not rows.any():
            break
        a, n, t = member[rows][:, ids].astype(float), counts[ids].astype(float), rest[rows].astype(float)
        multipliers = np.zeros(len(t))
        base = max(1e-12, min(1.0, t.sum() / n.sum()))
        for _ in range(NEWTON_STEPS):
            p = base * np.exp(np.clip(multipliers @ a, -60, 60))
            gradient = a @ (n * p) - t
            if np.abs(gradient).max() <= 1e-9 * max(1.0, t.max()):
                break
            hessian = (a * (n * p)) @ a.T
            step = np.linalg.lstsq(hessian + 1e-12 * np.trace(hessian) * np.eye(len(t)), gradient, rcond=None)[0]
            multipliers -= np.clip(step, -3, 3)
        p = base * np.exp(np.clip(multipliers @ a, -60, 60))
        over = p > 1 + 1e-9
        probability[ids] = np.minimum(p, 1.0)
        if not over.any():
            break
        full[ids[over]] = True
    probability[full] = 1.0
    return probability


def duel(p: np.ndarray, rng: np.random.Generator, least: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pivotal method on units with probabilities ``p``: (indices drawn, indices still open, their probabilities); one at most is open.

    In a round every open unit meets another: below 1 in sum the winner takes both probabilities and the loser is out, above 1
    the winner is drawn and the loser keeps what exceeds 1. Each duel decides a unit at least, so all rounds together touch each
    unit about twice. ``least`` is how near to 0 or 1 counts as decided.
    """
    p = p.astype(float).copy()
    drawn = [np.flatnonzero(p >= 1 - least)]
    open_ = np.flatnonzero((p > least) & (p < 1 - least))
    while len(open_) > 1:
        even = len(open_) - len(open_) % 2
        a, b, odd = open_[:even:2], open_[1:even:2], open_[even:]
        pa, pb = p[a], p[b]
        total, r = pa + pb, rng.random(len(a))
        low = total <= 1
        a_wins = np.where(low, r * total < pa, r * (2 - total) < 1 - pb)
        winner, loser = np.where(a_wins, a, b), np.where(a_wins, b, a)
        p[winner], p[loser] = np.where(low, total, 1.0), np.where(low, 0.0, total - 1)
        both = np.concatenate([winner, loser])
        drawn.append(both[p[both] >= 1 - least])
        open_ = np.concatenate([both[(p[both] > least) & (p[both] < 1 - least)], odd])
    return np.concatenate(drawn), open_, p[open_]


UNITS = "plan_id bigint, cell int, conversation_id string, turn_id bigint, probability double, open double, part bigint"


def _first_level(rates: dict[int, np.ndarray], seed: int, chunk_rows: int):
    """A task that duels the units of each part within every (plan, cell); what stays open, one unit each, comes out with ``open`` not null.

    Rows come sorted by part and by a hash within it; chance is seeded by the part, and chunks are cut by number within the part: the
    draw is the same however the parts lie in tasks and batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rng = -1, np.random.default_rng(seed)
        left: dict[tuple[int, int], tuple[str, int, float]] = {}

        def settle(chunk: pd.DataFrame) -> Iterator[pd.DataFrame]:
            ids, turns, cells = chunk.conversation_id.to_numpy(object), chunk.turn_id.to_numpy(object), chunk.cell.to_numpy()
            order = np.argsort(cells, kind="stable")
            bounds = np.searchsorted(cells[order], np.arange(int(cells.max()) + 2))
            for plan, rate in rates.items():
                picks, of = [], []
                for cell in np.flatnonzero(rate > 0):
                    if cell >= len(bounds) - 1 or bounds[cell] == bounds[cell + 1]:
                        continue
                    units = order[bounds[cell] : bounds[cell + 1]]
                    if rate[cell] >= 1 - 1e-9:
                        picks.append(units)
                        of.append(np.full(len(units), cell))
                        continue
                    carried = left.pop((plan, cell), None)
                    p = np.full(len(units) + (carried is not None), rate[cell])
                    if carried:
                        p[-1] = carried[2]
                    drawn, open_, rest = duel(p, rng)
                    if carried and (drawn == len(units)).any():
                        yield _units(plan, [cell], [carried[0]], [carried[1]], [rate[cell]], None, part)
                    picks.append(units[drawn[drawn < len(units)]])
                    of.append(np.full(len(picks[-1]), cell))
                    for k, q in zip(open_, rest):
                        left[plan, cell] = (carried[0], carried[1], q) if k == len(units) else (ids[units[k]], turns[units[k]], q)
                if picks:
                    at, cell = np.concatenate(picks), np.concatenate(of)
                    yield _units(plan, cell, ids[at], turns[at], rate[cell], None, part)

        def open_units() -> Iterator[pd.DataFrame]:
            for (plan, cell), (conversation, turn, q) in left.items():
                yield _units(plan, [cell], [conversation], [turn], [rates[plan][cell]], [q], part)
            left.clear()

        held = pd.DataFrame()
        for batch in batches:
            parts = batch["part"].to_numpy()
            edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1)) if len(parts) else np.zeros(1, int)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows = batch.iloc[low:high]
                if rows["part"].iloc[0] != part:
                    if len(held):
                        yield from settle(held)
                    yield from open_units()
                    part, held = int(rows["part"].iloc[0]), pd.DataFrame()
                    rng = np.random.default_rng([seed, part])
                held = pd.concat([held, rows], ignore_index=True) if len(held) else rows.reset_index(drop=True)
                while len(held) >= chunk_rows:
                    yield from settle(held.iloc[:chunk_rows].reset_index(drop=True))
                    held = held.iloc[chunk_rows:].reset_index(drop=True)
        if len(held):
            yield from settle(held)
        yield from open_units()

    return run


def _units(plan, cell, conversation, turn, probability, open_, part) -> pd.DataFrame:
    return pd.DataFrame(
        {"plan_id": plan, "cell": np.asarray(cell, "int32"), "conversation_id": conversation, "turn_id": pd.array(turn, "Int64"),
         "probability": np.asarray(probability, float), "open": np.nan if open_ is None else open_, "part": part}
    )


def _next_level(seed: int, last: bool):
    """A group of open units: duels within each cell; on the last level then across the cells, and what is left is rounded."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["cell", "part"], ignore_index=True)
        rng = np.random.default_rng([seed, abs(int(group.plan_id.iloc[0])), int(group.part.min())])
        p = group.open.to_numpy(float).copy()
        drawn, open_ = [], []
        for _, units in group.groupby("cell").indices.items():
            won, still, rest = duel(p[units], rng)
            drawn.append(units[won])
            p[units[still]] = rest
            open_.append(units[still])
        open_ = np.concatenate(open_) if open_ else np.array([], int)
        if last and len(open_):
            won, still, rest = duel(p[open_], rng, 1e-6)
            drawn += [open_[won], open_[still[rng.random(len(still)) < rest]]]
            open_ = open_[:0]
        drawn = np.concatenate(drawn)
        out = pd.concat([group.loc[drawn].assign(open=np.nan), group.loc[open_].assign(open=p[open_], part=group.part.min() // 512)])
        return out

    return run


def draw_sample(conversations: DataFrame, sample_targets: DataFrame, seed: int = 20, chunk_rows: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every plan of ``sample_targets``.

    sample: plan_id, conversation_id, turn_id, weight (inverse of the inclusion probability); a turn at most once in a plan.
    report: plan_id, category, available, wanted, drawn, gap (wanted less drawn, at least 0), short (fewer available than wanted).

    The category moments are one distributed count by cell; the dual is solved on the driver over cells, of which there are at
    most four for each target row, whatever the population. Where a category has fewer turns than it wants all of them are taken.
    The drawing reads the turns once for all plans: dealt to parts by a hash of their keys, the units of a part duel within each
    (plan, cell) and at most one open unit each is handed on; these are settled in two further levels, the second by plan. The draw
    depends on the turns and the seed alone, not on how they lie in files, tasks or executors. With categories that do not overlap, each gets
    exactly what it wants; overlapping ones whose targets contradict each other come as near as the dual does, and the report
    tells. Null bounds or overlap in a target match nothing; null plan_id rows count as plan -1. Empty tables give empty results.
    """
    spark = conversations.sparkSession
    targets = read_targets(sample_targets)
    targets["plan_id"] = targets.plan_id.fillna(-1).astype("int64")
    grid = Grid(targets)
    cells = population(conversations).withColumn("cell", grid.cell(F.col("n_speakers"), F.col("overlapped")))
    cells = cut_lineage(cells.select("conversation_id", "turn_id", "cell"))
    counts = np.zeros(grid.size, "int64")
    for cell, n in cells.groupBy("cell").count().collect():
        counts[cell] = n
    rates, member = {}, [grid.members(row) for row in targets.itertuples(index=False)]
    targets["available"] = np.array([counts[m].sum() for m in member], "int64")
    for plan, rows in targets.groupby("plan_id").indices.items():
        wanted = np.minimum(targets.wanted.to_numpy()[rows], targets.available.to_numpy()[rows])
        of_plan = np.zeros((len(rows), grid.size), bool)  # of one plan at a time
        for k, i in enumerate(rows):
            of_plan[k, member[i]] = True
        rates[int(plan)] = calibrate(counts, of_plan, wanted)
    wanted_cells = np.flatnonzero(sum(rates.values(), np.zeros(grid.size)) > 0)
    parts = 1 << max(3, int(counts[wanted_cells].sum() // PART_UNITS).bit_length())
    order = F.xxhash64(F.lit(seed), "conversation_id", "turn_id")
    settled = cut_lineage(
        cells.where(F.col("cell").isin([int(c) for c in wanted_cells]))
        .withColumn("part", F.pmod(order, F.lit(parts)).cast("bigint"))
        .repartition("part")
        .sortWithinPartitions("part", order, "conversation_id", "turn_id", "cell")
        .mapInPandas(_first_level(rates, seed, chunk_rows), UNITS)
    )
    drawn = settled.where(F.col("open").isNull())
    level2 = (
        settled.where(F.col("open").isNotNull())
        .groupBy("plan_id", F.floor(F.col("part") / 512).alias("__group"))
        .applyInPandas(_next_level(seed + 1, False), UNITS)
    )
    level2 = cut_lineage(level2)
    level3 = level2.where(F.col("open").isNotNull()).groupBy("plan_id").applyInPandas(_next_level(seed + 2, True), UNITS)
    chosen = drawn.unionByName(level2.where(F.col("open").isNull())).unionByName(level3)
    sample = chosen.select("plan_id", "conversation_id", "turn_id", (1 / F.col("probability")).alias("weight"))
    places = [(int(targets.plan_id[i]), int(i), int(c)) for i in range(len(targets)) for c in member[i]]
    place = spark.createDataFrame(places, "plan_id bigint, row int, cell int")
    per_cell = chosen.groupBy("plan_id", "cell").count()
    per_row = place.join(per_cell, ["plan_id", "cell"]).groupBy("row").agg(F.sum("count").alias("drawn"))
    listed = [(i, int(t.plan_id), t.category, int(t.available), int(t.wanted)) for i, t in enumerate(targets.itertuples(index=False))]
    report = spark.createDataFrame(listed, "row int, plan_id bigint, category string, available bigint, wanted bigint")
    report = report.join(per_row, "row", "left").select(
        "plan_id", "category", "available", "wanted",
        F.coalesce("drawn", F.lit(0)).alias("drawn"),
        F.greatest(F.col("wanted") - F.coalesce("drawn", F.lit(0)), F.lit(0)).alias("gap"),
        (F.col("available") < F.col("wanted")).alias("short"),
    )
    return sample, report
