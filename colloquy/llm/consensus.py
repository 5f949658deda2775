"""Consensus of several annotators: item-feature classifier and annotator confusions fitted together by expectation-maximisation."""

from __future__ import annotations

import io
import math
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import folded, is_backchannel, roster, strip
from colloquy.operators.current import current_conversations
from colloquy.session import cut_lineage

#: Most labelers whose confusions (KINDS * OUTCOMES numbers for each grade of confidence) are held on the driver and sent to the tasks.
MOST_LABELERS = 50_000

#: What a set of addressees is, and how a vote can stand to the true set.
KINDS = ("group", "single", "several")
OUTCOMES = ("same", "group", "part", "other single", "overlapping", "other several")
FEATURES = (
    "group", "several", "previous", "next", "before previous", "named", "named at start", "group in short turn", "group in question",
    "previous in backchannel", "previous after question", "next in question", "group by speakers", "several by speakers", "previous and next", "alone",
)
#: Most iterations; a fit that has not settled by then says so.
ITERATIONS = 40
#: Greatest change of the log-likelihood of a turn's votes, on average, at which the fit has converged.
SETTLED = 2e-4
L2 = 1.0
#: Upper ends of the grades of confidence on the unit scale; grade 0 is a missing or impossible one, the last is open up to 1.
GRADES = (0.75, 0.9)
#: Votes of a labeler's own rates that are added to what is counted in one grade.
SHRINK = 20.0
#: Pseudo-counts of the confusions, by outcome: most labelers are right more often than not.
PRIOR = np.array([[6.0, 0.0, 0.0, 2.0, 0.0, 1.0], [6.0, 1.0, 0.0, 1.5, 0.5, 0.2], [5.0, 1.0, 1.0, 0.5, 0.5, 0.2]])


def votes(golden: DataFrame) -> DataFrame:
    """(conversation_id, turn_id, labeler, vote, grade, label): one vote of a labeler on a turn, an addressee set as names joined by ``+``;
    label is a hash of the label it comes from, by which copies are known.

    Names are trimmed, null and empty ones dropped, distinct, sorted; a set with GROUP among others is GROUP. A label that then is
    empty or holds UNKNOWN, or has no labeler (null or blank), casts no vote. Labelers are folded. Where one gave different votes
    on one turn the more frequent counts, then the first in order; copies count once. The speaker's own name is left to
    :func:`items`, which knows the turn. grade is that of the confidence: 0 if null, NaN, negative or over 100, else by GRADES; what is over 1 is
    in per cent.
    """
    rows = golden.select("conversation_id", F.explode("labels").alias("__l")).select(
        "conversation_id",
        F.col("__l.turn_id").alias("turn_id"),
        folded(F.col("__l.labeler")).alias("labeler"),
        _grade(F.col("__l.confidence")).alias("grade"),
        F.xxhash64("__l").alias("label"),
        F.array_sort(
            F.array_distinct(F.filter(F.transform("__l.addressees", strip), lambda x: x.isNotNull() & (x != "")))
        ).alias("__set"),
    )
    rows = rows.where((F.col("labeler") != "") & (F.size("__set") > 0) & ~F.array_contains("__set", "UNKNOWN"))
    vote = F.when(F.array_contains("__set", "GROUP"), F.lit("GROUP")).otherwise(F.array_join("__set", "+"))
    return rows.select("conversation_id", "turn_id", "labeler", vote.alias("vote"), "grade", "label")


def _grade(confidence: Column) -> Column:
    unit = F.when(confidence > 1, confidence / 100).otherwise(confidence)
    above = sum((F.when(unit > g, 1).otherwise(0) for g in GRADES), F.lit(1))
    return F.when(confidence.between(0, 100), above).otherwise(0)  # Spark orders NaN above all numbers


def items(golden: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per turn with votes: what the classifier sees of the turn, and its votes as an array of (labeler, vote, grade).

    Of several confidences behind one labeler's vote on a turn the highest grade counts.
    """
    # copies are dropped in the map tasks: what is shuffled, once and by turn, is each different vote of a task; the groups after it lie within it
    cast = votes(golden).groupBy("conversation_id", "turn_id").agg(F.collect_set(F.struct("labeler", "vote", "grade", "label")).alias("__set"))
    cast = cast.select("conversation_id", "turn_id", F.inline("__set"))
    counted = cast.groupBy("conversation_id", "turn_id", "labeler", "vote").agg(F.count("*").alias("__n"), F.max("grade").alias("grade"))
    one = counted.groupBy("conversation_id", "turn_id", "labeler").agg(
        F.min_by(F.struct("vote", "grade"), F.struct(-F.col("__n"), F.col("vote"))).alias("__v")
    )
    one = one.select("conversation_id", "turn_id", "labeler", "__v.*")
    ballots = one.groupBy("conversation_id", "turn_id").agg(F.array_sort(F.collect_list(F.struct("labeler", "vote", "grade"))).alias("votes"))

    people = F.array_distinct(F.filter(F.transform(roster(F.col("speakers"), F.col("turns")), strip), lambda s: s.isNotNull()))
    asks = lambda text: F.coalesce(F.rlike(text, F.lit(r"[?？]\s*$")), F.lit(False))
    text_of = lambda t: F.coalesce(t["text"], F.lit(""))
    called = lambda t, s: F.startswith(t, F.concat(s, F.lit(","))) | F.endswith(t, F.concat(F.lit(", "), s, F.lit("?")))
    # what a text tells is found on the scan side: no text is moved
    current = current_conversations(
        conversations.withColumn("__people", people),
        roster=F.col("__people"),
        turns=F.transform(
            "turns",
            lambda t: F.struct(
                F.coalesce(t["start"], F.lit(0.0)).alias("start"), t["turn_id"].alias("turn_id"), strip(t["speaker"]).alias("speaker"),
                F.filter("__people", lambda s: F.contains(text_of(t), s) & (F.char_length(s) > 1)).alias("named"),
                F.filter("__people", lambda s: called(text_of(t), s)).alias("at_start"),
                asks(text_of(t)).alias("question"), is_backchannel(t["text"]).alias("backchannel"), F.char_length(text_of(t)).alias("length"),
            ),
        ),
    )
    wanted = golden.select("conversation_id").distinct()
    turns = current.join(wanted, "conversation_id", "left_semi").select("conversation_id", "roster", F.inline("turns"))
    turns = turns.dropDuplicates(["conversation_id", "turn_id"])
    order = Window.partitionBy("conversation_id").orderBy("start", "turn_id")
    last = F.lag("speaker").over(order)
    turns = turns.withColumns(
        {
            "__change": F.when(~last.eqNullSafe(F.col("speaker")), last),
            "after_question": F.coalesce(F.lag("question").over(order), F.lit(False)),
            "next": F.lead("speaker").over(order),
        }
    )
    turns = turns.withColumn("previous", F.last("__change", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    other = F.when(~F.col("__change").eqNullSafe(F.col("previous")), F.col("__change"))
    turns = turns.withColumn("before_previous", F.last(other, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    turns = turns.drop("start", "__change")
    rows = ballots.join(turns, ["conversation_id", "turn_id"], "left")
    mine = F.filter("votes", lambda v: ~v["vote"].eqNullSafe(F.col("speaker")))
    return rows.withColumn("votes", mine).where(F.size("votes") > 0)


class _Pattern:
    """The candidates of an item with so many other speakers and such votes, as masks, and how a vote stands to each of them."""

    def __init__(self, others: int, voted: tuple[int, ...], hinted: int = 0):
        """Candidates, at every size of the roster: GROUP, each other speaker, what was voted for, unions and intersections of two
        votes, and every set of two or three of which all but one are pointed to, by a vote or by the turn (by a name in it, or by
        speaking before or next): their number grows with the roster, not with its square or cube."""
        masks = dict.fromkeys([0, *(1 << i for i in range(others)), *voted])
        for a, b in combinations(voted, 2):
            masks |= dict.fromkeys((a | b, a & b) if a & b else (a | b,))
        likely = hinted
        for a in voted:
            likely |= a
        pool = [1 << i for i in range(likely.bit_length()) if likely >> i & 1]
        everybody = [1 << i for i in range(max(others, likely.bit_length()))]
        masks |= dict.fromkeys(a | b for a in pool for b in everybody if a != b)
        masks |= dict.fromkeys(a | b | c for a, b in combinations(pool, 2) for c in everybody if c not in (a, b))
        self.masks = list(masks)
        self.size = [m.bit_count() for m in self.masks]
        self.kind = [min(2, n) for n in self.size]
        self.others = max(1, others)
        listed = Counter(n for n in self.size if n > 1)
        self.offset = [-math.log(max(1.0, math.comb(self.others, n) / listed[n])) if n > 1 else 0.0 for n in self.size]
        self.rows: dict[int, tuple[list[int], list[float]]] = {}

    def row(self, vote: int) -> tuple[list[int], list[float]]:
        """For a vote, against each candidate as the truth: its outcome, and among how many votes that outcome is shared out."""
        got = self.rows.get(vote)
        if got is None:
            got = self.rows[vote] = tuple(map(list, zip(*(self._outcome(vote, m) for m in self.masks))))
        return got

    def _outcome(self, vote: int, truth: int) -> tuple[int, float]:
        if vote == truth:
            return 0, 1.0
        if not vote:
            return 1, 1.0
        if vote.bit_count() == 1:
            return (2, float(truth.bit_count())) if vote & truth else (3, max(1.0, self.others - truth.bit_count()))
        return (4, max(1.0, self.others - 1.0)) if vote & truth else (5, max(1.0, self.others * (self.others - 1) / 2))


def _graded(labeler: str, grade: int) -> str:
    return f"{labeler}\2{grade}"


@dataclass
class Block:
    """Some items as flat arrays: candidates of an item lie together, votes refer to an item, cells to (vote, candidate)."""

    key: pd.DataFrame
    candidates: list[str]
    item: np.ndarray  # of each candidate
    kind: np.ndarray
    x: np.ndarray
    offset: np.ndarray  # what a listed set stands for beside itself: of the sets of its size only those voted for are listed
    labeler: np.ndarray  # of each (vote, candidate) cell: index into names
    cell: np.ndarray  # its candidate
    outcome: np.ndarray
    spread: np.ndarray  # how many votes share the outcome
    voters: np.ndarray  # of each item
    ways: np.ndarray  # of each candidate: how many sets of its kind the turn's other speakers make
    names: list[str]  # labelers with the grade of their votes

    @classmethod
    def build(cls, rows: pd.DataFrame) -> Block:
        """Sets of names are bit masks over the other speakers of the turn, 0 being GROUP; how candidates stand to each other is
        worked out once for every pattern of masks."""
        candidates, size, kind, offset, labeler, cell, outcome, spread, voters = ([] for _ in range(9))
        near, item_of, facts = [], [], []
        names: dict[str, int] = {}
        patterns: dict[tuple, _Pattern] = {}
        for k, r in enumerate(rows.itertuples(index=False)):
            cast = [(_graded(v["labeler"], v["grade"]), v["vote"]) for v in r.votes]
            others = sorted({s for s in (r.roster if r.roster is not None else ()) if s and s != r.speaker})
            n_listed = len(others)
            bit = {s: 1 << i for i, s in enumerate(others)}
            masks = []
            for _, v in cast:
                mask = 0
                if v != "GROUP":
                    own = [s for s in v.split("+") if s != r.speaker] or v.split("+")
                    for s in own:
                        if s not in bit:
                            bit[s] = 1 << len(bit)
                            others.append(s)
                        mask |= bit[s]
                masks.append(mask)
            p, q, b = bit.get(r.previous, 0), bit.get(r.next, 0), bit.get(r.before_previous, 0)
            named = sum(bit.get(s, 0) for s in set(r.named)) if r.named is not None and len(r.named) else 0
            start = sum(bit.get(s, 0) for s in set(r.at_start)) if r.at_start is not None and len(r.at_start) else 0
            key = (n_listed, tuple(sorted(set(masks))), p | q | named | start)
            pattern = patterns.get(key)
            if pattern is None:
                pattern = patterns[key] = _Pattern(*key)
            first = len(candidates)
            candidates += [
                "GROUP" if not m else others[m.bit_length() - 1] if not m & (m - 1) else "+".join(sorted(s for i, s in enumerate(others) if m >> i & 1))
                for m in pattern.masks
            ]
            size += pattern.size
            kind += pattern.kind
            offset += pattern.offset
            item_of += [k] * len(pattern.masks)
            if named or start:
                near += [(m & p > 0, m & q > 0, m & b > 0, (m & named).bit_count(), (m & start).bit_count()) for m in pattern.masks]
            else:
                near += [(m & p > 0, m & q > 0, m & b > 0, 0, 0) for m in pattern.masks]
            length = r.length if r.length == r.length and r.length is not None else 1000
            facts.append((length < 25, bool(r.question), bool(r.backchannel), bool(r.after_question), max(1, n_listed)))
            voters.append(len(cast))
            for (who, _), m in zip(cast, masks):
                marks, shares = pattern.row(m)
                labeler += [names.setdefault(who, len(names))] * len(marks)
                cell += range(first, first + len(marks))
                outcome += marks
                spread += shares
        as_int = lambda v: np.array(v, "int64")
        item, kind_ = as_int(item_of), as_int(kind)
        share = 1 / np.maximum(1, as_int(size))
        prev, nxt, before, named_n, start_n = np.array(near, float).reshape(-1, 5).T
        short, question, backchannel, after, n = np.array(facts, float).reshape(-1, 5)[item].T
        group, several = (kind_ == 0) * 1.0, (kind_ == 2) * 1.0
        one = 1 - several
        x = np.stack([
            group, several, prev * share, nxt * share, before * share, named_n * share, start_n * share, group * short, group * question,
            prev * backchannel * one, prev * after * one, nxt * question * one, group * np.log(n), several * np.log(n), several * prev * nxt, (1 - group) * (n == 1),
        ], 1)
        key = rows[["conversation_id", "turn_id"]].reset_index(drop=True)
        ways = np.where(kind_ == 0, 1.0, np.where(kind_ == 1, n, np.maximum(1.0, n * (n - 1) / 2)))
        return cls(key, candidates, item, kind_, x, np.array(offset, float), as_int(labeler), as_int(cell), as_int(outcome), np.array(spread, float), as_int(voters), ways, list(names))

    def posterior(self, weights: np.ndarray, theta: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, float]:
        """(posterior of each candidate, the classifier's prior, log-likelihood of the votes). Without confusions: the prior times the share of votes."""
        linear = self.x @ weights + self.offset
        prior, below = _softmax(linear, self.item)
        if theta is None:
            same = np.bincount(self.cell[self.outcome == 0], minlength=len(self.item))
            score = 3.0 * same
        else:
            logs = np.log(np.array([theta.get(n, theta[""]) for n in self.names]).reshape(len(self.names), len(KINDS), len(OUTCOMES)))
            each = logs[self.labeler, self.kind[self.cell], self.outcome] - np.log(self.spread)
            score = np.bincount(self.cell, each, minlength=len(self.item))
        post, above = _softmax(score + linear, self.item)
        return post, prior, float((above - below).sum())

    def statistics(self, weights: np.ndarray, theta: dict[str, np.ndarray] | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
        """Expected confusion counts of each labeler and grade; gradient and Hessian of the classifier; log-likelihood of the votes."""
        post, prior, likelihood = self.posterior(weights, theta)
        flat = (self.labeler * len(KINDS) + self.kind[self.cell]) * len(OUTCOMES) + self.outcome
        counts = np.bincount(flat, post[self.cell], minlength=len(self.names) * len(KINDS) * len(OUTCOMES))
        counts = counts.reshape(len(self.names), len(KINDS), len(OUTCOMES))
        n = self.item[-1] + 1 if len(self.item) else 0
        mean = np.stack([np.bincount(self.item, prior * self.x[:, f], minlength=n) for f in range(self.x.shape[1])], 1) if n else np.zeros((0, self.x.shape[1]))
        gradient = (post - prior) @ self.x
        hessian = (self.x * prior[:, None]).T @ self.x - mean.T @ mean
        return dict(zip(self.names, counts)), gradient, hessian, likelihood


def _softmax(score: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(softmax within each group, logarithm of each group's sum)."""
    if not len(score):
        return score, score
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes, top = np.diff(np.append(starts, len(score))), np.maximum.reduceat(score, starts)
    p = np.exp(score - np.repeat(top, sizes))
    total = np.add.reduceat(p, starts)
    return p / np.repeat(total, sizes), np.log(total) + top


def _pack(block: Block) -> bytes:
    out = io.BytesIO()
    arrays = {k: getattr(block, k) for k in ("item", "kind", "x", "offset", "labeler", "cell", "outcome", "spread", "voters", "ways")}
    text = {k: np.array(v, object) for k, v in (("candidates", block.candidates), ("names", block.names), ("conversation", block.key.conversation_id.tolist()))}
    arrays |= {k: np.frombuffer("\0".join(x if x is not None else "\1" for x in v).encode(), "uint8") for k, v in text.items()}
    arrays["x"] = arrays["x"].astype("float32")
    np.savez(out, turn=block.key.turn_id.to_numpy("int64", na_value=-1), has_turn=block.key.turn_id.notna().to_numpy(), **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> Block:
    z = np.load(io.BytesIO(data))
    text = {k: [None if x == "\1" else x for x in z[k].tobytes().decode().split("\0")] for k in ("candidates", "names", "conversation")}
    turn = pd.array(z["turn"], "Int64")
    turn[~z["has_turn"]] = pd.NA
    key = pd.DataFrame({"conversation_id": text["conversation"], "turn_id": turn})
    return Block(key, text["candidates"], z["item"], z["kind"], z["x"].astype(float), z["offset"], z["labeler"], z["cell"], z["outcome"], z["spread"], z["voters"], z["ways"], text["names"])


@dataclass
class Consensus:
    """The fitted model: its packed items, the classifier's weights, a confusion matrix for each labeler and grade and for each labeler, how often it voted."""

    blocks: DataFrame
    weights: np.ndarray
    theta: dict[str, np.ndarray]
    own: dict[str, np.ndarray]
    n_votes: dict[str, float]
    accuracy: dict[str, float]
    vote_shares: np.ndarray
    iterations: int
    settled: bool

    def labels(self, least_voters: int = 1) -> DataFrame:
        """(conversation_id, turn_id, addressees, n_voters, agreement, agreement_by_chance, corrected, probability): the consensus of every turn.

        agreement is the share of the votes that equal the consensus; agreement_by_chance what that share would be if everybody had
        voted for GROUP, for one and for several as often as all do, and among the speakers at random; corrected is (agreement -
        by chance) / (1 - by chance), as in a kappa; probability is the posterior.
        """
        weights, theta, shares = self.weights, self.theta, self.vote_shares

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for data in batch["data"]:
                    b = _unpack(data)
                    post, _, _ = b.posterior(weights, theta)
                    order = np.lexsort((np.arange(len(post)), -post, b.item))
                    best = order[np.flatnonzero(np.diff(b.item[order], prepend=-1))]
                    same = np.bincount(b.cell[b.outcome == 0], minlength=len(b.item))[best]
                    chance = np.minimum(0.999, shares[b.kind[best]] / b.ways[best])
                    agreement = same / b.voters
                    out = b.key.assign(
                        addressees=[b.candidates[i] for i in best], n_voters=b.voters, agreement=agreement, agreement_by_chance=chance,
                        corrected=(agreement - chance) / (1 - chance), probability=post[best],
                    )
                    yield out[out.n_voters >= least_voters]

        return self.blocks.mapInPandas(
            run, "conversation_id string, turn_id bigint, addressees string, n_voters bigint, agreement double, agreement_by_chance double, corrected double, probability double"
        )

    def labelers(self) -> DataFrame:
        """(labeler, n_votes, reliability, right_on_group, right_on_single, right_on_several): expected shares of right votes."""
        rows = [
            (who, int(self.n_votes[who]), self.accuracy[who], *(float(self.own[who][k, 0]) for k in range(len(KINDS))))
            for who in sorted(self.n_votes)
        ]
        spark = self.blocks.sparkSession
        return spark.createDataFrame(
            rows, "labeler string, n_votes bigint, reliability double, right_on_group double, right_on_single double, right_on_several double"
        )


def fit_consensus(golden: DataFrame, conversations: DataFrame, iterations: int = ITERATIONS, block_items: int = 4096) -> Consensus:
    """Fit on every turn that has votes, until the votes' log-likelihood a turn rises by less than SETTLED or for ``iterations``.

    The truth of a turn is GROUP, one of the other speakers, or a set of them: each that was voted for, unions and intersections of two
    votes, and every two or three of whom all but one were voted for, are named or spoke before or next, by one rule at all sizes; a listed
    set stands for all of its size, so that the classifier isn't misled by candidates that only exist because of a vote. An iteration is one pass over
    the packed items: each task returns the confusion counts that it expects (E step) with the classifier's gradient and Hessian,
    summed in a shuffle of a few numbers; the driver re-estimates confusions with pseudo-counts and takes a Newton step on the L2
    regularised conditional logit, whose output is the prior of the next E step. Confusions are kept for every labeler and grade of confidence,
    drawn to the labeler's own, so that a confidence counts as far as this labeler's has proved to mean something. Items are independent, so no key is hot.

    An empty golden table gives an empty result. A conversation missing from ``conversations`` has no features but its votes count.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), block_items):
                block = Block.build(batch.iloc[low : low + block_items])
                yield pd.DataFrame({"data": [_pack(block)]})

    blocks = cut_lineage(items(golden, conversations).mapInPandas(pack, "data binary"))
    weights, theta, own, reliability, counts, before, settled, done = np.zeros(len(FEATURES)), None, {}, {}, {}, None, False, 0
    n_f = len(FEATURES)
    for _ in range(iterations):

        def expect(batches: Iterator[pd.DataFrame], weights=weights, theta=theta) -> Iterator[pd.DataFrame]:
            counts: dict[str, np.ndarray] = {}
            gradient, hessian, loss, n = np.zeros(n_f), np.zeros((n_f, n_f)), 0.0, 0
            for batch in batches:
                for data in batch["data"]:
                    block = _unpack(data)
                    c, g, h, likelihood = block.statistics(weights, theta)
                    n += len(block.voters)
                    for who, m in c.items():
                        counts[who] = counts.get(who, 0) + m
                    gradient, hessian, loss = gradient + g, hessian + h, loss + likelihood
            rows = [("l", who, k, v) for who, m in counts.items() for k, v in enumerate(m.ravel().tolist())]
            rows += [("g", "", k, v) for k, v in enumerate(gradient.tolist())] + [("h", "", k, v) for k, v in enumerate(hessian.ravel().tolist())]
            rows += [("n", "", 0, loss), ("n", "", 1, float(n))]
            yield pd.DataFrame(rows, columns=["part", "labeler", "k", "value"])

        stats = blocks.mapInPandas(expect, "part string, labeler string, k int, value double")
        summed = stats.groupBy("part", "labeler", "k").agg(F.sum("value").alias("value"))
        if done == 0:  # before anything is read: a row for each grade of a labeler, counted where they are
            names = summed.where("part = 'l' AND k = 0").select(F.substring_index("labeler", "\2", 1).alias("w")).distinct().count()
            if names > MOST_LABELERS:
                raise ValueError(f"{names} labelers, more than {MOST_LABELERS}")
        got = summed.toPandas()
        graded, counts = {}, {}
        for who, rows in got[got.part == "l"].groupby("labeler"):
            m = np.zeros(len(KINDS) * len(OUTCOMES))
            m[rows.k.to_numpy()] = rows.value.to_numpy()
            graded[who] = m.reshape(len(KINDS), len(OUTCOMES))
            labeler = who.rpartition("\2")[0]
            counts[labeler] = counts.get(labeler, 0) + graded[who]
        gradient, hessian = np.zeros(n_f), np.zeros(n_f * n_f)
        g, h = got[got.part == "g"], got[got.part == "h"]
        gradient[g.k.to_numpy()], hessian[h.k.to_numpy()] = g.value.to_numpy(), h.value.to_numpy()
        hessian = hessian.reshape(n_f, n_f) + L2 * np.eye(n_f)
        weights = weights + np.clip(np.linalg.solve(hessian, gradient - L2 * weights), -2, 2)
        own = {who: _rates(m) for who, m in counts.items()}
        theta = {who: _drawn(m, own[who.rpartition("\2")[0]]) for who, m in graded.items()} | {"": _rates(np.zeros((len(KINDS), len(OUTCOMES))))}
        reliability = {who: float(m[:, 0].sum() / max(m.sum(), 1e-9)) for who, m in counts.items()}
        done += 1
        sums = got[got.part == "n"].set_index("k").value
        mean = float(sums.get(0, 0.0)) / max(1.0, float(sums.get(1, 0.0)))
        # the first pass has no confusions, so that its likelihood is not comparable
        settled = not counts or done > 3 and before is not None and abs(mean - before) < SETTLED
        before = mean if done > 1 else None
        if settled:
            break
    if not settled:
        warnings.warn(f"the consensus had not settled after {done} iterations", stacklevel=2)
    n_votes = {who: float(m.sum()) for who, m in counts.items()}
    cast = sum(counts.values(), np.zeros((len(KINDS), len(OUTCOMES))))
    # which kind a vote is of, by what it says: as the truth, GROUP, one, several
    kinds = np.array([cast[0, 0] + cast[:, 1].sum(), cast[1, 0] + cast[:, 2].sum() + cast[:, 3].sum(), cast[2, 0] + cast[:, 4].sum() + cast[:, 5].sum()])
    shares = kinds / max(1e-9, kinds.sum())
    return Consensus(blocks, weights, theta or {}, own, n_votes, reliability, shares, done, settled)


def _rates(counts: np.ndarray) -> np.ndarray:
    """Confusion rates of a labeler with pseudo-counts; impossible outcomes get a rate that is as good as none."""
    rates = counts + PRIOR + 1e-3
    return rates / rates.sum(1, keepdims=True)


def _drawn(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Confusion rates of a labeler's votes of one grade: SHRINK votes like the labeler's others are added."""
    return (counts + SHRINK * own) / (counts.sum(1, keepdims=True) + SHRINK)
