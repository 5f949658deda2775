"""Agreement of two label sets: aligned records, strata, exact match, Jaccard, kappa, per-class scores, confusion, verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.columns import is_backchannel, jaccard
from colloquy.operators.current import current_conversations, current_turns, speaker_count
from colloquy.operators.labels import one_label_per_turn

STRATA = ("overall", "two_party", "multi_party", "overlap", "non_overlap", "backchannel")


def turn_facts(conversations: DataFrame) -> DataFrame:
    """(conversation_id, turn_id, overlap, backchannel): a row per turn id; of several turns under one id the first by start."""
    turns = current_turns(
        conversations,
        turn_id=lambda t: t["turn_id"],
        t_start=lambda t: t["start"],
        overlap=lambda t: F.coalesce(t["overlap"], F.lit(False)),
        backchannel=lambda t: is_backchannel(t["text"]),
    )
    first = F.struct(F.coalesce("t_start", F.lit(0.0)), "overlap", "backchannel")
    return turns.groupBy("conversation_id", "turn_id").agg(F.min(first).alias("f")).select(
        "conversation_id", "turn_id", F.col("f.overlap").alias("overlap"), F.col("f.backchannel").alias("backchannel")
    )


def records(gold: DataFrame, pred: DataFrame, conversations: DataFrame) -> DataFrame:
    """The turns labelled on both sides: gold and pred sets, n_speakers, overlap, backchannel, exact, jaccard, both_single.

    ``gold`` and ``pred`` are label sets. A conversation that is missing counts as one without speakers, a missing turn as neither
    overlapped nor a backchannel. All joins are equi-joins on the conversation or the turn; AQE picks their kind.
    """
    g = one_label_per_turn(gold).select("conversation_id", "turn_id", F.col("addressees").alias("gold"))
    p = one_label_per_turn(pred).select("conversation_id", "turn_id", F.col("addressees").alias("pred"))
    speakers = current_conversations(conversations, n_speakers=speaker_count(F.col("speakers"), F.col("turns")))
    both = g.join(p, ["conversation_id", "turn_id"]).join(speakers, "conversation_id", "left")
    both = both.join(turn_facts(conversations), ["conversation_id", "turn_id"], "left")
    return both.select("conversation_id", "turn_id", "gold", "pred", *record_columns())


def record_columns() -> list[Column]:
    """What a record tells beside its two label sets ``gold`` and ``pred``, of n_speakers, overlap and backchannel, which may be null."""
    return [
        F.coalesce("n_speakers", F.lit(0)).cast("bigint").alias("n_speakers"),
        F.coalesce("overlap", F.lit(False)).alias("overlap"),
        F.coalesce("backchannel", F.lit(False)).alias("backchannel"),
        (F.col("gold") == F.col("pred")).alias("exact"),
        jaccard(F.col("gold"), F.col("pred")).alias("jaccard"),
        _single().alias("both_single"),
    ]


def tally(rows: DataFrame) -> DataFrame:
    """(two_party, overlap, backchannel, gold, pred, n): how many records are alike in all that an evaluation looks at.

    Everything below is derived from this frame, which is small beside the records and is made by one aggregation with partial
    sums; a frame that is a tally already is returned as it is.
    """
    if "n" in rows.columns and "two_party" in rows.columns:
        return rows
    return rows.groupBy((F.col("n_speakers") <= 2).alias("two_party"), "overlap", "backchannel", "gold", "pred").agg(F.count("*").alias("n"))


def stratified(tallied: DataFrame) -> DataFrame:
    """Each row of a tally once for every stratum it is in: four copies at most, made by one generator in the same pass."""
    names = F.array_compact(
        F.array(
            F.lit("overall"),
            F.when(F.col("two_party"), "two_party").otherwise("multi_party"),
            F.when(F.col("overlap"), "overlap").otherwise("non_overlap"),
            F.when(F.col("backchannel"), "backchannel"),
        )
    )
    return tallied.withColumn("stratum", F.explode(names))


def _single() -> Column:
    return (F.size("gold") == 1) & (F.size("pred") == 1)


def class_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, class, tp, fp, fn, support) over sets, one against the rest. ``by`` is [] or columns of the tally, such as stratum."""
    by = by or []
    exploded = tally(rows).select(*by, "gold", "pred", "n", F.explode(F.array_union("gold", "pred")).alias("class"))
    g, p = F.array_contains("gold", F.col("class")), F.array_contains("pred", F.col("class"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return exploded.groupBy(*by, "class").agg(total(g & p).alias("tp"), total(~g & p).alias("fp"), total(g & ~p).alias("fn"), total(g).alias("support"))


def with_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of counts; 0.0 where a denominator is."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


def per_class(rows: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1) over all records."""
    return with_scores(class_counts(rows))


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, gold_label, pred_label, n): non-empty cells of the confusion matrix of records with one name on either side."""
    by = by or []
    singles = tally(rows).where(_single())
    return singles.groupBy(*by, F.col("gold")[0].alias("gold_label"), F.col("pred")[0].alias("pred_label")).agg(F.sum("n").alias("n"))


def dense_confusion(rows: DataFrame) -> DataFrame:
    """The confusion matrix with a row for every pair of labels seen on either side, empty cells as 0. Labels squared: for reports.

    The cells are read once: they are gathered into a map on the one row that lists the labels, and looked up there.
    """
    cells = confusion(rows).agg(F.collect_list(F.struct("gold_label", "pred_label", "n")).alias("c"))
    names = F.array_union(F.transform("c", lambda x: x["gold_label"]), F.transform("c", lambda x: x["pred_label"]))
    at = F.map_from_entries(F.transform("c", lambda x: F.struct(F.struct(x["gold_label"], x["pred_label"]), x["n"])))
    listed = cells.select(F.array_sort(names).alias("labels"), at.alias("at"))
    grid = listed.select("labels", "at", F.explode("labels").alias("gold_label")).select("at", "gold_label", F.explode("labels").alias("pred_label"))
    return grid.select("gold_label", "pred_label", F.coalesce(F.try_element_at("at", F.struct("gold_label", "pred_label")), F.lit(0)).alias("n"))


def _kappa(n: Column, agree: Column, chance: Column) -> Column:
    """(n * agree - sum of marginal products) / (n * n - sum of marginal products), 1.0 where the denominator is 0."""
    top = (n.cast(_COUNT) * agree.cast(_COUNT) - chance).cast("double")
    bottom = (n.cast(_COUNT) * n.cast(_COUNT) - chance).cast("double")
    return F.when(bottom == 0, F.lit(1.0)).otherwise(top / F.nullif(bottom, F.lit(0.0)))


_COUNT, _PRODUCT = "decimal(19,0)", "decimal(38,0)"


def kappa(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_pairs, n_agree, kappa) from (by, gold_label, pred_label, n).

    The integer form is exact and does not depend on the order of rows; products are DECIMAL(38, 0), which holds some 10^19
    pairs. The cells are read once: each gives its count to the two labels' marginals, which are summed by label and then by group.
    """
    zero, n = F.lit(0).cast("bigint"), F.col("n").cast("bigint")
    agree = F.when(F.col("gold_label") == F.col("pred_label"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("gold_label").alias("label"), n.alias("g"), zero.alias("p"), agree.alias("agree")),
        F.struct(F.col("pred_label").alias("label"), zero.alias("g"), n.alias("p"), zero.alias("agree")),
    )
    marginals = cells.select(*by, F.inline(sides)).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("g", "p", "agree")])
    chance = F.sum(F.col("g").cast(_COUNT) * F.col("p").cast(_COUNT)).cast(_PRODUCT)
    total = marginals.groupBy(*by).agg(F.sum("g").alias("n_pairs"), F.sum("agree").alias("n_agree"), chance.alias("chance"))
    return total.where("n_pairs > 0").select(*by, "n_pairs", "n_agree", _kappa(F.col("n_pairs"), F.col("n_agree"), F.col("chance")).alias("kappa"))


def summary(rows: DataFrame) -> DataFrame:
    """One row per stratum, all six always: n, exact_match, mean_jaccard, single_accuracy, n_single, kappa, macro_f1, micro_f1.

    Everything is null but n (0) and n_single (0) where a stratum is empty; kappa and single_accuracy also where no record has one
    name on either side. The records are read once: their tally is dealt to the strata, every row gives what it adds to the stratum
    (class null) and to each class in it, and two small aggregations, by stratum and class and then by stratum, give all measures.
    """
    zero, n, single = F.lit(0).cast("bigint"), F.col("n"), _single()
    exact = F.col("gold") == F.col("pred")
    none = dict.fromkeys(("tp", "fp", "fn", "g", "p", "n", "exact", "n_single", "agree"), zero) | {"jaccard": F.lit(0.0)}

    def gives(label: Column, **counts: Column) -> Column:
        return F.struct(label.alias("class"), *[F.coalesce(v, zero if k != "jaccard" else F.lit(0.0)).alias(k) for k, v in (none | counts).items()])

    count = lambda c: F.when(c, n).otherwise(zero)
    whole = gives(
        F.lit(None).cast("string"), n=n, exact=count(exact), jaccard=n * jaccard(F.col("gold"), F.col("pred")), n_single=count(single), agree=count(single & exact)
    )

    def of_class(c: Column) -> Column:
        g, p = F.array_contains("gold", c), F.array_contains("pred", c)
        return gives(c, tp=count(g & p), fp=count(~g & p), fn=count(g & ~p), g=count(g & single), p=count(p & single))

    parts = F.concat(F.array(whole), F.transform(F.array_union("gold", "pred"), of_class))
    spread = stratified(tally(rows)).select("stratum", F.inline(parts))
    each = spread.groupBy("stratum", "class").agg(*[F.sum(c).alias(c) for c in none])
    f1 = F.when(F.col("class").isNotNull(), 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)))
    chance = F.coalesce(F.sum(F.col("g").cast(_COUNT) * F.col("p").cast(_COUNT)), F.lit(0)).cast(_PRODUCT)
    sums = each.groupBy("stratum").agg(F.avg(f1).alias("macro"), chance.alias("chance"), *[F.sum(c).alias(c) for c in none])
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    micro = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    names = rows.sparkSession.createDataFrame([(s,) for s in STRATA], "stratum string")
    return names.join(sums, "stratum", "left").select(
        "stratum", F.coalesce("n", zero).alias("n"), ratio("exact", "n").alias("exact_match"), ratio("jaccard", "n").alias("mean_jaccard"),
        ratio("agree", "n_single").alias("single_accuracy"), F.coalesce("n_single", zero).alias("n_single"),
        F.when(F.col("n_single") > 0, _kappa(F.col("n_single"), F.col("agree"), F.col("chance"))).alias("kappa"),
        F.when(F.col("n") > 0, F.coalesce("macro", F.lit(0.0))).alias("macro_f1"), F.when(F.col("n") > 0, F.coalesce(micro, F.lit(0.0))).alias("micro_f1"),
    )


def verdict(summary_rows: DataFrame, least_kappa: float = 0.75, least_exact: float = 0.80) -> DataFrame:
    """One row: kappa and exact match overall, their thresholds, accepted. Without kappa nothing is accepted."""
    overall = summary_rows.where("stratum = 'overall'")
    exact = F.coalesce("exact_match", F.lit(0.0))
    return overall.select(
        "kappa", exact.alias("exact_match"), F.lit(least_kappa).alias("least_kappa"), F.lit(least_exact).alias("least_exact"),
        F.coalesce((F.col("kappa") >= least_kappa) & (exact >= least_exact), F.lit(False)).alias("accepted"),
    )


@dataclass
class Evaluation:
    """The parts of an evaluation as frames, all derived from ``tallied``, which is kept in memory until :meth:`close`."""

    records: DataFrame
    tallied: DataFrame
    summary: DataFrame
    per_class: DataFrame
    confusion: DataFrame
    verdict: DataFrame
    n_conversations: DataFrame

    def close(self) -> None:
        self.tallied.unpersist()

    def __enter__(self) -> Evaluation:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def evaluate(gold: DataFrame, pred: DataFrame, conversations: DataFrame, least_kappa: float = 0.75, least_exact: float = 0.80) -> Evaluation:
    """All of it; records are built once, for their tally. n_conversations counts those of gold, matched or not."""
    return evaluate_records(records(gold, pred, conversations), gold, least_kappa, least_exact)


def evaluate_records(rows: DataFrame, gold: DataFrame, least_kappa: float = 0.75, least_exact: float = 0.80) -> Evaluation:
    """The same for records that are at hand; ``gold`` only tells how many conversations there are."""
    tallied = tally(rows).persist()
    table = summary(tallied)
    counted = gold.agg(F.count_distinct("conversation_id").alias("n_conversations"))
    return Evaluation(rows, tallied, table, per_class(tallied), confusion(tallied), verdict(table, least_kappa, least_exact), counted)
