"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import sql
from colloquy.llm.consensus import Consensus, fit_consensus
from colloquy.llm.encoding import encoded
from colloquy.llm.leakage import leaked_items
from colloquy.llm.nearest import clip_turn_partners
from colloquy.llm.sampling import draw_sample
from colloquy.llm.splitting import LIMIT, OVERLAP, split_turns
from colloquy.llm.toxicity import rates, scored
from colloquy.sources.tables import table

#: White space, as a text's characters are counted without it.
WHITE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return clip_turn_partners(
        table(spark, folder, "ext_conversations"), table(spark, folder, "instances_metadata"), table(spark, folder, "conversations")
    )


def _consensus(spark: SparkSession, folder: str) -> Consensus:
    return fit_consensus(table(spark, folder, "golden"), table(spark, folder, "conversations"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).labels(least_voters=3).select("conversation_id", "turn_id", "addressees")


def p2_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn with votes: consensus, number of voters, share of votes that agree, as it is and corrected for chance, posterior."""
    return _consensus(spark, folder).labels()


def p2_labelers(spark: SparkSession, folder: str) -> DataFrame:
    """Reliability of every labeler."""
    return _consensus(spark, folder).labelers()


def _draw(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return draw_sample(table(spark, folder, "conversations"), table(spark, folder, "sample_targets"))


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _draw(spark, folder)[0]


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return _draw(spark, folder)[1]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _draw(spark, folder)[1].where("short").select("plan_id", "category")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_turns(table(spark, folder, "conversations")).select("conversation_id", "turn_id", "cut")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_turns(table(spark, folder, "conversations")).select("conversation_id", "turn_id", "cut", F.inline("pieces"))


def p4_pieces_hold(spark: SparkSession, folder: str) -> DataFrame:
    """Of every cut turn: the characters that its pieces hold beside white space and repeats, and whether length and overlap keep their limits."""
    rows = split_turns(table(spark, folder, "conversations"))
    own = F.transform("pieces", lambda p: F.char_length(F.regexp_replace(F.substring(p["text"], p["shared"] + 1, F.lit(LIMIT)), WHITE, "")))
    fits = F.forall("pieces", lambda p: (F.char_length(p["text"]) <= LIMIT) & p["shared"].between(0, OVERLAP) & (p["p_end"] - p["p_start"] == F.char_length(p["text"])))
    characters = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, n: a + n)
    return rows.select("conversation_id", "turn_id", characters.alias("characters"), fits.alias("fits"), (F.size("pieces") > 1).alias("cut_up"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item with the number of documents that hold it."""
    items = table(spark, folder, "eval_items").select("item_id", "task", "split_name").distinct()
    found = leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    per_item = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"))
    return items.join(per_item, "item_id", "left").select(
        "item_id", "task", "split_name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.col("n_documents").isNotNull().alias("leaked")
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents")).where("offending").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score and its offending spans."""
    found = scored(table(spark, folder, "documents"))
    return found.select("doc_id", "score", "offending", F.to_json("spans").alias("spans"))


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The share of offending documents per source."""
    return rates(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_labelers": p2_labelers,
    "p2_turns": p2_turns,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_sample": p3_sample,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_pieces_hold": p4_pieces_hold,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_sources": p8_sources,
}

SQL: dict[str, str] = {
    "p1_found": sql.P1_FOUND,
    "p3_found": sql.P3_FOUND,
    "p3_report": sql.P3_REPORT,
    "p4_found": sql.P4_FOUND,
    "p4_pieces_hold": sql.P4_PIECES_HOLD,
}
