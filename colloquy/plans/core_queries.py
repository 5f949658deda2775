"""Queries over the core operators, with the SQL they are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import columns as C
from colloquy.operators import align, heuristic, ingest, labeling, labels, merge, metrics, parsing, speed, windows
from colloquy.operators.current import current_conversations, current_turns
from colloquy.operators.intervals import speech_periods_and_gaps
from colloquy.operators.overlap import overlap_flags
from colloquy.session import shared_folder
from colloquy.sources import jsonl
from colloquy.sources.tables import table
from colloquy.streaming.incremental import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Window sizes of the queries; conversations have about 13 turns, so that smaller ones than the defaults are needed to tile them.
STEP, CONTEXT = 5, 3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- shared pieces of SQL ----

CURRENT = """current AS (
  SELECT conversation_id, speakers, meta, turns FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY try_cast(meta['revision'] AS DOUBLE) DESC NULLS LAST) = 1
)"""
TURNS = f"""{CURRENT}, t AS (
  SELECT conversation_id, x.turn_id AS turn_id, x.speaker AS speaker, x."start" AS t_start, x."end" AS t_end, x.text AS text, x.overlap AS overlap
  FROM (SELECT DISTINCT conversation_id, unnest(turns) AS x FROM current)
)"""
ROSTERS = """rosters AS (
  SELECT conversation_id, CASE WHEN coalesce(len(speakers), 0) > 0 THEN speakers
    ELSE coalesce((SELECT list(s ORDER BY p) FROM (SELECT s, min(p) AS p FROM (
      SELECT unnest([y.speaker FOR y IN turns]) AS s, generate_subscripts(turns, 1) AS p) WHERE s IS NOT NULL GROUP BY s)), []) END AS speakers
  FROM current
)"""


def _labels_sql(name: str, source: str) -> str:
    return f"""{name}_rows AS (
  SELECT DISTINCT conversation_id, turn_id, CASE WHEN len(a) > 1 AND list_contains(a, 'UNKNOWN') THEN ['UNKNOWN'] ELSE a END AS addressees, confidence, rationale, labeler
  FROM (SELECT conversation_id, l.turn_id AS turn_id, l.confidence AS confidence, l.rationale AS rationale, l.labeler AS labeler,
      list_sort(list_distinct([trim(x) FOR x IN coalesce(l.addressees, []) IF x IS NOT NULL AND trim(x) <> ''])) AS a
    FROM (SELECT DISTINCT conversation_id, unnest(labels) AS l FROM {source}))
), {name} AS (
  SELECT * FROM {name}_rows QUALIFY row_number() OVER (PARTITION BY conversation_id, turn_id ORDER BY
    CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END DESC NULLS LAST, array_to_string(addressees, '+'),
    lower(trim(labeler)) NULLS LAST, rationale NULLS LAST, labeler NULLS LAST) = 1
)"""


_BACKCHANNEL = f"""coalesce(len(regexp_extract_all(lower(text), '[a-z'']+')) BETWEEN 1 AND 3 AND list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), {list(C.BACKCHANNEL_WORDS)!r}), false)"""
_JACCARD = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / CAST(len(list_distinct(list_concat({0}, {1}))) AS DOUBLE) END"

RECORDS = f"""{TURNS}, {_labels_sql('gold', 'golden')}, {_labels_sql('pred', 'candidate')}, fact AS (
  SELECT * FROM (SELECT facts.*, row_number() OVER (PARTITION BY f.conversation_id, f.turn_id ORDER BY coalesce(f.t_start, 0), facts.overlap, facts.backchannel) AS r
    FROM (SELECT *, coalesce(overlap, false) AS o FROM t) f, LATERAL (SELECT f.conversation_id, f.turn_id, f.o AS overlap,
      coalesce(len(regexp_extract_all(lower(f.text), '[a-z'']+')) BETWEEN 1 AND 3
        AND list_has_any(regexp_extract_all(lower(f.text), '[a-z'']+'), {list(C.BACKCHANNEL_WORDS)!r}), false) AS backchannel) facts) WHERE r = 1
), sizes AS (
  SELECT conversation_id, CASE WHEN coalesce(len(speakers), 0) > 0 THEN len(speakers)
    ELSE coalesce(len(list_distinct([y.speaker FOR y IN turns IF y.speaker IS NOT NULL])), 0) END AS n_speakers FROM current
), rec AS (
  SELECT gold.conversation_id, gold.turn_id, gold.addressees AS gold, pred.addressees AS pred, coalesce(n_speakers, 0) AS n_speakers,
    coalesce(fact.overlap, false) AS overlap, coalesce(fact.backchannel, false) AS backchannel, gold.addressees = pred.addressees AS exact,
    CASE WHEN len(gold.addressees) + len(pred.addressees) = 0 THEN 1.0
      ELSE len(list_intersect(gold.addressees, pred.addressees)) / CAST(len(list_distinct(list_concat(gold.addressees, pred.addressees))) AS DOUBLE) END AS jaccard,
    len(gold.addressees) = 1 AND len(pred.addressees) = 1 AS both_single
  FROM gold JOIN pred USING (conversation_id, turn_id) LEFT JOIN sizes USING (conversation_id) LEFT JOIN fact USING (conversation_id, turn_id)
)"""
STRATA_SQL = """st AS (
  SELECT *, unnest(['overall', CASE WHEN n_speakers <= 2 THEN 'two_party' ELSE 'multi_party' END,
    CASE WHEN overlap THEN 'overlap' ELSE 'non_overlap' END, CASE WHEN backchannel THEN 'backchannel' END]) AS stratum FROM rec
), strat AS (SELECT * FROM st WHERE stratum IS NOT NULL)"""
CLASSES_SQL = """cls AS (
  SELECT stratum, class, count(*) FILTER (WHERE list_contains(gold, class) AND list_contains(pred, class)) AS tp,
    count(*) FILTER (WHERE NOT list_contains(gold, class) AND list_contains(pred, class)) AS fp,
    count(*) FILTER (WHERE list_contains(gold, class) AND NOT list_contains(pred, class)) AS fn
  FROM (SELECT stratum, gold, pred, unnest(list_distinct(list_concat(gold, pred))) AS class FROM strat) GROUP BY 1, 2
)"""
KAPPA_SQL = """cells AS (
  SELECT stratum, gold[1] AS g, pred[1] AS p, count(*) AS n FROM strat WHERE both_single GROUP BY 1, 2, 3
), tot AS (
  SELECT stratum, sum(n) AS n, sum(CASE WHEN g = p THEN n ELSE 0 END) AS a FROM cells GROUP BY 1
), chance AS (
  SELECT x.stratum, sum(x.n * y.n) AS c FROM (SELECT stratum, g AS l, sum(n) AS n FROM cells GROUP BY 1, 2) x
  JOIN (SELECT stratum, p AS l, sum(n) AS n FROM cells GROUP BY 1, 2) y USING (stratum, l) GROUP BY 1
), kap AS (
  SELECT stratum, CAST(n AS BIGINT) AS n_pairs, CAST(a AS BIGINT) AS n_agree, CASE WHEN n * n - coalesce(c, 0) = 0 THEN 1.0
    ELSE CAST(n * a - coalesce(c, 0) AS DOUBLE) / CAST(n * n - coalesce(c, 0) AS DOUBLE) END AS kappa FROM tot LEFT JOIN chance USING (stratum)
)"""
SUMMARY_OF_REC = f"""{STRATA_SQL}, {CLASSES_SQL}, {KAPPA_SQL}, base AS (
  SELECT stratum, count(*) AS n, avg(CAST(exact AS INT)) AS exact_match, avg(jaccard) AS mean_jaccard,
    avg(CASE WHEN both_single THEN CAST(exact AS INT) END) AS single_accuracy, count(*) FILTER (WHERE both_single) AS n_single FROM strat GROUP BY 1
), f AS (
  SELECT stratum, avg(2.0 * tp / (2 * tp + fp + fn)) AS macro_f1, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1 FROM cls GROUP BY 1
), summ AS (
  SELECT s.stratum, coalesce(n, 0) AS n, exact_match, mean_jaccard, single_accuracy, coalesce(n_single, 0) AS n_single, kappa,
    CASE WHEN n > 0 THEN coalesce(macro_f1, 0) END AS macro_f1, CASE WHEN n > 0 THEN coalesce(micro_f1, 0) END AS micro_f1
  FROM (SELECT unnest({list(metrics.STRATA)!r}) AS stratum) s LEFT JOIN base USING (stratum) LEFT JOIN f USING (stratum) LEFT JOIN kap USING (stratum)
)"""
SUMMARY_SQL = f"{RECORDS}, {SUMMARY_OF_REC}"


def _r6(name: str) -> str:
    return f"round({name}, 6) AS {name}"


# ---- inputs ----


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return current_turns(_t(spark, folder, "conversations"))


def _rosters(spark: SparkSession, folder: str) -> DataFrame:
    return current_conversations(_t(spark, folder, "conversations"), speakers=C.roster(F.col("speakers"), F.col("turns")))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.records(_t(spark, folder, "golden"), _t(spark, folder, "candidate"), _t(spark, folder, "conversations"))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """The first turn of each turn id: what the windows of the queries are made of."""
    order = Window.partitionBy("conversation_id", "turn_id").orderBy(F.asc_nulls_first("t_start"), F.asc_nulls_first("t_end"), F.asc_nulls_first("speaker"), F.asc_nulls_first("text"), F.asc_nulls_first("overlap"))
    return _turns(spark, folder).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


NUMBERED = f"""{TURNS}, first AS (
  SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conversation_id, turn_id ORDER BY t_start NULLS FIRST, t_end NULLS FIRST, speaker NULLS FIRST, text NULLS FIRST, overlap NULLS FIRST) = 1
), num AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY coalesce(t_start, 0), turn_id) - 1 AS position,
    count(*) OVER (PARTITION BY conversation_id) AS cnt FROM first
), win AS (
  SELECT *, unnest(range(position // {STEP}, least((cnt - 1) // {STEP}, (position + {CONTEXT}) // {STEP}) + 1)) AS window_id FROM num
), tiled AS (
  SELECT *, CASE WHEN window_id = position // {STEP} THEN 'TARGET' ELSE 'CTX' END AS role FROM win
)"""
HEURISTIC_SQL = f"""{NUMBERED}, {ROSTERS}, prev AS (
  SELECT a.conversation_id, a.turn_id, a.window_id, a.speaker, a.text, a.role, (SELECT b.speaker FROM tiled b WHERE b.conversation_id = a.conversation_id AND b.window_id = a.window_id
    AND b.position < a.position AND b.speaker <> a.speaker ORDER BY b.position DESC LIMIT 1) AS previous FROM tiled a
)"""


# ---- queries ----


@query(f"WITH {SUMMARY_SQL} SELECT stratum, n, {', '.join(map(_r6, ('exact_match', 'mean_jaccard', 'single_accuracy', 'kappa', 'macro_f1', 'micro_f1')))}, n_single FROM summ")
def flagship_agreement(spark: SparkSession, folder: str) -> DataFrame:
    s = metrics.summary(_records(spark, folder))
    rounded = {c: F.round(c, 6) for c in ("exact_match", "mean_jaccard", "single_accuracy", "kappa", "macro_f1", "micro_f1")}
    return s.withColumns(rounded)


@query(f"""WITH {RECORDS} SELECT conversation_id, turn_id, array_to_string(gold, '+') AS gold, array_to_string(pred, '+') AS pred, n_speakers, overlap, backchannel, exact, round(jaccard, 6) AS jaccard, both_single FROM rec""")
def records_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).withColumns({"gold": F.array_join("gold", "+"), "pred": F.array_join("pred", "+"), "jaccard": F.round("jaccard", 6)})


@query(f"WITH {RECORDS} SELECT count(*) AS n, round(avg(CAST(exact AS INT)), 6) AS exact_match, round(avg(jaccard), 6) AS mean_jaccard FROM rec")
def exact_match_and_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).agg(F.count("*").alias("n"), F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_match"), F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))


@query(f"WITH {RECORDS}, {STRATA_SQL}, {KAPPA_SQL} SELECT stratum, n_pairs, n_agree, round(kappa, 9) AS kappa FROM kap")
def cohen_kappa_by_stratum(spark: SparkSession, folder: str) -> DataFrame:
    strata = metrics.stratified(metrics.tally(_records(spark, folder)))
    return metrics.kappa(metrics.confusion(strata, ["stratum"]), ["stratum"]).withColumn("kappa", F.round("kappa", 9))


@query(f"""WITH {RECORDS}, strat AS (SELECT 'overall' AS stratum, * FROM rec), {CLASSES_SQL} SELECT class, tp, fp, fn, tp + fn AS support,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cls""")
def per_class_prf(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.per_class(_records(spark, folder)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {SUMMARY_SQL} SELECT stratum, {_r6('macro_f1')}, {_r6('micro_f1')} FROM summ")
def macro_micro_f1(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.summary(_records(spark, folder)).select("stratum", F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


@query(f"""WITH {RECORDS}, cell AS (SELECT gold[1] AS g, pred[1] AS p, count(*) AS n FROM rec WHERE both_single GROUP BY 1, 2), names AS (SELECT g AS l FROM cell UNION SELECT p FROM cell)
SELECT a.l AS gold_label, b.l AS pred_label, coalesce(n, 0) AS n FROM names a CROSS JOIN names b LEFT JOIN cell ON cell.g = a.l AND cell.p = b.l""")
def dense_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.dense_confusion(_records(spark, folder))


@query(f"""WITH {SUMMARY_SQL} SELECT (SELECT count(DISTINCT conversation_id) FROM golden) AS n_conversations, (SELECT count(*) FROM rec) AS n_scored_turns,
  (SELECT count(DISTINCT c) FROM (SELECT unnest(list_concat(gold, pred)) AS c FROM rec)) AS n_classes, (SELECT count(*) FROM (SELECT DISTINCT gold, pred FROM rec WHERE both_single)) AS n_cells,
  round(kappa, 6) AS kappa, coalesce(kappa >= 0.75 AND exact_match >= 0.8, false) AS accepted FROM summ WHERE stratum = 'overall'""")
def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`metrics.evaluate` gives, in one row."""
    e = metrics.evaluate(_t(spark, folder, "golden"), _t(spark, folder, "candidate"), _t(spark, folder, "conversations"))
    one = e.n_conversations.crossJoin(e.summary.where("stratum = 'overall'").select(F.col("n").alias("n_scored_turns"), F.round("kappa", 6).alias("kappa")))  # one row each
    return one.crossJoin(e.per_class.agg(F.count("*").alias("n_classes"))).crossJoin(e.confusion.agg(F.count("*").alias("n_cells"))).crossJoin(e.verdict.select("accepted"))


@query(f"WITH {RECORDS} SELECT gold[1] AS gold_label, pred[1] AS pred_label, count(*) AS n FROM rec WHERE both_single GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_records(spark, folder))


@query(f"WITH {SUMMARY_SQL} SELECT round(kappa, 6) AS kappa, round(coalesce(exact_match, 0), 6) AS exact_match, 0.75::DOUBLE AS least_kappa, 0.8::DOUBLE AS least_exact, coalesce(kappa >= 0.75 AND coalesce(exact_match, 0) >= 0.8, false) AS accepted FROM summ WHERE stratum = 'overall'")
def acceptance_verdict(spark: SparkSession, folder: str) -> DataFrame:
    v = metrics.verdict(metrics.summary(_records(spark, folder)))
    return v.withColumns({"kappa": F.round("kappa", 6), "exact_match": F.round("exact_match", 6)})


@query(f"WITH {_labels_sql('gold', 'golden')} SELECT conversation_id, turn_id, array_to_string(addressees, '+') AS addressees, confidence, rationale, labeler FROM gold_rows")
def label_normalization(spark: SparkSession, folder: str) -> DataFrame:
    return labels.label_rows(_t(spark, folder, "golden")).withColumn("addressees", F.array_join("addressees", "+"))


@query(f"WITH {CURRENT}, {ROSTERS} SELECT conversation_id, array_to_string(speakers, '|') AS speakers FROM rosters")
def roster_derivation(spark: SparkSession, folder: str) -> DataFrame:
    return _rosters(spark, folder).withColumn("speakers", F.array_join("speakers", "|"))


@query(f"WITH {TURNS}, {ROSTERS} SELECT DISTINCT conversation_id, turn_id, speaker, array_to_string(list_concat([s FOR s IN speakers IF s IS DISTINCT FROM speaker], ['GROUP', 'UNKNOWN']), '|') AS allowed FROM t JOIN rosters USING (conversation_id)")
def allowed_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = _turns(spark, folder).join(_rosters(spark, folder), "conversation_id")
    allowed = F.array_join(C.allowed_addressees(F.col("speakers"), F.col("speaker")), "|")
    return rows.select("conversation_id", "turn_id", "speaker", allowed.alias("allowed")).distinct()


@query(f"""WITH {TURNS} SELECT b, count(*) AS n FROM (SELECT coalesce(len(regexp_extract_all(lower(text), '[a-z'']+')) BETWEEN 1 AND 3
  AND list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), {list(C.BACKCHANNEL_WORDS)!r}), false) AS b FROM t) GROUP BY b""")
def backchannel_flag(spark: SparkSession, folder: str) -> DataFrame:
    turns = current_turns(_t(spark, folder, "conversations"), b=lambda t: C.is_backchannel(t["text"]), turn_id=lambda t: t["turn_id"])
    return turns.groupBy("b").agg(F.count("*").alias("n"))


@query(f"""WITH {TURNS} SELECT a.conversation_id, a.turn_id, a.speaker, a.t_start, bool_or(o.turn_id IS NOT NULL) AS overlapped
FROM (SELECT DISTINCT conversation_id, turn_id, speaker, t_start, t_end FROM t) a LEFT JOIN (SELECT DISTINCT conversation_id, coalesce(turn_id, 0) AS turn_id, speaker, t_start, t_end FROM t) o
ON o.conversation_id = a.conversation_id AND o.speaker <> a.speaker AND o.t_start < a.t_end AND o.t_end > a.t_start GROUP BY a.conversation_id, a.turn_id, a.speaker, a.t_start, a.t_end""")
def overlap_turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = _turns(spark, folder).select("conversation_id", "turn_id", "speaker", "t_start", "t_end").distinct()
    return overlap_flags(rows).select("conversation_id", "turn_id", "speaker", "t_start", "overlapped")


@query(f"WITH {NUMBERED} SELECT conversation_id, window_id, position, role, turn_id FROM tiled")
def window_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return windows.tiles(_numbered(spark, folder), STEP, CONTEXT).select("conversation_id", "window_id", "position", "role", "turn_id")


@query(f"WITH {NUMBERED} SELECT conversation_id, window_id, count(*) FILTER (WHERE role = 'CTX') AS n_context, count(*) FILTER (WHERE role = 'TARGET') AS n_target FROM tiled GROUP BY 1, 2")
def window_context(spark: SparkSession, folder: str) -> DataFrame:
    tiled = windows.tiles(_numbered(spark, folder), STEP, CONTEXT)
    return tiled.groupBy("conversation_id", "window_id").agg(F.count_if(F.col("role") == "CTX").alias("n_context"), F.count_if(F.col("role") == "TARGET").alias("n_target"))


@query(f"WITH {NUMBERED} SELECT conversation_id, window_id, coalesce(min(t_start), 0.0) AS span_start, coalesce(max(t_end), 0.0) AS span_end FROM tiled WHERE role = 'TARGET' GROUP BY 1, 2")
def window_time_span(spark: SparkSession, folder: str) -> DataFrame:
    return windows.time_spans(windows.tiles(_numbered(spark, folder), STEP, CONTEXT))


_TWO = "CAST(round(CAST({0} AS DECIMAL(18,3)), 2) AS DECIMAL(18,2))"


@query(f"""WITH {NUMBERED}, {ROSTERS} SELECT conversation_id, window_id, 'Speakers in this conversation: ' || array_to_string(any_value(speakers), ', ') || chr(10) || chr(10) || '{windows.LEGEND}' || chr(10) || chr(10) ||
  string_agg(CASE WHEN role = 'CTX' THEN '[CTX]' ELSE '[>> ]' END || ' (turn ' || turn_id || ') [' || CAST({_TWO.format('coalesce(t_start, 0)')} AS VARCHAR) || '-' || CAST({_TWO.format('coalesce(t_end, 0)')} AS VARCHAR) || '] ' || coalesce(speaker, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY position) AS text
FROM tiled JOIN rosters USING (conversation_id) GROUP BY conversation_id, window_id""")
def render_window(spark: SparkSession, folder: str) -> DataFrame:
    return windows.render(windows.tiles(_numbered(spark, folder), STEP, CONTEXT), _rosters(spark, folder))


@query(f"WITH {HEURISTIC_SQL} SELECT conversation_id, window_id, turn_id, previous FROM prev")
def prev_speaker(spark: SparkSession, folder: str) -> DataFrame:
    return windows.previous_speakers(windows.tiles(_numbered(spark, folder), STEP, CONTEXT)).select("conversation_id", "window_id", "turn_id", "previous")


@query(f"""WITH {HEURISTIC_SQL} SELECT conversation_id, turn_id, CASE WHEN len(o) = 0 THEN 'UNKNOWN' WHEN len(v) > 0 THEN v[1] WHEN len(o) = 1 THEN o[1] WHEN previous IS NOT NULL THEN previous ELSE 'GROUP' END AS addressees
FROM (SELECT *, [x FOR x IN o IF coalesce(regexp_matches(text, '(?i)(^|[^\\pL\\pN_])' || x || '($|[^\\pL\\pN_])'), false)] AS v FROM (
  SELECT prev.*, [s FOR s IN coalesce(speakers, []) IF s <> speaker] AS o FROM prev LEFT JOIN rosters USING (conversation_id) WHERE role = 'TARGET'))""")
def heuristic_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = heuristic.heuristic_labels(_numbered(spark, folder), _rosters(spark, folder), STEP, CONTEXT)
    return rows.select("conversation_id", "turn_id", F.array_join("addressees", "+").alias("addressees"))


_DRAW = "CAST('0x' || substr(md5(concat_ws('|', conversation_id, turn_id, '7|{0}')), 1, 8) AS BIGINT)"


@query(f"""WITH {HEURISTIC_SQL}, guess AS (SELECT *, CASE WHEN len(o) = 0 THEN 'UNKNOWN' WHEN len(v) > 0 THEN v[1] WHEN len(o) = 1 THEN o[1] WHEN previous IS NOT NULL THEN previous ELSE 'GROUP' END AS gold
FROM (SELECT *, [x FOR x IN o IF coalesce(regexp_matches(text, '(?i)(^|[^\\pL\\pN_])' || x || '($|[^\\pL\\pN_])'), false)] AS v FROM (
  SELECT prev.*, [s FOR s IN coalesce(speakers, []) IF s <> speaker] AS o FROM prev LEFT JOIN rosters USING (conversation_id) WHERE role = 'TARGET'))),
opts AS (SELECT *, list_concat([x FOR x IN o IF x <> gold], ['GROUP']) AS opt, {_DRAW.format(1)} AS d1, {_DRAW.format(2)} AS d2 FROM guess)
SELECT conversation_id, turn_id, gold, CASE WHEN d1 % 1000000 < 350000 AND len(o) > 0 THEN opt[d2 % len(opt) + 1] ELSE gold END AS pred FROM opts""")
def hash_noise_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The rule-based labels, and the same with a third of them changed: what the demo compares."""
    turns, rosters = _numbered(spark, folder), _rosters(spark, folder)
    gold = heuristic.heuristic_labels(turns, rosters, STEP, CONTEXT).select("conversation_id", "turn_id", F.array_join("addressees", "+").alias("gold"))
    pred = heuristic.heuristic_labels(turns, rosters, STEP, CONTEXT, noise=0.35, seed=7).select("conversation_id", "turn_id", F.array_join("addressees", "+").alias("pred"))
    return gold.join(pred, ["conversation_id", "turn_id"])


def _responses(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(responses, targets): the candidate's labels of every window written as a model would, in one of five forms by the window's
    number: bare, fenced, after thinking, after prose, or cut off."""
    tiled = windows.tiles(_numbered(spark, folder), STEP, CONTEXT).where("role = 'TARGET'")
    targets = tiled.join(_rosters(spark, folder), "conversation_id").select("conversation_id", "window_id", "turn_id", "speaker", "speakers")
    items = labels.one_label_per_turn(_t(spark, folder, "candidate")).join(targets.select("conversation_id", "window_id", "turn_id"), ["conversation_id", "turn_id"])
    payload = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn_id", "addressees", "confidence", "rationale"))).alias("labels")))
    raw = items.groupBy("conversation_id", "window_id").agg(payload.alias("j"))
    form = F.pmod("window_id", F.lit(5))
    text = (
        F.when(form == 0, F.col("j")).when(form == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(form == 2, F.concat(F.lit("<think>{\"x\": [1]}</think>"), "j"))
        .when(form == 3, F.concat(F.lit("Here you are:\n"), "j", F.lit("\nThat is all."))).otherwise(F.expr("substring(j, 1, length(j) - 2)"))
    )
    return raw.select("conversation_id", "window_id", text.alias("raw")), targets


_PARSED = f"""{NUMBERED}, {ROSTERS}, {_labels_sql('pred', 'candidate')}, targets AS (
  SELECT conversation_id, window_id, turn_id, speaker, speakers FROM tiled JOIN rosters USING (conversation_id) WHERE role = 'TARGET'
), found AS (
  SELECT t.*, p.addressees AS a, p.confidence AS c, p.rationale AS r, p.turn_id IS NOT NULL AS hit FROM targets t LEFT JOIN pred p USING (conversation_id, turn_id)
), ans AS (SELECT conversation_id, window_id, bool_or(hit) AS answered FROM found GROUP BY 1, 2
), lab AS (
  SELECT conversation_id, window_id, turn_id, NOT answered AS silent, answered AND window_id % 5 = 4 AS broken, hit,
    [x FOR x IN a IF list_contains(list_concat([s FOR s IN speakers IF s IS DISTINCT FROM speaker], ['GROUP', 'UNKNOWN']), x)] AS k, c, r
  FROM found JOIN ans USING (conversation_id, window_id)
), parsed AS (
  SELECT conversation_id, window_id, turn_id, CASE WHEN silent OR broken OR NOT hit OR len(k) = 0 OR (len(k) > 1 AND list_contains(k, 'UNKNOWN')) THEN 'UNKNOWN' ELSE array_to_string(k, '+') END AS addressees,
    CASE WHEN silent OR broken OR NOT hit THEN 0.0 ELSE c END AS confidence,
    CASE WHEN silent THEN 'labeler failed: NoResponse' WHEN broken THEN 'labeler failed: ValueError' WHEN NOT hit THEN 'missing from model output' ELSE r END AS rationale,
    CASE WHEN silent OR broken THEN 'model(failed)' ELSE 'model' END AS labeler FROM lab
)"""


@query(f"WITH {_PARSED} SELECT conversation_id, turn_id, addressees, confidence, rationale, labeler FROM parsed")
def response_parse(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.labels_from_responses(*_responses(spark, folder), "model").withColumn("addressees", F.array_join("addressees", "+"))


@query(f"WITH {_PARSED} SELECT labeler, coalesce(CASE WHEN rationale LIKE 'labeler failed%' OR rationale = 'missing from model output' THEN rationale END, '') AS reason, count(*) AS n FROM parsed GROUP BY 1, 2")
def failed_and_missing_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = parsing.labels_from_responses(*_responses(spark, folder), "model")
    reason = F.when(F.col("rationale").startswith("labeler failed") | (F.col("rationale") == "missing from model output"), F.col("rationale"))
    return rows.groupBy("labeler", F.coalesce(reason, F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {NUMBERED}, have AS (SELECT DISTINCT conversation_id, l.turn_id AS turn_id FROM (SELECT conversation_id, unnest(labels) AS l FROM candidate)),
complete AS (SELECT conversation_id, window_id FROM tiled LEFT JOIN (SELECT *, true AS h FROM have) USING (conversation_id, turn_id) WHERE role = 'TARGET' GROUP BY 1, 2 HAVING bool_and(coalesce(h, false)))
SELECT DISTINCT conversation_id, window_id FROM tiled WHERE (conversation_id, window_id) NOT IN (SELECT conversation_id, window_id FROM complete)""")
def resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    tiled = windows.tiles(_numbered(spark, folder), STEP, CONTEXT)
    return labeling.remaining_windows(tiled, labels.label_rows(_t(spark, folder, "candidate"))).select("conversation_id", "window_id").distinct()


@query(f"WITH {NUMBERED}, {_labels_sql('pred', 'candidate')} SELECT first.conversation_id, first.turn_id, speaker, text, array_to_string(addressees, '+') AS addressees, confidence AS addressee_confidence, rationale AS addressee_rationale FROM first LEFT JOIN pred USING (conversation_id, turn_id)")
def merge_left_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = merge.merged_turns(_numbered(spark, folder), labels.one_label_per_turn(_t(spark, folder, "candidate")))
    return rows.select("conversation_id", "turn_id", "speaker", "text", F.array_join("addressees", "+").alias("addressees"), "addressee_confidence", "addressee_rationale")


@query(f"""WITH {NUMBERED}, {_labels_sql('pred', 'candidate')} SELECT conversation_id, string_agg('[' || lpad(CAST({_TWO.format('coalesce(t_start, 0)')} AS VARCHAR), CAST(greatest(7, length(CAST({_TWO.format('coalesce(t_start, 0)')} AS VARCHAR))) AS INTEGER), ' ') || '-' ||
  lpad(CAST({_TWO.format('coalesce(t_end, 0)')} AS VARCHAR), CAST(greatest(7, length(CAST({_TWO.format('coalesce(t_end, 0)')} AS VARCHAR))) AS INTEGER), ' ') || '] ' || lpad(coalesce(speaker, ''), CAST(greatest(3, length(coalesce(speaker, ''))) AS INTEGER), ' ') || ' -> ' ||
  rpad(coalesce(array_to_string(addressees, '+'), '?'), CAST(greatest(10, length(coalesce(array_to_string(addressees, '+'), '?'))) AS INTEGER), ' ') || ': ' || coalesce(text, ''), chr(10) ORDER BY coalesce(t_start, 0), turn_id) AS text
FROM first LEFT JOIN pred USING (conversation_id, turn_id) GROUP BY conversation_id""")
def merge_text(spark: SparkSession, folder: str) -> DataFrame:
    return merge.transcripts(_numbered(spark, folder), labels.one_label_per_turn(_t(spark, folder, "candidate")))


@query(f"WITH {NUMBERED}, {_labels_sql('pred', 'candidate')} SELECT count(*) AS n_turns, count(addressees) AS n_labelled FROM first LEFT JOIN pred USING (conversation_id, turn_id)")
def merge_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return merge.coverage(_numbered(spark, folder), labels.one_label_per_turn(_t(spark, folder, "candidate")))


_CLIPS = """md AS (
  SELECT conversation_id, max(clip_t0_sec) AS t0, max(nullif(ami_meeting, '')) AS meeting FROM instances_metadata GROUP BY 1
), clips AS (
  SELECT DISTINCT e.conversation_id AS clip_id, coalesce(md.meeting, nullif(e.meta['meeting'], ''), regexp_replace(e.conversation_id, '^(.*)_t.*$', '\\1')) AS meeting,
    coalesce(md.t0, try_cast(e.meta['t0'] AS DOUBLE), try_cast(regexp_extract(e.conversation_id, '^.*_t([^-]*)', 1) AS DOUBLE), 0) AS offset_s
  FROM ext_conversations e LEFT JOIN md ON md.conversation_id = e.conversation_id
)"""
_ALIGNED = f"""{TURNS}, {_CLIPS}, mine AS (SELECT DISTINCT conversation_id AS meeting FROM conversations), x AS (
  SELECT clip_id, meeting, turn, turn.turn_id AS clip_turn_id, turn.speaker AS speaker, turn.text AS text, CAST(round(1000 * turn."start") AS BIGINT) + CAST(round(1000 * offset_s) AS BIGINT) AS ms
  FROM (SELECT DISTINCT conversation_id AS clip_id, unnest(turns) AS turn FROM ext_conversations) JOIN clips USING (clip_id) WHERE meeting IN (SELECT meeting FROM mine)
), al AS (
  SELECT x.clip_id, x.clip_turn_id, x.meeting AS conversation_id, t.turn_id, t.speaker, t.o AS overlap, t.b AS backchannel FROM x JOIN (
    SELECT *, CAST(round(1000 * t_start) AS BIGINT) AS at, coalesce(overlap, false) AS o, {_BACKCHANNEL} AS b FROM t) t
  ON t.conversation_id = x.meeting AND t.speaker = x.speaker AND t.text = x.text AND abs(t.at - x.ms) <= 750
  QUALIFY row_number() OVER (PARTITION BY x.clip_id, x.meeting, x.turn ORDER BY abs(t.at - x.ms), t.at, t.turn_id, t.speaker, t.o, t.b) = 1
)"""


_EXTERNAL = f"""{_ALIGNED}, {_labels_sql('ext', 'ext_labels')}, {_labels_sql('pred', 'candidate')}, both_ AS (
  SELECT al.*, e.addressees AS gold, p.addressees AS pred FROM al LEFT JOIN ext e ON e.conversation_id = al.clip_id AND e.turn_id = al.clip_turn_id
  LEFT JOIN pred p ON p.conversation_id = al.conversation_id AND p.turn_id = al.turn_id
), rec AS (
  SELECT gold, pred, (SELECT count(DISTINCT speaker) FROM both_ WHERE gold IS NOT NULL AND pred IS NOT NULL) AS n_speakers, overlap, backchannel, gold = pred AS exact,
    {_JACCARD.format('gold', 'pred')} AS jaccard, len(gold) = 1 AND len(pred) = 1 AS both_single
  FROM both_ WHERE gold IS NOT NULL AND pred IS NOT NULL
), {SUMMARY_OF_REC}"""


def _alignment(spark: SparkSession, folder: str) -> align.Alignment:
    return align.align_clips(_t(spark, folder, "ext_conversations"), _t(spark, folder, "instances_metadata"), _t(spark, folder, "conversations"))


@query(f"WITH {_CLIPS} SELECT clip_id, meeting, offset_s FROM clips")
def clip_offset_parse(spark: SparkSession, folder: str) -> DataFrame:
    return align.clip_facts(_t(spark, folder, "ext_conversations"), _t(spark, folder, "instances_metadata"))


@query(f"WITH {_ALIGNED} SELECT clip_id, clip_turn_id, conversation_id, turn_id FROM al")
def nearest_align(spark: SparkSession, folder: str) -> DataFrame:
    return _alignment(spark, folder).aligned.select("clip_id", "clip_turn_id", "conversation_id", "turn_id")


@query(f"""WITH {_ALIGNED} SELECT (SELECT count(*) FROM clips WHERE meeting IN (SELECT meeting FROM mine)) AS clips_matched, (SELECT count(*) FROM clips WHERE meeting NOT IN (SELECT meeting FROM mine)) AS clips_skipped,
  (SELECT count(DISTINCT meeting) FROM clips WHERE meeting NOT IN (SELECT meeting FROM mine)) AS meetings_skipped, (SELECT count(*) FROM x) AS turns_total, (SELECT count(*) FROM al) AS turns_aligned""")
def align_stats(spark: SparkSession, folder: str) -> DataFrame:
    return align.align_stats(_alignment(spark, folder))


@query(f"""WITH {_ALIGNED}, {_labels_sql('ext', 'ext_labels')}, {_labels_sql('pred', 'candidate')}, both_ AS (
  SELECT e.addressees AS g, p.addressees AS p FROM al LEFT JOIN ext e ON e.conversation_id = al.clip_id AND e.turn_id = al.clip_turn_id LEFT JOIN pred p ON p.conversation_id = al.conversation_id AND p.turn_id = al.turn_id)
SELECT count(*) AS turns_aligned, count(*) FILTER (WHERE g IS NULL OR p IS NULL) AS turns_unlabelled, round(avg(CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN CAST(g = p AS INT) END), 6) AS exact_match FROM both_""")
def external_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """The clips' labels against the candidate's on aligned turns."""
    theirs = labels.one_label_per_turn(_t(spark, folder, "ext_labels")).select(F.col("conversation_id").alias("clip_id"), F.col("turn_id").alias("clip_turn_id"), F.col("addressees").alias("g"))
    ours = labels.one_label_per_turn(_t(spark, folder, "candidate")).select("conversation_id", "turn_id", F.col("addressees").alias("p"))
    rows = _alignment(spark, folder).aligned.join(theirs, ["clip_id", "clip_turn_id"], "left").join(ours, ["conversation_id", "turn_id"], "left")
    known = F.col("g").isNotNull() & F.col("p").isNotNull()
    return rows.agg(F.count("*").alias("turns_aligned"), F.count_if(~known).alias("turns_unlabelled"), F.round(F.avg(F.when(known, (F.col("g") == F.col("p")).cast("double"))), 6).alias("exact_match"))


@query(f"WITH {_EXTERNAL} SELECT stratum, n, {', '.join(map(_r6, ('exact_match', 'mean_jaccard', 'single_accuracy', 'kappa', 'macro_f1', 'micro_f1')))}, n_single FROM summ")
def external_summary(spark: SparkSession, folder: str) -> DataFrame:
    """All strata of the clips' labels against the candidate's."""
    rows, _ = align.external_records(_alignment(spark, folder).aligned, _t(spark, folder, "ext_labels"), _t(spark, folder, "candidate"))
    return metrics.summary(rows).withColumns({c: F.round(c, 6) for c in ("exact_match", "mean_jaccard", "single_accuracy", "kappa", "macro_f1", "micro_f1")})


@query(f"""WITH {_EXTERNAL} SELECT (SELECT string_agg(m, '|' ORDER BY m) FROM (SELECT DISTINCT model_id AS m FROM ext_labels WHERE model_id IS NOT NULL)) AS models,
  (SELECT count(*) FROM both_ WHERE gold IS NOT NULL AND pred IS NOT NULL) AS turns_aligned, (SELECT count(*) FROM both_ WHERE gold IS NULL OR pred IS NULL) AS turns_unlabelled,
  round(kappa, 6) AS kappa, round(coalesce(exact_match, 0), 6) AS exact_match, coalesce(kappa >= 0.75 AND exact_match >= 0.8, false) AS accepted FROM summ WHERE stratum = 'overall'""")
def external_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The models behind the clips' labels, how many turns could be compared, and the verdict."""
    rows, counts = align.external_records(_alignment(spark, folder).aligned, _t(spark, folder, "ext_labels"), _t(spark, folder, "candidate"))
    models = _t(spark, folder, "ext_labels").agg(F.array_join(F.array_sort(F.collect_set("model_id")), "|").alias("models"))
    verdict = metrics.verdict(metrics.summary(rows)).select(F.round("kappa", 6).alias("kappa"), F.round("exact_match", 6).alias("exact_match"), "accepted")
    return models.crossJoin(counts).crossJoin(verdict)  # one row each


@query(f"WITH {TURNS} SELECT round(coalesce(sum(s), 0.0), 3) AS audio_seconds FROM (SELECT max(t_end) - min(t_start) AS s FROM t GROUP BY conversation_id)")
def audio_seconds(spark: SparkSession, folder: str) -> DataFrame:
    return speed.audio_seconds(_turns(spark, folder)).withColumn("audio_seconds", F.round("audio_seconds", 3))


_RUNS = [("m1", "a", 12.0, 30.5, 41.0, 7, 9000, 2500, 107, 246.0, 0), ("m2", "b", 3.0, 0.0, 2.0, 1, 100, 50, 0, 0.0, 3)]


@query("""SELECT * FROM (VALUES ('m1', 'a', 107::BIGINT, 0::BIGINT, 82.0::DOUBLE, 0.38::DOUBLE, 0.17::DOUBLE), ('m2', 'b', 0::BIGINT, 3::BIGINT, 5000.0::DOUBLE, 2.0::DOUBLE, 200.0::DOUBLE)) v(model, engine, n_turns, failed_labels, tokens_per_second, seconds_per_turn, times_real_time)""")
def speed_summary(spark: SparkSession, folder: str) -> DataFrame:
    from colloquy.schema import RUN_STATS

    return speed.speed_summary(spark.createDataFrame(_RUNS, RUN_STATS))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_hours(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_windows(_t(spark, folder, "events"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {_labels_sql('gold', 'golden')} SELECT count(*) FILTER (WHERE coalesce(labeler, '') LIKE '%(failed)') AS n_failed, count(*) AS n_labels FROM gold_rows")
def failed_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labels.failed_labels(_t(spark, folder, "golden"))


@query(f"""WITH {NUMBERED} SELECT conversation_id, window_id, round(greatest(0, s - 0.5), 6) AS audio_start, round(greatest(0.05, e - s + 1.0), 6) AS audio_seconds FROM (
  SELECT conversation_id, window_id, coalesce(min(t_start), 0.0) AS s, coalesce(max(t_end), 0.0) AS e FROM tiled WHERE role = 'TARGET' GROUP BY 1, 2)""")
def audio_slices(spark: SparkSession, folder: str) -> DataFrame:
    """What to cut from the recording for every window, half a second more on both sides."""
    spans = windows.time_spans(windows.tiles(_numbered(spark, folder), STEP, CONTEXT))
    cut = C.audio_slice(F.col("span_start"), F.col("span_end"), 0.5)
    return spans.select("conversation_id", "window_id", F.round(cut["start"], 6).alias("audio_start"), F.round(cut["seconds"], 6).alias("audio_seconds"))


@query(f"""WITH {TURNS}, {_labels_sql('pred', 'candidate')} SELECT c.conversation_id, c.audio_path, array_to_string(c.speakers, '|') AS speakers, c.meta['series'] AS series, coalesce(n, 0) AS n_turns, coalesce(labelled, 0) AS n_labelled, coalesce(ids, '') AS turn_ids
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY try_cast(meta['revision'] AS DOUBLE) DESC NULLS LAST) = 1) c
LEFT JOIN (SELECT conversation_id, count(*) AS n, count(p.addressees) AS labelled, string_agg(coalesce(CAST(t.turn_id AS VARCHAR), '') || '>' || coalesce(array_to_string(p.addressees, '+'), '?'), ' ' ORDER BY coalesce(t_start, 0), t.turn_id NULLS FIRST, coalesce(array_to_string(p.addressees, '+'), '?')) AS ids
  FROM t LEFT JOIN pred p USING (conversation_id, turn_id) GROUP BY 1) USING (conversation_id)""")
def merged_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts with the candidate's labels in their turns, written as JSON lines and read again."""
    merged = merge.merged_conversations(_t(spark, folder, "conversations"), labels.one_label_per_turn(_t(spark, folder, "candidate")))
    path = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"
    jsonl.write_merged(merged, path)
    rows = spark.read.schema(merged.schema).json(path)
    shown = F.transform("turns", lambda t: F.concat(F.coalesce(t["turn_id"].cast("string"), F.lit("")), F.lit(">"), F.coalesce(F.array_join(t["addressees"], "+"), F.lit("?"))))
    return rows.select(
        "conversation_id", "audio_path", F.array_join("speakers", "|").alias("speakers"), F.try_element_at("meta", F.lit("series")).alias("series"), F.size("turns").cast("bigint").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["addressees"].isNotNull())).cast("bigint").alias("n_labelled"), F.array_join(shown, " ").alias("turn_ids"),
    )


@query(f"""WITH {_labels_sql('one', 'golden')} SELECT conversation_id, turn_id, array_to_string(addressees, '+') AS addressees, round(confidence, 9) AS confidence, rationale, labeler FROM one""")
def labels_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The label that counts of every turn, written as JSON lines, one conversation a line, and read again."""
    path = f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    jsonl.write_labels(labels.one_label_per_turn(_t(spark, folder, "golden")), path)
    return jsonl.read_labels(spark, path).withColumns({"addressees": F.array_join("addressees", "+"), "confidence": F.round("confidence", 9)})


@query("SELECT conversation_id, audio_path, array_to_string(speakers, '|') AS speakers, len(turns) AS n_turns, list_sum([length(x.text) FOR x IN turns]) AS characters, meta['revision'] AS revision FROM conversations WHERE turns IS NOT NULL AND conversation_id IS NOT NULL")
def conversations_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of conversations, written as JSON lines and read again."""
    path = f"{shared_folder(spark)}/conversations-{uuid.uuid4().hex}"
    jsonl.write_conversations(_t(spark, folder, "conversations").where("turns IS NOT NULL AND conversation_id IS NOT NULL"), path)
    rows = jsonl.read_conversations(spark, path)
    characters = F.aggregate(F.transform("turns", lambda t: F.char_length(t["text"])), F.lit(None).cast("bigint"), lambda a, n: F.coalesce(a + n, a, n.cast("bigint")))
    return rows.select("conversation_id", "audio_path", F.array_join("speakers", "|").alias("speakers"), F.size("turns").cast("bigint").alias("n_turns"), characters.alias("characters"), F.try_element_at("meta", F.lit("revision")).alias("revision"))


# The turns of conversations written as word and segment files, names as hexadecimal digits, words as runs of printable ASCII, times
# as whole hundredths; of one speaker in ten the words file is missing.

_XML_TURNS = f"""{TURNS}, u AS (
  SELECT conversation_id, hex(speaker) AS spk, CAST(floor(round(1000 * t_start) / 10) AS BIGINT) AS a, CAST(floor(round(1000 * t_end) / 10) AS BIGINT) AS b, turn_id, text,
    [x FOR x IN string_split_regex(coalesce(text, ''), '[^\\x21-\\x7e]+') IF x <> ''] AS w FROM t WHERE speaker IS NOT NULL AND t_start IS NOT NULL AND t_end IS NOT NULL AND conversation_id IS NOT NULL
), kept AS (SELECT * FROM u WHERE len(w) > 0 AND (length(spk) // 2) % 10 <> 5), prep AS (
  SELECT hex(conversation_id) AS conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY a, spk, b, turn_id, text) - 1 AS turn_id, spk AS speaker, a / 100.0 AS t_start, b / 100.0 AS t_end, array_to_string(w, ' ') AS text,
    EXISTS (SELECT 1 FROM kept o WHERE o.conversation_id = k.conversation_id AND o.spk <> k.spk AND o.a < k.b AND o.b > k.a) AS overlap FROM kept k
)"""


def _xml_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(words, segments): (path, content) of a file of each kind for every conversation and speaker."""
    rows = _turns(spark, folder).where("speaker IS NOT NULL AND t_start IS NOT NULL AND t_end IS NOT NULL AND conversation_id IS NOT NULL")
    at = lambda c: F.floor(C.millis(F.col(c)) / 10).cast("bigint")
    rows = rows.select(F.hex("conversation_id").alias("meeting"), F.hex("speaker").alias("spk"), at("t_start").alias("a"), at("t_end").alias("b"), "turn_id", "text")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\x21-\x7e]+"), lambda x: x != "")
    turn = F.struct("a", "b", "turn_id", "text", words.alias("w"))
    files = rows.groupBy("meeting", "spk").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    seconds = lambda c: F.format_string("%d.%02d", F.floor(c / 100), F.pmod(c, F.lit(100)))
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    word = lambda t, i: F.transform(t["w"], lambda w, j: F.format_string('<w nite:id="%s" starttime="%s" endtime="%s">%s</w>', F.concat_ws(".", i, j), seconds(t["a"]), seconds(t["b"]), escaped(w)))
    last = lambda t: F.size(t["w"]) - 1
    segment = lambda t, i: F.format_string('<segment><nite:child href="x.words.xml#id(%s)..id(%s)"/></segment>', F.concat_ws(".", i, last(t)), F.concat_ws(".", i, F.lit(0)))
    wrap = lambda parts: F.concat(F.lit('<root xmlns:nite="http://nite.sourceforge.net/">'), F.array_join(parts, ""), F.lit("</root>"))
    made = files.select(
        F.concat_ws(".", "meeting", "spk").alias("name"), (F.length("spk") / 2).cast("int").alias("size"),
        wrap(F.flatten(F.transform("turns", word))).alias("words"), wrap(F.transform("turns", segment)).alias("segments"),
    )
    named = lambda kind: F.concat(F.lit("/x/"), "name", F.lit(f".{kind}.xml")).alias("path")
    return made.where("size % 10 <> 5").select(named("words"), F.col("words").alias("content")), made.select(named("segments"), F.col("segments").alias("content"))


@query(f"WITH {_XML_TURNS} SELECT conversation_id, turn_id, speaker, t_start, t_end, text, overlap FROM prep")
def ami_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns put together from word and segment files."""
    words, segments = _xml_files(spark, folder)
    return ingest.turns_from_spans(ingest.read_words(words), ingest.read_segments(segments))


@query(f"""WITH {_XML_TURNS}, r AS (SELECT hex(conversation_id) AS conversation_id, count(DISTINCT spk) AS n_speakers FROM u GROUP BY 1)
SELECT conversation_id, n_speakers, count(p.turn_id) AS n_turns, count(*) FILTER (WHERE overlap) AS n_overlap, 100 * count(*) FILTER (WHERE overlap) // greatest(count(p.turn_id), 1) AS overlap_percent, round(coalesce(max(t_end), 0) / 60, 6) AS minutes
FROM r LEFT JOIN prep p USING (conversation_id) GROUP BY 1, 2""")
def ami_prepare_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the conversations prepared from word and segment files, those without words among them."""
    return ingest.prepare_stats(ingest.prepared(*_xml_files(spark, folder))).withColumn("minutes", F.round("minutes", 6))


P5_SQL = f"""
WITH {CURRENT}, t AS (
  SELECT DISTINCT conversation_id, unnest(turns) AS turn FROM current
), i AS (
  SELECT conversation_id AS c, CAST(round(1000 * turn."start") AS BIGINT) AS s, CAST(round(1000 * turn."end") AS BIGINT) AS e
  FROM t WHERE turn."start" IS NOT NULL AND turn."end" IS NOT NULL
), o AS (
  SELECT c, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY c ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS anew
  FROM i WHERE e > s
), r AS (
  SELECT c, s, e, sum(anew) OVER (PARTITION BY c ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM o
), p AS (
  SELECT c, run, min(s) AS s, max(e) AS e, count(*) AS n FROM r GROUP BY c, run
), g AS (
  SELECT c, e AS s, lead(s) OVER (PARTITION BY c ORDER BY s) AS e FROM p
)
SELECT c AS conversation_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p WHERE n >= 2
UNION ALL
SELECT c, 'gap', s, e FROM g WHERE e - s >= 2000
"""


@query(P5_SQL)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return speech_periods_and_gaps(_t(spark, folder, "conversations"))
