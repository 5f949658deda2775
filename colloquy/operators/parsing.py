"""Raw labeler responses into validated labels."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.columns import allowed_addressees, closed_set

ITEM = "struct<turn_id:bigint,addressees:array<string>,confidence:double,rationale:string,error:string>"
PARSED = f"struct<error:string,items:array<{ITEM}>>"

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
_OPEN = re.compile(r"[\[{]")


def json_part(response: str) -> str:
    """The JSON of a response: after the last closed thinking part, in the first fence if there is one, the first bracketed value.

    Raises ValueError where thinking never ends, no bracket opens, or the first one never closes. Brackets inside strings don't
    count; only brackets of the first one's kind do.
    """
    text = response.strip()
    head, closed, tail = text.rpartition("</think>")
    if closed:
        text = tail.strip()
    elif text.startswith("<think>"):
        raise ValueError("thinking never ends")
    fence = _FENCE.search(text)
    if fence:
        text = fence[1]
    first = _OPEN.search(text)
    if not first:
        raise ValueError("no JSON")
    opening = first[0]
    closing = "]" if opening == "[" else "}"
    depth = 0
    for token in re.finditer(r'"(?:\\.|[^"\\])*(?:"|$)|[\[\]{}]', text[first.start() :], re.DOTALL):
        depth += (token[0] == opening) - (token[0] == closing)
        if depth == 0:
            return text[first.start() : first.start() + token.end()]
    raise ValueError("JSON never closes")


def parse_response(response: str | None) -> tuple[str | None, list[tuple]]:
    """(error, items) of one response; an error is the name of what went wrong and fails the whole window.

    An item that cannot be assigned to a turn is left out. One whose addressees are neither a name nor a collection carries an
    error of its own, which fails its window if its turn is a target.
    """
    try:
        value = json.loads(json_part(response or ""))
        if isinstance(value, dict) and "labels" in value:
            value = value["labels"]
        elif not isinstance(value, list):
            value = [value]
        return None, [x for x in map(_item, list(value)) if x]
    except (ValueError, TypeError, OverflowError, RecursionError) as error:
        return type(error).__name__, []


def _item(raw: object) -> tuple | None:
    if not isinstance(raw, dict):
        return None
    try:
        turn = int(raw["turn_id"])
    except (KeyError, ValueError, TypeError):
        return None
    if not -(2**63) <= turn < 2**63:
        return None
    names, error = raw["addressees"] if "addressees" in raw else raw.get("addressee", []), None
    if isinstance(names, str):
        names = [names]
    elif not isinstance(names, (list, dict)):
        names, error = [], "TypeError"
    confidence = raw.get("confidence")
    confidence = float(confidence) if isinstance(confidence, (int, float)) else None
    rationale = raw.get("rationale")
    return turn, [str(n) for n in names], confidence, None if rationale is None else str(rationale), error


def parsed_response(raw: Column) -> Column:
    """(error, items) of raw responses. Arrow-batched: extraction and tolerant reading only; everything after is relational."""

    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_response(r) for r in batch], columns=["error", "items"])

    return F.pandas_udf(run, PARSED)(raw)


#: What the rationale of a label says whose window failed, or that the response misses.
FAILED, MISSING = "labeler failed: ", "missing from model output"


def labels_from_responses(responses: DataFrame, targets: DataFrame, labeler: str) -> DataFrame:
    """(conversation_id, turn_id, addressees, confidence, rationale, labeler): a label for every target turn.

    ``responses`` is (conversation_id, window_id, raw) with at most one row a window, ``targets`` (conversation_id, window_id,
    turn_id, speaker, speakers). Items for turns that are no target of the window are dropped, names outside the closed set too;
    nothing left, or a turn that the response misses, gives UNKNOWN; of several items on one turn the last counts. A failed window,
    also one without a response, gives UNKNOWN with confidence 0 and a labeler ending in ``(failed)`` on each of its targets. If
    ``responses`` has a column ``error``, a non-null one fails the window under that name.

    ``responses`` is read once and parsed once: the targets of a window are gathered, joined with its one response, and all that
    remains is worked out inside the row. A window is what fits a prompt, so a row stays small whatever the corpus.
    """
    failure = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    parsed = responses.select("conversation_id", "window_id", failure.alias("__failure"), parsed_response(F.col("raw")).alias("__p"))
    speakers = F.coalesce("speakers", F.array().cast("array<string>"))
    target = F.struct("turn_id", allowed_addressees(speakers, F.col("speaker")).alias("allowed"))
    windows = targets.groupBy("conversation_id", "window_id").agg(F.collect_list(target).alias("__targets"))
    rows = windows.join(parsed, [windows.conversation_id.eqNullSafe(parsed.conversation_id), windows.window_id == parsed.window_id], "left").select(
        windows.conversation_id, "__targets", "__failure", "__p"
    )
    items = F.coalesce("__p.items", F.array().cast(f"array<{ITEM}>"))
    ids = F.transform("__targets", lambda t: t["turn_id"])
    bad = F.array_max(F.transform(F.filter(items, lambda i: F.array_contains(ids, i["turn_id"])), lambda i: i["error"]))
    error = F.coalesce("__failure", "__p.error", bad, F.when(F.col("__p").isNull(), "NoResponse"))
    rows = rows.select("conversation_id", "__targets", items.alias("__items"), error.alias("__error"))

    failed, unknown = F.col("__error").isNotNull(), F.array(F.lit("UNKNOWN"))

    def label(t: Column) -> Column:
        found = F.try_element_at(F.filter("__items", lambda i: i["turn_id"] == t["turn_id"]), F.lit(-1))
        none = failed | found.isNull()
        return F.struct(
            t["turn_id"].alias("turn_id"),
            F.when(none, unknown).otherwise(closed_set(found["addressees"], t["allowed"])).alias("addressees"),
            F.when(none, F.lit(0.0)).otherwise(found["confidence"]).alias("confidence"),
            F.when(failed, F.concat(F.lit(FAILED), "__error")).when(none, F.lit(MISSING)).otherwise(found["rationale"]).alias("rationale"),
        )

    name = F.when(failed, F.lit(f"{labeler}(failed)")).otherwise(F.lit(labeler))
    return rows.select("conversation_id", name.alias("labeler"), F.inline(F.transform("__targets", label))).select(
        "conversation_id", "turn_id", "addressees", "confidence", "rationale", "labeler"
    )
