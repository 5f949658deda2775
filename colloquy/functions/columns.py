"""Column expressions used by many operators. No Python runs on the executors for any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.schema import GROUP, UNKNOWN

#: White space at either end of a name, as Unicode knows it.
EDGE_SPACE = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$"

#: Words that mark a short turn as a backchannel.
BACKCHANNEL_WORDS = (
    "yeah yep yes mm mm-hm mmhm uh-huh right ok okay sure exactly true haha hmm oh wow"
).split()

#: Fixed value: a decimal number, without what only Java takes for one ("12f", "0x1p3").
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(value: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(value, EDGE_SPACE, "")


def folded(value: Column) -> Column:
    """A name as it is compared: trimmed, letter case ignored. Null stays null."""
    return F.lower(strip(value))


def number(value: Column) -> Column:
    """A string as DOUBLE, null where it isn't a plain decimal number."""
    return F.when(value.rlike(NUMBER), strip(value).try_cast("double"))


def millis(seconds: Column) -> Column:
    """Whole milliseconds of seconds as BIGINT; null for null, NaN and infinite."""
    return F.round(seconds * F.lit(1000.0)).try_cast("bigint")


def normalized_labels(addressees: Column) -> Column:
    """Sorted distinct non-empty names; UNKNOWN beside others means UNKNOWN. An empty or null array gives an empty one."""
    names = F.array_sort(
        F.array_distinct(
            F.filter(F.coalesce(addressees, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
        )
    )
    return F.when((F.size(names) > 1) & F.array_contains(names, UNKNOWN), F.array(F.lit(UNKNOWN))).otherwise(names)


def allowed_addressees(speakers: Column, speaker: Column) -> Column:
    """The roster without the speaker, then GROUP and UNKNOWN. A null speaker leaves the whole roster."""
    others = F.filter(speakers, lambda s: ~s.eqNullSafe(speaker))
    return F.concat(others, F.array(F.lit(GROUP), F.lit(UNKNOWN)))


def closed_set(addressees: Column, allowed: Column) -> Column:
    """Stripped names that are allowed, normalised; UNKNOWN where none is left."""
    kept = F.filter(F.transform(addressees, strip), lambda x: F.array_contains(allowed, x))
    return F.when(F.size(kept) > 0, normalized_labels(kept)).otherwise(F.array(F.lit(UNKNOWN)))


#: One to three words and nothing else: a longer text is given up at its fourth word, whatever its length.
UP_TO_THREE_WORDS = r"\A[^a-z']*+(?:[a-z']++[^a-z']++){0,2}[a-z']++[^a-z']*+\z"


def is_backchannel(text: Column) -> Column:
    """One to three words (letters and apostrophes), at least one of them a backchannel word. Null text: false."""
    folded_text = F.lower(text)
    words = F.regexp_extract_all(folded_text, F.lit("([a-z']+)"), 1)
    lexicon = F.array(*[F.lit(w) for w in BACKCHANNEL_WORDS])
    return F.when(folded_text.rlike(UP_TO_THREE_WORDS), F.arrays_overlap(words, lexicon)).otherwise(False)


def jaccard(left: Column, right: Column) -> Column:
    """Size of the intersection over size of the union; 1.0 for two empty arrays."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def roster(speakers: Column, turns: Column) -> Column:
    """The speakers listed, or where none is listed the distinct speakers of the turns in their order of appearance."""
    spoken = F.array_distinct(
        F.filter(F.transform(F.coalesce(turns, F.array().cast(_TURNS)), lambda t: t["speaker"]), lambda s: s.isNotNull())
    )
    return F.when(F.coalesce(F.size(speakers), F.lit(0)) > 0, speakers).otherwise(spoken)


_TURNS = "array<struct<turn_id:bigint,speaker:string,start:double,end:double,text:string,overlap:boolean>>"


def turn_hash(turn: Column) -> Column:
    """64 bits of a turn's whole content; used within one conversation only."""
    return F.xxhash64(
        turn["turn_id"], turn["speaker"], turn["start"], turn["end"], turn["text"], turn["overlap"],
        F.isnull(turn["turn_id"]), F.isnull(turn["speaker"]), F.isnull(turn["start"]), F.isnull(turn["end"]), F.isnull(turn["text"]), F.isnull(turn["overlap"]),
    )


def format_turn(marker: Column, turn_id: Column, start: Column, end: Column, speaker: Column, text: Column) -> Column:
    """One transcript line; null text and speaker count as empty, a null time as 0."""
    empty, zero = F.lit(""), F.lit(0.0)
    return F.format_string(
        "%s (turn %d) [%.2f-%.2f] %s: %s", marker, turn_id, F.coalesce(start, zero), F.coalesce(end, zero), F.coalesce(speaker, empty), F.coalesce(text, empty)
    )


def audio_slice(start: Column, end: Column, pad: float) -> Column:
    """(start, seconds): what to cut from a recording for a span, with ``pad`` seconds on both sides, from 0 on and never under 0.05 s."""
    return F.struct(
        F.greatest(F.lit(0.0), start - F.lit(pad)).alias("start"), F.greatest(F.lit(0.05), end - start + F.lit(2 * pad)).alias("seconds")
    )


def clip_offset(clip_t0: Column, meta: Column, clip_id: Column) -> Column:
    """Seconds from the start of the meeting to the start of a clip: the metadata's, else meta t0, else the number in the id, else 0."""
    in_id = F.regexp_extract(clip_id, r"(?s)^.*_t([^-]*)", 1)
    return F.coalesce(clip_t0, number(F.try_element_at(meta, F.lit("t0"))), number(in_id), F.lit(0.0))


def meeting_of(ami_meeting: Column, meta: Column, clip_id: Column) -> Column:
    """The meeting a clip was cut from: the metadata's, else meta meeting, else the id before its last ``_t``."""
    return F.coalesce(
        F.nullif(ami_meeting, F.lit("")),
        F.nullif(F.try_element_at(meta, F.lit("meeting")), F.lit("")),
        F.regexp_replace(clip_id, r"(?s)^(.*)_t.*$", "$1"),
    )
