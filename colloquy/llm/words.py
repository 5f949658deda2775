"""Words of a text in one comparable form, whatever way it was written down."""

from __future__ import annotations

import html
import re
import unicodedata

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]|\\(?=[\"/\\])")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,31});")
_HYPHEN_BREAK = re.compile(r"(?<=\w)[-‐‑]\s*\n[\s>#|*]*(?=\w)")
_IDEOGRAPH = re.compile("([぀-ヿ㐀-鿿豈-﫿])")
#: Fixed value: what stands in front of a turn where a transcript window is rendered.
_TURN_MARK = re.compile(r"\[(?:CTX|>> )\] \(turn \d+\) \[[\d.]+-[\d.]+\]")
_WORD = re.compile(r"[^\W_]+")

#: Letters of other scripts that look like a Latin one.
LOOKALIKES = str.maketrans(
    "аВевкКМНоОрРсСтТуУхХіІјЈѕЅԁԛԝһαβεζηικμνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ",
    "aBebkKMHoOpPcCtTyYxXiIjJsSdqwhaBeznikuvoptuxABEZHIKMNOPTYXig",
)

#: Combining marks and invisible format characters, as ranges.
_DROPPED = re.compile("[" + "".join(chr(c) for c in range(0xAD, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Cf")) + "]+")
_TO_SPACE = {c: " " for c in range(128) if not chr(c).isalnum()}


def _unescape(match: re.Match) -> str:
    return chr(int(match[1], 16)) if match[1] else " " if match[0][1:] else ""


def plain(text: str) -> str:
    """Escapes and entities decoded, compatibility forms folded, accents and invisible characters dropped, lower case."""
    if "] (turn " in text:
        text = _TURN_MARK.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if "-\n" in text:
        text = _HYPHEN_BREAK.sub("", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold())
    kept = _DROPPED.sub("", text)
    return kept if kept.isascii() else _IDEOGRAPH.sub(r" \1 ", kept)


def words(text: str) -> list[str]:
    """The words of ``text`` in their plain form; each ideograph is a word."""
    text = plain(text)
    return text.translate(_TO_SPACE).split() if text.isascii() else _WORD.findall(text)
