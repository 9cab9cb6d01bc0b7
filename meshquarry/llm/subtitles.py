"""Words of subtitle texts: what is spoken, without numbers, times, tags, labels and sounds."""

from __future__ import annotations

import re
import unicodedata

_TIMES = re.compile(r"(?:(?:^|(?<=[\s]))\d{1,6}[ \t]*\r?\n?[ \t]*)?(?:\d{1,3}:)?\d{1,2}:\d{2}[,.:]\d{1,3}[ \t]*-+>[ \t]*(?:\d{1,3}:)?\d{1,2}:\d{2}[,.:]\d{1,3}[^\S\n]*(?:(?:align|position|line|size|X1|X2|Y1|Y2|region|vertical):\S+[^\S\n]*)*", re.M)
_TIME_LINE = re.compile(r"^[\d:., \t]{5,20}-+>[\d:., \t]{5,20}$", re.M)
_NUMBER_LINE = re.compile(r"^[ \t﻿]*\d{1,6}[ \t\r]*$", re.M)
_HEADER = re.compile(r"^﻿?WEBVTT[^\n]*$", re.M)
_TAG = re.compile(r"<[^<>\n]{0,200}>|\{\\?[^{}\n]{0,60}\}")
_SOUND = re.compile(r"\[[^\[\]\n]{0,80}\]|\([^()\n]{0,80}\)")
_LABEL = re.compile(r"^([ \t♪#>*-]*)(?:[^\W\d_][\w.'’-]{1,24}(?:[ \t]\d{1,2})?|[A-ZÀ-Þ][A-ZÀ-Þ.' -]{1,24}(?:[ \t]\d{1,2})?):(?=[ \t]|$)", re.M)
_HIGH = re.compile(r"[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™]{2,}")
_PUNCTUATION = re.compile(r"[^\w\s\ufffd]|_")
#: Latin letters with marks, what wrong encodings leave of them, and the sign of a lost letter.
_MARKED = re.compile(r"[\u0080-\u024f\u0300-\u036f\u1e00-\u1eff\ufffd]")
#: Scripts written without blanks, in which every letter counts as a word.
_UNSPACED = re.compile(r"([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])")
_DROP = {i: None for i in range(128) if not chr(i).isalnum() and not chr(i).isspace()}


def _bytes(run: str) -> bytes:
    return b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in run)


def _repair(m: re.Match) -> str:
    try:
        return _bytes(m[0]).decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return m[0]


def repair_encoding(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, put right (up to two layers)."""
    for _ in range(2):
        if not _HIGH.search(text):
            break
        text = _HIGH.sub(_repair, text)
    return text


def without_times(text: str) -> str:
    """The text without header, times and cue numbers."""
    t = _TIME_LINE.sub("", text)
    if "->" in t:  # times that share their line
        t = _TIMES.sub("\n", t)
    return _NUMBER_LINE.sub("", _HEADER.sub("", t) if "WEBVTT" in t else t)


def spoken(text: str | None) -> str:
    """The text outside numbers, times, header, tags, sounds and speaker labels."""
    if not text:
        return ""
    t = repair_encoding(text.replace("\r\n", "\n").replace("\r", "\n"))
    t = without_times(t)
    t = _TAG.sub(" ", t)
    t = _SOUND.sub(" ", t)
    return _LABEL.sub(r"\1", t)


def fold(text: str) -> list[str]:
    """Words between blanks, lower case, letters and digits only.

    Every Latin letter with a mark becomes ``*``, as does one lost in a wrong encoding; letters of other scripts stay.
    """
    t = text.lower()
    if not t.isascii():
        t = _MARKED.sub("*", _PUNCTUATION.sub("", unicodedata.normalize("NFC", t)))
        return _UNSPACED.sub(r" \1 ", t).split()
    return t.translate(_DROP).split()


def words(text: str | None) -> list[str]:
    """The spoken words in order, folded."""
    return fold(spoken(text))
