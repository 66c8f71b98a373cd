"""Words of a text as passages are compared: runs of letters and digits, whatever their case, width, punctuation, invisible characters and line breaks."""

from __future__ import annotations

import unicodedata

import regex

_LINE_END = r"[\n\r\u0085\u2028\u2029]"
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SOFT_BREAK = regex.compile(r"\u00ad(?=[^\S\n\r]*" + _LINE_END + ")")
#: Format characters, marks that stay after composition, and fillers without a shape.
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}\u115f\u1160\u3164\uffa0]+")
_BROKEN = regex.compile(r"(?<=[\p{L}\p{N}])[-\u2010]+[^\S\n\r]*" + _LINE_END + r"[\s>]*(?=[\p{L}\p{N}])")


def words(text: str | None) -> list[str]:
    """Folded words; a word broken by a hyphen at a line end (also before a quoted line's `>`) is one word. NULL and blank texts have none."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = _UNSEEN.sub("", _SOFT_BREAK.sub("-", text))
    if "-" in text or "\u2010" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.casefold())
