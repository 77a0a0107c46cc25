"""Pre-token splitters for the public tokenizer files, with a fast exact path for Latin-1 texts.

``byte``: the byte-level pattern; ``word``: lower-cased words of the word-end vocabulary. A text that Latin-1 can't hold
goes to the general pattern (``byte``), unless it has a character that this pattern's Unicode tables and the tokenizers
library's may class differently; such texts, and for ``word`` all texts beyond Latin-1, are left to the library. So
results never depend on which path ran.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import regex

_LATIN = [chr(i) for i in range(256)]
#: Characters with the Unicode property White_Space below U+0100 (fixed by the standard).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _of(kind: str) -> str:
    return "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind)


_L, _N, _S = _of("L"), _of("N"), re.escape(_SPACE)
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LATIN_BYTE = re.compile(f"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
LATIN_WORD = re.compile(f"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_WS = r"\p{White_Space}"
ANY_BYTE = regex.compile(rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|{_WS}+(?!\P{{White_Space}})|{_WS}+")


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _class(category: str) -> str:
    return category[0] if category[0] in "LNZ" else ""


@functools.cache
def unsure() -> re.Pattern[str]:
    """Characters beyond Latin-1 that Unicode 3.2 hadn't assigned or classed as letter, number, separator or other unlike
    today. All others are classed alike by every later version."""
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    bad = [c for c in range(0x100, 0x110000) if (was := old(chr(c))) == "Cn" or _class(was) != _class(new(chr(c)))]
    ranges, begin = [], None
    for c, after in zip(bad, [*bad[1:], -1], strict=True):
        begin = c if begin is None else begin
        if after != c + 1:
            ranges.append(rf"\U{begin:08x}-\U{c:08x}")
            begin = None
    return re.compile(f"[{''.join(ranges)}]")


def byte_words(text: str) -> list[str] | None:
    """Words of the byte-level vocabulary, or None where only the library's pre-tokenizer gives them surely."""
    if is_latin(text):
        return LATIN_BYTE.findall(text)
    return None if unsure().search(text) else ANY_BYTE.findall(text)


def lower_words(text: str) -> list[str] | None:
    """Words of the word-end vocabulary, or None where only the library's normaliser gives them surely."""
    return LATIN_WORD.findall(text.lower()) if is_latin(text) else None
