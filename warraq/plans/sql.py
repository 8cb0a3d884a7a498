"""Pieces of SQL that say in another engine's words what the column expressions do, for comparing results."""

from __future__ import annotations

from ..functions.normalize import SEVERAL, SINGLE, UNIFIED
from ..functions.text import CLASSES
from ..functions.tokens import PREFIXES, STOPWORDS, SUFFIXES

SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '[\x{{61C}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x{{FEFF}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{80}}-\x{{9F}}]', '', 'g')"


def fold(x: str) -> str:
    """Presentation forms; of those that fold to several letters the ligatures of lam and alef and the marks on tatweel."""
    for form, letters in SEVERAL.items():
        if ord(form) >= 0xFE70:
            x = f"replace({x}, {quote(form)}, {quote(letters)})"
    return f"translate({x}, {quote(''.join(SINGLE))}, {quote(''.join(SINGLE.values()))})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def norm(x: str) -> str:
    marks = rf"regexp_replace({fold(strip(x))}, '[\x{{64B}}-\x{{65F}}\x{{670}}\x{{6D6}}-\x{{6ED}}]', '', 'g')"
    return collapse(f"translate({marks}, {quote(UNIFIED[0])}, {quote(UNIFIED[1])})")


def terms(x: str, normalize: bool = True, stopwords: bool = True, stem: bool = True) -> str:
    """Index terms as a list: compared, lower case, without stopwords, stemmed; each step can be switched off."""
    found = f"regexp_extract_all(lower({norm(x) if normalize else x}), '[\\p{{L}}\\p{{N}}_]+')"
    if stopwords:
        found = f"list_filter({found}, lambda w: NOT list_contains([{', '.join(map(quote, STOPWORDS))}], w))"
    if not stem:
        return found
    long_ = "|".join(p for p in PREFIXES if len(p) > 1)
    cut = f"CASE WHEN regexp_matches(w, '^(?:{long_})..') THEN regexp_replace(w, '^(?:{long_})', '') WHEN regexp_matches(w, '^و...') THEN substr(w, 2) ELSE w END"
    for s in SUFFIXES:
        cut = f"regexp_replace({cut}, '^(.{{2,}}){s}$', '\\1')"
    return f"list_transform({found}, lambda w: {cut})"


def count(x: str, cls: str) -> str:
    """How many characters of one of the named classes a text holds."""
    ranges = CLASSES[cls] if cls in CLASSES else cls
    spelled = "".join(c if c == "-" else f"\\x{{{ord(c):x}}}" for c in ranges)
    return f"length({x}) - length(regexp_replace({x}, '[{spelled}]', '', 'g'))"
