"""Arabic-aware text normalization as column expressions (no Python at run time).

``for_comparison`` is the whole chain in its fixed order: unseen characters go
before presentation forms are folded, these before tatweel and vowel marks, and
letters, digits and punctuation are unified before white space collapses.  Null
in, null out; empty in, empty out.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What normalization must agree on.
INVISIBLE = r"[\u061c\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]|[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u009F]"
FORMS = r"[\ufb50-\ufdff\ufe70-\ufefe]"
DIACRITICS = r"[\u064b-\u065f\u0670\u06d6-\u06ed]"
TATWEEL = "ـ"
ALEFS = ("أإآٱ", "ا")
MAQSURA = ("ى", "ي")
TAA_MARBUTA = ("ة", "ه")
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬٪", "01234567890123456789.,%")
PUNCTUATION = ("،؛؟", ",;?")
WORD = r"[\p{L}\p{N}_]+"


def _folded(code: int) -> str:
    """The compatibility form of one presentation form; marks that stand on a space lose it."""
    plain = unicodedata.normalize("NFKC", chr(code))
    return plain.replace(" ", "") if 0xFE70 <= code <= 0xFE7F else plain


#: Presentation forms by what they fold to: one character, or several.
FOLDS = {chr(c): f for c in [*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFF)] if (f := _folded(c)) != chr(c)}
SINGLE = {k: v for k, v in FOLDS.items() if len(v) == 1}
SEVERAL = {k: v for k, v in FOLDS.items() if len(v) != 1}


def ranges(codes: list[int]) -> str:
    """A regex class of sorted code points, by ranges (a class of hundreds of single characters is slow to match)."""
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out) + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """A value for a ``select`` that filters above it name without its being worked out again in each (they stay above)."""
    return F.explode_outer(F.array(value))


def strip_invisible(c: Column) -> Column:
    """Without direction marks, zero-width characters and control characters (tab and line ends stay)."""
    return F.regexp_replace(c, INVISIBLE, "")


def fold_presentation_forms(c: Column) -> Column:
    """Presentation forms replaced by the letters they show; rows without any are passed by."""
    table = F.from_json(F.lit(json.dumps(SEVERAL)), "map<string,string>")  # a constant, folded once
    # the eight ligatures of lam and alef are common and replaced one by one; the hundreds of others are looked up, by letter
    common = [k for k in SEVERAL if ord(k) >= 0xFEF5]
    several = ranges([ord(k) for k in SEVERAL if k not in common])

    def lettered(s: Column) -> Column:
        return F.array_join(F.transform(F.split(s, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")

    def folded(s: Column) -> Column:
        s = F.translate(s, "".join(SINGLE), "".join(SINGLE.values()))
        for k in common:
            s = F.replace(s, F.lit(k), F.lit(SEVERAL[k]))
        return let(s, lambda t: F.when(t.rlike(several), lettered(t)).otherwise(t))

    return let(c, lambda s: F.when(s.rlike(FORMS), folded(s)).otherwise(s))


def remove_tatweel(c: Column) -> Column:
    return F.translate(c, TATWEEL, "")


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, DIACRITICS, "")


def unify_alef(c: Column) -> Column:
    return F.translate(c, ALEFS[0], ALEFS[1] * len(ALEFS[0]))


def unify_alef_maqsura(c: Column) -> Column:
    return F.translate(c, *MAQSURA)


def unify_taa_marbuta(c: Column) -> Column:
    return F.translate(c, *TAA_MARBUTA)


def unify_digits(c: Column) -> Column:
    return F.translate(c, *DIGITS)


def unify_punctuation(c: Column) -> Column:
    return F.translate(c, *PUNCTUATION)


def collapse_whitespace(c: Column) -> Column:
    """Runs of any Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: One ``translate`` for tatweel, letters, digits and punctuation: characters past the end of the second string go.
UNIFIED = (
    ALEFS[0] + MAQSURA[0] + TAA_MARBUTA[0] + DIGITS[0] + PUNCTUATION[0] + TATWEEL,
    ALEFS[1] * len(ALEFS[0]) + MAQSURA[1] + TAA_MARBUTA[1] + DIGITS[1] + PUNCTUATION[1],
)


def for_comparison(c: Column) -> Column:
    """The text as texts are compared."""
    return collapse_whitespace(F.translate(strip_diacritics(fold_presentation_forms(strip_invisible(c))), *UNIFIED))


def as_printed(c: Column) -> Column:
    """The text with its encoding alone normalized."""
    return fold_presentation_forms(strip_invisible(c))


def metadata_text(c: Column) -> Column:
    """Metadata without trade marks, in lower case."""
    return collapse_whitespace(F.lower(F.translate(c, "®™©", "")))


def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Canonical composition, by an Arrow UDF: Spark has no such function."""
    # text in ASCII is composed already
    other = c.rlike(r"[^\x00-\x7f]")
    return F.when(other, F.pandas_udf(_composed, "string")(F.when(other, c))).otherwise(c)


def raw_form(c: Column) -> Column:
    """The composed text without unseen characters, white space collapsed."""
    return collapse_whitespace(strip_invisible(nfc(c)))


def normalized_form(c: Column) -> Column:
    """The composed text as texts are compared."""
    return for_comparison(nfc(c))


def plain(text: str) -> str:
    """``for_comparison`` of a constant, on the driver (for word lists)."""
    import re

    text = re.sub(INVISIBLE, "", text)
    text = "".join(FOLDS.get(ch, ch) for ch in text)
    text = re.sub(DIACRITICS, "", text).translate({ord(ch): UNIFIED[1][i] if i < len(UNIFIED[1]) else None for i, ch in enumerate(UNIFIED[0])})
    return " ".join(text.split())
