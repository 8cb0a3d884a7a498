"""Text measures and repairs, as column expressions."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import collapse_whitespace, for_comparison, plain

# The classes that characters are counted by; the first that fits counts.
CLASSES = {
    "tatweel": "ـ",
    "replacement_chars": "�",
    "bidi_controls": "\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069",
    "presentation_forms": "\ufb50-\ufdff\ufe70-\ufeff",
    "arabic_diacritics": "\u064b-\u065f\u0670\u06d6-\u06ed",
    "arabic_indic_digits": "٠-٩۰-۹",
    "arabic_letters": "ؠ-ؿف-يٱ-ۓ",
    "c0_controls": "\u0000-\u0008\u000B\u000E-\u001F",
    "latin_letters": "A-Za-z",
    "ascii_digits": "0-9",
}


def count_of(c: Column, cls: str) -> Column:
    """How many characters of a class (the inside of a regex's brackets) a text holds."""
    return F.regexp_count(c, F.lit(f"[{cls}]")).cast("int")


def char_stats(c: Column) -> dict[str, Column]:
    """The counts of all classes and of characters."""
    return {"chars": F.length(c)} | {k: count_of(c, v) for k, v in CLASSES.items()}


def ratio(part: Column, whole: Column, places: int) -> Column:
    """part / whole, rounded half to even; 0 where there is nothing."""
    return F.when(whole > 0, F.bround(part / whole, places)).otherwise(0.0)


def language(c: Column) -> Column:
    """ar if a character of the Arabic block is there, else en."""
    return F.when(c.rlike("[\u0600-ۿ]"), "ar").otherwise("en")


def mostly_arabic(c: Column) -> Column:
    return count_of(c, CLASSES["arabic_letters"]) > count_of(c, "A-Za-z")


def cid_placeholders(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\(cid:\d+\)")).cast("int")


def foreign_letters(c: Column) -> Column:
    """Letters of neither Arabic nor Latin script, and private ones."""
    return F.regexp_count(c, F.lit(r"[\p{L}&&[^\p{IsArabic}\p{IsLatin}]]|\p{Co}")).cast("int")


def repair_letters(c: Column) -> Column:
    """Two letters that engines put beside Arabic ones, replaced by what they stand for."""
    beside = "[ء-غف-ي]"
    for wrong, right in (("ส", "سب"), ("ת", "ت")):
        c = F.regexp_replace(c, f"(?<={beside}){wrong}|{wrong}(?={beside})", right)
    return c


def fi_ligature(c: Column) -> Column:
    """A control character left by a lost ligature before a Latin letter is fi."""
    return F.regexp_replace(c, "\u001F(?=[A-Za-z])", "fi")


def redact(c: Column) -> Column:
    """Without e-mail addresses and numbers that may be telephones or identities."""
    c = F.regexp_replace(c, r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}", "[redacted]")
    c = F.regexp_replace(c, r"(?<![\p{Nd}+])\+?\p{Nd}(?:[ -]?\p{Nd}){8,}(?!\p{Nd})", "[redacted]")
    return F.regexp_replace(c, r"(?<!\p{Nd})\p{Nd}{7,}(?!\p{Nd})", "[redacted]")


def clause_number(c: Column) -> Column:
    """The number that starts a clause (.2, 2-, 2) and the like), or null."""
    probe = for_comparison(c)
    found = F.regexp_extract(probe, r"^(?:[.\-](\d{1,2})|(\d{1,2}) ?[.\-)])(?!\d)", 0)
    return F.when(found != "", F.regexp_extract(found, r"(\d{1,2})", 1).cast("int"))


def bulleted(c: Column) -> Column:
    return c.rlike("^[•●▪◦]")


def bare_numbers(c: Column) -> Column:
    """A line of numbers of one or two digits and nothing else."""
    return for_comparison(c).rlike(r"^\d{1,2}( \d{1,2})*$")


def trimmed_heading(c: Column) -> Column:
    return F.btrim(c, F.lit(" :-"))


def segment_kind(c: Column) -> Column:
    """What a printed segment of a calendar card is."""
    return (
        F.when(c.rlike(r"^\d{4}/\d{1,2}/\d{1,2}(-(\d{1,2}/)?\d{1,2})? ?م$"), "gregorian")
        .when(c.rlike(r"^\d{4}/\d{1,2}/\d{1,2}(-(\d{1,2}/)?\d{1,2})? ?هـ?$"), "hijri")
        .when(c.rlike(r"^(الأحد|الإثنين|الاثنين|الثلاثاء|الأربعاء|الخميس|الجمعة|السبت)( ?- ?(الأحد|الإثنين|الاثنين|الثلاثاء|الأربعاء|الخميس|الجمعة|السبت))?$"), "days_ar")
        .when(c.rlike(r"^(?i)(sun|mon|tues|wednes|thurs|fri|satur)day( ?- ?(sun|mon|tues|wednes|thurs|fri|satur)day)?$"), "days_en")
        .when(mostly_arabic(c), "arabic")
        .when(count_of(c, "A-Za-z") > 0, "english")
        .otherwise("other")
    )


def split_glued(c: Column, known: Column) -> Column:
    """An unknown word cut where exactly one cut leaves two known words; ``known`` is an array of words."""
    cuts = F.filter(F.sequence(F.lit(2), F.greatest(F.length(c) - 2, F.lit(2))), lambda i: F.array_contains(known, F.substring(c, F.lit(1), i)) & F.array_contains(known, c.substr(i + 1, F.length(c))) & (i <= F.length(c) - 2))
    once = F.element_at(cuts, 1)
    return F.when(F.array_contains(known, c) | (F.size(cuts) != 1), c).otherwise(F.concat(c.substr(F.lit(1), once), F.lit(" "), c.substr(once + 1, F.length(c))))


def cell(parts: Column) -> Column:
    """The text of a card's cell: its parts joined, without tatweel."""
    return collapse_whitespace(F.translate(F.array_join(parts, " "), "ـ", ""))


def row_sentence(names: Column, values: Column) -> Column:
    """A table row as a sentence; empty cells are left out."""
    pairs = F.filter(F.zip_with(names, values, lambda n, v: F.when(F.length(F.trim(v)) > 0, F.concat(n, F.lit(": "), F.trim(v)))), lambda x: x.isNotNull())
    return F.array_join(pairs, "، ")


def citations(c: Column) -> Column:
    """The distinct numbers cited in brackets, in order of appearance; both scripts, lists too."""
    found = F.regexp_extract_all(F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"), F.lit(r"\[(\d+(?:\s*[,،]\s*\d+)*)\]"), 1)
    return F.array_distinct(F.flatten(F.transform(found, lambda g: F.transform(F.split(g, r"\s*[,،]\s*"), lambda n: n.cast("int")))))


def says(c: Column, phrases: list[str]) -> Column:
    """Whether a text holds one of the fixed phrases, both as compared; null and blank texts don't."""
    own = for_comparison(c)
    return F.coalesce(F.greatest(*(own.contains(plain(p)) for p in [*phrases, phrases[0]])), F.lit(False))


# Number words and what they add, as they are compared.
NUMBER_SPELLINGS = {
    1: "واحد واحدة الأول الأولى الحادي الحادية", 2: "اثنان اثنين اثنتان اثنتين الثاني الثانية", 3: "ثلاث ثلاثة الثالث الثالثة",
    4: "أربع أربعة الرابع الرابعة", 5: "خمس خمسة الخامس الخامسة", 6: "ست ستة السادس السادسة", 7: "سبع سبعة السابع السابعة",
    8: "ثمان ثماني ثمانية الثامن الثامنة", 9: "تسع تسعة التاسع التاسعة", 10: "عشر عشرة العاشر العاشرة",
    20: "عشرون عشرين العشرون العشرين", 30: "ثلاثون ثلاثين الثلاثون الثلاثين", 40: "أربعون أربعين الأربعون الأربعين",
    50: "خمسون خمسين الخمسون الخمسين", 60: "ستون ستين الستون الستين", 70: "سبعون سبعين السبعون السبعين",
    80: "ثمانون ثمانين الثمانون الثمانين", 90: "تسعون تسعين التسعون التسعين", 100: "مائة مئة المائة المئة",
}
NUMBER_WORDS = {plain(w): n for n, ws in NUMBER_SPELLINGS.items() for w in ws.split()}


def digit_numbers(c: Column) -> Column:
    """Numbers written in digits of either script: thousands marks dropped, decimal commas read."""
    own = F.regexp_replace(F.regexp_replace(for_comparison(F.translate(c, "٫", ".")), r"(?<=\d),(?=\d{3}(?!\d))", ""), r"(?<=\d),(?=\d{1,2}(?!\d))", ".")
    return F.transform(F.regexp_extract_all(own, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def word_numbers(c: Column) -> Column:
    """Numbers written in words: a run of number words adds up, anything else ends it."""
    values = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    tokens = F.concat(F.regexp_extract_all(for_comparison(c), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), 1), F.array(F.lit("")))
    bare = lambda t: F.when(t.rlike("^[وب]"), F.substring(t, 2, 1_000))
    value = lambda t: F.coalesce(F.try_element_at(values, t), F.try_element_at(values, F.coalesce(bare(t), F.lit(""))), F.lit(0))
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<double>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        v = value(t)
        ended = (v == 0) & (acc["run"] > 0)
        return F.struct(F.when(v > 0, acc["run"] + v).otherwise(0).alias("run"), F.when(ended, F.concat(acc["found"], F.array(acc["run"].cast("double")))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(tokens, start, step, lambda acc: acc["found"])


def numbers(c: Column) -> Column:
    """All numbers of a text, those in digits first."""
    return F.concat(digit_numbers(c), word_numbers(c))


def states_number(c: Column, expected: Column) -> Column:
    """Whether the text has the number outside its citations."""
    return F.exists(numbers(F.regexp_replace(c, r"\[\d+(?:\s*[,،]\s*\d+)*\]", " ")), lambda x: F.abs(x - expected) < 1e-9)


def text_key(kind: Column, text: Column) -> Column:
    """The key of a stored vector or score: 24 hex digits of a hash of kind and text."""
    return F.substring(F.sha2(F.concat(kind.cast("binary"), F.lit(bytearray(b"\x00")), text.cast("binary")), 256), 1, 24)


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 2.5).cast("int")


# Markdown's markup, in the order in which it goes, and what stays of it.
MARKUP = [
    (r"(?i)<br\s*/?>", "\n"), (r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", ""), (r"(?m)^[ \t]*#{1,6}[ \t]+", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"\*\*|__", ""),
    (r"\*(?=\S)(.+?)(?<=\S)\*", r"\1"), (r"\$([^$\n]+)\$", r"\1"),
]
_MARKUP = [(re.compile(p), to) for p, to in MARKUP]
#: An escaped mark is text: while markup goes it stands in a private plane.
_ESCAPED, _PLANE = re.compile(r"\\([!-/:-@\[-`{-~])"), 0xF0000
_BACK = {_PLANE + c: chr(c) for c in range(0x21, 0x7F)}


def markdown_plain(markdown: str) -> str:
    """What a Markdown text prints: markup off, escaped marks kept, entities read."""
    held = _ESCAPED.sub(lambda m: chr(_PLANE + ord(m.group(1))), markdown)
    for pattern, to in _MARKUP:
        held = pattern.sub(to, held)
    return html.unescape(held.translate(_BACK)).strip()


def _markdown(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else markdown_plain(t))


def markdown_text(c: Column) -> Column:
    """``markdown_plain`` over a column; a text without markup stays in the JVM."""
    # a function in Python is given every row: texts without markup go there as nulls
    marked = c.rlike(r"[\\<*_$&]|(?m)^[ \t]*(?:#{1,6}|[-+])[ \t]")
    return F.when(marked, F.pandas_udf(_markdown, "string")(F.when(marked, c))).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
