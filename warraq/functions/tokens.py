"""Tokenizers and the light stemmer, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import WORD, collapse_whitespace, for_comparison, plain

# Words that questions and texts are full of, in the spellings people use.
STOPWORD_SPELLINGS = (
    "من إلى الى عن على في مع و أو او ثم بل لكن أن إن ان كان كانت يكون تكون هذا هذه "
    "ذلك تلك هؤلاء الذي التي الذين ما ماذا لا لم لن ليس قد كل بعض أي اي غير هو هي هم "
    "أنا انا نحن أنت انت كما حيث إذا اذا عند عندما حتى بين لدى له لها لهم به بها فيه "
    "فيها منه منها عليه عليها إليه اليه هل كيف متى أين اين لماذا كم لو لي "
    "وش ايش شو ليش وين ابغى ابي ابغي أبغى أبي طيب يعني احنا اقدر أقدر عشان"
)
STOPWORDS = sorted({plain(w) for w in STOPWORD_SPELLINGS.split()})
# The light stemmer's prefixes (the first that fits goes) and suffixes (each that fits goes, in order).
PREFIXES = ("ال", "وال", "بال", "كال", "فال", "لل", "و")
SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ه", "ي")


def light_stem(c: Column) -> Column:
    """The stem of a normalized word: one prefix, then suffixes in order, two letters staying at least (three after a lone و)."""
    long_ = "|".join(p for p in PREFIXES if len(p) > 1)
    stem = F.regexp_replace(c, f"^(?:(?:{long_})(?=.{{2}})|و(?=.{{3}}))", "")
    for s in SUFFIXES:
        stem = F.regexp_replace(stem, f"^(.{{2,}}){s}$", "$1")
    return stem


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def terms(c: Column, normalize: bool = True, stopwords: bool = True, stem: bool = True) -> Column:
    """The index terms of a text; each step can be switched off."""
    found = words(F.lower(for_comparison(c) if normalize else c))
    if stopwords:
        found = F.filter(found, lambda w: ~w.isin(STOPWORDS))  # a hash set in the plan
    return F.transform(found, lambda w: F.when(w.rlike("[ء-ي]"), light_stem(w)).otherwise(w)) if stem else found


def evidence_words(c: Column) -> Column:
    """Letter runs and digit runs of the compared text, apart, with one space around each."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(for_comparison(c), F.lit(r"(\p{Nd}+|[\p{L}\p{Nl}\p{No}]+)"), 1), " "), F.lit(" "))


def arabic_tokens(c: Column) -> Column:
    """Runs of Arabic letters of the compared text."""
    return F.regexp_extract_all(for_comparison(c), F.lit("([ء-غف-ي]+)"), 1)


def marked_words(c: Column) -> Column:
    """Runs of letters, marks and numbers."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)


def word_count(c: Column) -> Column:
    """Tokens between white space that hold a letter or a digit."""
    return F.size(F.filter(F.split(collapse_whitespace(c), " "), lambda t: t.rlike(r"[\p{L}\p{N}_]")))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(for_comparison(c)))


def paragraphs(c: Column) -> Column:
    return F.split(c, r"\n\s*\n")


def unread_paragraphs(text: Column, blocks: Column, share: float = 0.8) -> Column:
    """Paragraphs of a reading of whose words no block holds the share."""

    def held(p: Column) -> Column:
        own = word_set(p)
        return F.exists(blocks, lambda b: F.size(F.array_intersect(own, word_set(b))) >= share * F.size(own))

    return F.filter(paragraphs(text), lambda p: (F.size(word_set(p)) > 0) & ~held(p))


def query_lines(c: Column, most: int = 3) -> Column:
    """The queries written one a line in a reply: list marks and quotes off, each once, at most so many."""
    line = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[-*•]|\d{1,2}[.)](?!\d))\s*", ""), "^[\"'«“]+|[\"'»”]+$", ""))
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(c, "\n"), line), lambda x: F.length(x) > 0)), 1, most)
