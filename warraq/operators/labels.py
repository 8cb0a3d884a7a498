"""Labels of articles and numbered parts, as a small grammar over classes of tokens.

A line's tokens are brought to one letter each (article word, ordinal, colon,
referring word and so on); what is a label is then a regular expression over these
letters, and the places of its match are the tokens of the label.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import plain
from .structure import fill_forward


class Label(NamedTuple):
    label: str
    number: int
    rest: str
    certain: bool


# Ordinal words and what each adds to an article's number.
ORDINAL_SPELLINGS = {
    1: "الأولى الأول الحادية الحادي", 2: "الثانية الثاني", 3: "الثالثة الثالث", 4: "الرابعة الرابع", 5: "الخامسة الخامس", 6: "السادسة السادس",
    7: "السابعة السابع", 8: "الثامنة الثامن", 9: "التاسعة التاسع", 10: "العاشرة العاشر عشرة عشر", 20: "العشرون العشرين", 30: "الثلاثون الثلاثين",
    40: "الأربعون الأربعين", 50: "الخمسون الخمسين", 60: "الستون الستين", 70: "السبعون السبعين", 80: "الثمانون الثمانين", 90: "التسعون التسعين", 100: "المائة المئة",
}
ORDINALS = {plain(w): n for n, ws in ORDINAL_SPELLINGS.items() for w in ws.split()}
# Words after which an article is referred to, and names of numbered parts.
REFERRING = {plain(w) for w in "في من وفق وفقا حسب بحسب بموجب لأحكام نص نصت".split()}
PARTS = {plain(w) for w in "أولا ثانيا ثالثا رابعا خامسا سادسا سابعا ثامنا تاسعا عاشرا".split()}
# The article's word, how far a label's number may lie past the last one, and how many words a part may have.
ARTICLE, ARTICLE_GAP, PART_WORDS = plain("المادة"), 3, 8

_EDGES = re.compile(r"^[:-]+|[:-]+$")


def ordinal(word: str) -> int:
    """What an ordinal word adds, alone or joined to the one before it by "and"; 0 for any other word."""
    bare = _EDGES.sub("", word)
    return next((ORDINALS[w] for w in (bare, bare[1:] if bare[:1] == "و" else bare) if w in ORDINALS), 0)


def _letter(shown: str) -> str:
    """The class of a token: A article, n ordinal, N ordinal before a colon, m mark, C colon, u unseen, b bracket, r referring, w any other."""
    seen = plain(shown)
    if not seen:
        return "u"
    if seen in (":", "-"):
        return "C" if shown.endswith(":") else "m"
    if "(" in seen or ")" in seen:
        return "b"
    if seen.lstrip("-") == ARTICLE:
        return "A"
    if ordinal(seen):
        return "N" if shown.endswith(":") else "n"
    return "r" if seen in REFERRING else "w"


_NAME = "A[nN]{1,3}+[Cmu]*"
#: At the end of a line: alone, or after a word that neither has a bracket nor, unless a colon follows, refers to it.
_CLOSING = re.compile(rf"^(?:u*|.*[^urb]u*|.*ru*(?=A[nNCmu]*[CN]$))(?P<name>{_NAME})$")
#: At the start of a line, before a colon and more.
_OPENING = re.compile(r"^(?P<name>A[nN]{1,3}+[Cmu]*(?<=[CN]))(?=[^Cmu])")


def article_label(text: str) -> Label | None:
    """The label of an article that a line is, begins or ends with; None for a mention of one."""
    shown = text.split()
    letters = "".join(map(_letter, shown))
    m = _OPENING.match(letters) or _CLOSING.match(letters)
    if not m:
        return None
    a, b = m.span("name")
    colon = letters[b - 1] in "CN"
    number = sum(ordinal(plain(t)) for t, x in zip(shown[a:b], letters[a:b]) if x in "nN")
    rest = shown[b:] if b < len(shown) else shown[:a]
    return Label(" ".join(shown[a:b]), number, " ".join(rest), colon or not letters[:a].strip("u"))


def numbered_part(text: str) -> tuple[str, str] | None:
    """(what stands before, the part) of a line that ends in a short numbered part."""
    shown = text.split()
    seen = list(map(plain, shown))
    # P: a part's name with its colon, p: without; c: a token that a colon opens
    letters = "".join("P" if w.endswith(":") and w.rstrip(":") in PARTS else "p" if w in PARTS else "c" if t.startswith(":") else "w" for t, w in zip(shown, seen))
    m = re.search(rf"(?:P|p(?=c)).{{0,{PART_WORDS - 1}}}$", letters)
    return (" ".join(shown[: m.start()]), " ".join(shown[m.start() :])) if m else None


def _found(text: pd.Series) -> pd.DataFrame:
    made = [article_label(t) or (None, None, None, None) if t else (None, None, None, None) for t in text]
    return pd.DataFrame(made, columns=["label", "number", "rest", "certain"]).astype({"number": "Int32", "certain": "boolean"})


def article_labels(text: Column | str) -> Column:
    """``article_label`` over a column; null where there is none."""
    return F.pandas_udf(_found, "struct<label:string,number:int,rest:string,certain:boolean>")(text)


def _parts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([numbered_part(t) or (None, None) if t else (None, None) for t in text], columns=["rest", "part"])


def numbered_parts(text: Column | str) -> Column:
    """``numbered_part`` over a column; null where there is none."""
    return F.pandas_udf(_parts, "struct<rest:string,part:string>")(text)


def counted(labels: DataFrame, doc: str = "doc_id", page: str = "page", at: str = "seq") -> DataFrame:
    """Adds ``accepted``: whether a label (doc, page, at, number, certain) heads an article, going by the last one accepted.

    A certain label, or the first article's, is always accepted; another if its number is one to ``ARTICLE_GAP`` past the last.
    These always accepted ones start anew whatever came before, so only the stretches between them are read in order: each
    is a fold in the JVM, keyed by the label that it starts from, which is carried over pages by a row a page.
    """
    sure = F.col("certain") | (F.col("number") == 1)
    start = F.when(sure, F.struct(F.col(page).cast("long").alias("p"), F.col(at).alias("s")))
    own = fill_forward(labels.withColumn("_sure", sure).withColumn("_start", start), "_start", doc, page, at)
    row = F.struct(F.col(page).cast("long").alias("p"), F.col(at).alias("s"), F.col("number").cast("int").alias("n"), F.col("_sure").alias("sure"))
    stretch = own.groupBy(doc, "filled").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    state = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["sure"] | ((x["n"] > acc["last"]) & (x["n"] <= acc["last"] + ARTICLE_GAP))
        return F.struct(F.when(fits, x["n"]).otherwise(acc["last"]).alias("last"), F.concat(acc["taken"], F.array(fits.cast("int"))).alias("taken"))

    taken = F.aggregate("rows", state, step, lambda acc: acc["taken"])
    each = stretch.select(F.col(doc).alias("_d"), F.explode(F.arrays_zip("rows", taken.alias("taken"))).alias("x"))
    decided = each.select("_d", F.col("x.rows.p").alias("_p"), F.col("x.rows.s").alias("_s"), (F.col("x.taken") == 1).alias("accepted"))
    both = labels.join(decided, (F.col(doc) == F.col("_d")) & (F.col(page).cast("long") == F.col("_p")) & (F.col(at) == F.col("_s")))
    return both.select(*labels.columns, "accepted")
