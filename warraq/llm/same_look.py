"""Texts that look the same in different characters (problem 2).

Every text is brought to one form (see ``look``): the vocabulary's trie is walked
by the zero-cost edit automaton, tokens that it doesn't hold are normalised by
table.  Texts of one document with equal forms look the same; of these, the pairs
with different characters are found by an equi-join on (document, hash of the
form), after all classes with a single spelling have been dropped by a
map-side-combined aggregate.  A document with a third of all rows is spread by
the form's hash, and a form with very many rows by its parts.

Null texts look like nothing and are in no pair; two empty texts are equal, not a
pair; a null doc_id is no document.  Copies of a row (same id) count once.
"""

from __future__ import annotations

import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lexicon, arrow_map, once, sent, with_rest
from .look import LookForm, answered_readings, asked_readings


#: Rows of a class that meet the whole class in one task.
TOGETHER = 1000


def forms(items: DataFrame, words: Lexicon | list[str], keep_text: bool = False) -> DataFrame:
    """Each item's form: kind, doc_id, item_id and either the form itself or 128-bit hashes of text and form."""
    own = sent(words)

    def start():
        look = once(LookForm, own)

        def work(c: dict) -> dict:
            out = {k: c[k] for k in ("kind", "doc_id", "item_id")}
            made = [look.also(rest).text(t) for t, rest in zip(c["text"], c["rest_words"])]
            if keep_text:
                return out | {"form": made, "changed": [None if t is None else f != t for t, f in zip(c["text"], made)]}
            digest = lambda s: None if s is None else xxhash.xxh3_128_digest(s)
            return out | {"form": list(map(digest, made)), "spelt": list(map(digest, c["text"]))}

        return work

    schema = "kind string, doc_id string, item_id long, " + ("form string, changed boolean" if keep_text else "form binary, spelt binary")
    plain = items.select("kind", "doc_id", "item_id", "text")
    plain = with_rest(plain, ["kind", "item_id"], words, lambda: lambda c: (asked_readings([t]) for t in c["text"]), answered_readings)
    return arrow_map(plain.select("kind", "doc_id", "item_id", "text", "rest_words"), start, schema)


def unit_texts(units: DataFrame) -> DataFrame:
    return units.select(F.lit("unit").alias("kind"), F.col("doc_id").cast("string").alias("doc_id"), F.col("unit_id").cast("long").alias("item_id"), "text")


def calendar_texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("calendar_row").alias("kind"), F.col("doc_id").cast("string").alias("doc_id"), F.col("row_id").cast("long").alias("item_id"), F.col("title_ar").alias("text"))


def pairs(items: DataFrame, words: Lexicon | list[str]) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b: rows of one document that look the same and differ in their characters."""
    made = forms(items.where("doc_id is not null and text is not null and item_id is not null"), words).persist(StorageLevel.MEMORY_AND_DISK)
    key = ["kind", "doc_id", "form"]
    several = made.groupBy(*key).agg(F.min("spelt").alias("a"), F.max("spelt").alias("b"), F.count("*").alias("n")).where("a < b").select(*key, F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts"))
    members = made.join(several, key).distinct()
    # a large class is parted: each part of its rows meets all of them in a task of its own
    a = members.withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")).drop("parts").withColumnRenamed("item_id", "id_a")
    b = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumnRenamed("item_id", "id_b").withColumnRenamed("spelt", "other")
    return a.join(b, [*key, "part"]).where("id_a < id_b and spelt <> other").select("kind", "id_a", "id_b").distinct()


def classes(items: DataFrame, words: Lexicon | list[str]) -> DataFrame:
    """(kind, doc_id, item_id, class_id, members, spellings): each item of a document that looks like another, with its class.

    ``class_id`` is the class's least id.  A row an item, however large a class is: pairs grow with the square of it.
    """
    made = forms(items.where("doc_id is not null and text is not null and item_id is not null"), words).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    key = ["kind", "doc_id", "form"]
    spelt = made.groupBy(*key, "spelt").agg(F.count("*").alias("n"), F.min("item_id").alias("least"))
    of = spelt.groupBy(*key).agg(F.min("least").alias("class_id"), F.sum("n").alias("members"), F.count("*").alias("spellings")).where("members > 1")
    return made.join(of, key).select("kind", "doc_id", "item_id", "class_id", "members", "spellings")


def canonical(items: DataFrame, words: Lexicon | list[str]) -> DataFrame:
    """(kind, item_id, form, changed): each item once, in the one consistent form."""
    return forms(items.dropDuplicates(["kind", "item_id"]), words, keep_text=True).select("kind", "item_id", "form", "changed")
