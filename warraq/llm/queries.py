"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import mixing, packing, reading_level, repeated_lines, reply_defects, same_look, scan_repair, splitting
from .common import Lexicon, vocabulary, written


def _words(spark: SparkSession, d: str) -> Lexicon:
    return vocabulary(table(spark, d, "lexicon"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.unit_items(table(spark, d, "units")).unionByName(repeated_lines.document_items(table(spark, d, "documents")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every repeated line of units and documents."""
    return repeated_lines.find(_items(spark, d), _words(spark, d))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Units and documents without their repeated lines."""
    return repeated_lines.without(_items(spark, d), _words(spark, d)).select("kind", "item_id", F.array_join("lines", "\n").alias("text"), "removed")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return same_look.unit_texts(table(spark, d, "units")).unionByName(same_look.calendar_texts(table(spark, d, "calendar_rows")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one document that look the same in different characters."""
    return same_look.pairs(_texts(spark, d), _words(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Texts of one document that look alike, by class."""
    return same_look.classes(_texts(spark, d), _words(spark, d))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every unit text and calendar title in the one consistent form."""
    return same_look.canonical(_texts(spark, d), _words(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken and misread words, running lines and page numbers of scanned pages, units and drafts."""
    return scan_repair.find(table(spark, d, "units"), table(spark, d, "readings"), table(spark, d, "drafts"), _words(spark, d))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Continuous paragraphs of readings, scanned units and their drafts."""
    units, readings, words = table(spark, d, "units"), table(spark, d, "readings"), _words(spark, d)
    items = scan_repair.unit_items(units).unionByName(scan_repair.reading_items(readings))
    labels = written(scan_repair.labelled(items, words))
    made = written(scan_repair.paragraphs(items, words, labels))
    of_drafts = scan_repair.draft_paragraphs(units, readings, table(spark, d, "drafts"), made, labels, words)
    return made.unionByName(of_drafts).select("kind", "item_id", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective replies and their defects."""
    return reply_defects.find(table(spark, d, "exchanges"), _words(spark, d))


def _sized_items(spark: SparkSession, d: str) -> DataFrame:
    return splitting.unit_items(table(spark, d, "units")).unionByName(splitting.draft_items(table(spark, d, "drafts")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Units and drafts that have to be cut."""
    pieces = splitting.pieces(_sized_items(spark, d), table(spark, d, "split_limits"))
    return pieces.where("piece_no = 1").select("kind", "item_id")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of units and drafts that are too long."""
    return splitting.pieces(_sized_items(spark, d), table(spark, d, "split_limits"))


def p5_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of every item that was cut, counted over its pieces without what they repeat."""
    p = p5_pieces(spark, d)
    return p.groupBy("kind", "item_id").agg(F.sum(F.col("n_words") - F.col("overlap")).cast("long").alias("words"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or piece of one, for each kind of container."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.fill(p6_containers(spark, d), table(spark, d, "containers"))


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each kind: documents placed, containers over their capacity, and documents cut without need."""
    placed, kinds = p6_containers(spark, d), table(spark, d, "containers")
    per = placed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    docs = per.join(kinds, "container_kind").groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if((F.col("n") <= F.col("capacity_tokens")) & (F.col("pieces") > 1)).alias("cut"))
    used = placed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items")).join(kinds, "container_kind")
    over = used.groupBy("container_kind").agg(F.count_if(F.col("n") + (F.col("items") - 1) * F.col("separator_tokens") > F.col("capacity_tokens")).alias("overfull"))
    return docs.join(over, "container_kind").select("container_kind", "documents", "overfull", "cut")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents that make the mixture, and how often each is used."""
    return mixing.select(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of the mixture that each source reached."""
    return mixing.shares(p7_selection(spark, d), table(spark, d, "mix_targets"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Of each listed source: whether it takes part, and whether it has its share and no document was used too often.

    A share is had if it is within half a point, or within one document, as none is cut.
    """
    chosen, targets = p7_selection(spark, d), table(spark, d, "mix_targets")
    largest = chosen.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    got = mixing.shares(chosen, targets).join(mixing.listed(targets).select("source", "max_repeats"), "source").join(largest, "source", "left")
    one = F.col("largest") * F.col("of_aim") / F.col("tokens")
    fits = (F.col("most_uses") <= F.col("max_repeats")) & ((F.col("tokens") == 0) | (F.abs(F.col("of_aim") - F.col("target_share")) < F.greatest(F.lit(0.005), one)))
    return got.select("source", (F.col("tokens") > 0).alias("used"), F.coalesce(fits, F.lit(True)).alias("kept"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document."""
    return reading_level.levels(table(spark, d, "documents"), table(spark, d, "level_samples"), _words(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents most of whose own words stand in sentences of level 4 or 5."""
    return p8_levels(spark, d).where("hard_words * 2 > words").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_clean, p2_found, p2_classes, p2_canonical, p3_found, p3_paragraphs, p4_found, p5_found, p5_pieces, p5_words, p6_containers, p6_fill, p6_whole, p7_selection, p7_shares, p7_kept, p8_found, p8_levels)
}
_WORDS = r"""
        with items as (
            select distinct 'unit' as kind, unit_id as item_id, content_type, text from units
            union
            select distinct 'draft', draft_id, content_type, array_to_string(texts, chr(10)) from drafts
        ), sized as (
            select i.kind, i.item_id, max_words,
                   len(list_filter(regexp_extract_all(text, '[^\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'),
                                   lambda w: regexp_matches(w, '[\p{L}\p{N}_]'))) as words
            from items i join split_limits l using (content_type)
        )
"""
SQL: dict[str, str] = {
    # the operator counts the words of an item to cut it; which items are too long is plain SQL
    "p5_found": _WORDS + "select kind, item_id from sized where words > max_words",
    # a round trip: pieces without what they repeat have the item's words
    "p5_words": _WORDS + "select kind, item_id, words from sized where words > max_words",
    # what must hold of any packing
    "p6_whole": """
        select container_kind, (select count(distinct doc_id) from documents where length(text) > 0) as documents, 0 as overfull, 0 as cut
        from containers where capacity_tokens > 0
    """,
    # what must hold of a mixture
    "p7_kept": "select source, exists (select 1 from documents d where d.source = t.source and length(text) > 0) as used, true as kept from mix_targets t",
}
