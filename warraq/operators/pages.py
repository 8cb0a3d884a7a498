"""Pages to lines of known kinds, and lines to units.

A page is read from its layout blocks where an engine gave some, else from its
text.  What a line is follows from equi-joins (manual tables, running lines,
entries of the contents page) and column expressions; articles' labels are
accepted in order by ``labels.counted``.  Order matters within a page only, and
the heading in force goes from page to page by a row a page, so a document may
have any number of pages.

Pages: doc_id, page, text, blocks (array of struct(category, text, html), or
null).  Null and wordless texts give no lines.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.normalize import collapse_whitespace, for_comparison
from ..functions.tokens import word_count
from . import labels
from .structure import fill_forward
from .tables import table_sentences

# What engines call a block, and the most words of a heading.
HEADING, LEFT_OUT, LIST, TABLE, HEADING_WORDS = ("Title", "Section-header"), ("Page-header", "Page-footer", "Picture", "Formula"), "List-item", "Table", 15
# Words of the contents page's own labels.
CONTENTS_LABELS = ("الفهرس", "الصفحة", "المحتويات")
BLOCKS = "array<struct<category:string,text:string,html:string>>"


def _worded(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\p{L}\p{N}_]"), F.lit(False))


def lines_of(pages: DataFrame) -> DataFrame:
    """(doc_id, page, block, line, category, text, told): each line; ``told`` is heading or table where the layout says so.

    A table block is one line of its rows, a row a line feed; blocks that print no text of the page's own are left out.
    """
    laid = F.coalesce(F.size("blocks"), F.lit(0)) > 0
    plain = pages.where(~laid).select("doc_id", "page", F.lit(0).alias("block"), F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc_id", "page", "block", "line", F.lit(None).cast("string").alias("category"), "text", F.lit(None).cast("string").alias("told"))
    b = pages.where(laid).select("doc_id", "page", F.posexplode("blocks").alias("block", "b")).select("doc_id", "page", "block", "b.category", "b.text", "b.html")
    b = b.where(_worded(F.col("text")) & ~F.coalesce(F.col("category").isin(*LEFT_OUT), F.lit(False)))
    kind = F.when(F.col("category") == TABLE, "table").when(F.col("category").isin(*HEADING) & (word_count(F.col("text")) <= HEADING_WORDS), "heading")
    b = b.withColumn("told", kind)
    rows = F.when(F.size(F.coalesce(table_sentences("html"), F.array().cast("array<string>"))) > 0, table_sentences("html")).otherwise(F.transform(F.split("text", "\n"), collapse_whitespace))
    tables = b.where("told = 'table'").select("doc_id", "page", "block", F.lit(0).alias("line"), "category", F.array_join(F.filter(rows, lambda r: r != ""), "\n").alias("text"), "told")
    heads = b.where("told = 'heading'").select("doc_id", "page", "block", F.lit(0).alias("line"), "category", collapse_whitespace(F.col("text")).alias("text"), "told")
    rest = b.where("told is null").select("doc_id", "page", "block", "category", "told", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc_id", "page", "block", "line", "category", "text", "told")
    return plain.unionByName(tables).unionByName(heads).unionByName(rest)


def contents_entries(lines: DataFrame, contents: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """(doc_id, line): the entries of documents' contents pages, as compared, without running lines and the page's own labels.

    lines: doc_id, page, text; contents: doc_id, contents_page; boilerplate: doc_id, line.
    """
    own = lines.join(contents.select("doc_id", F.col("contents_page").alias("page")), ["doc_id", "page"]).select("doc_id", for_comparison(F.col("text")).alias("line"))
    named = F.arrays_overlap(F.split("line", " "), F.array(*(F.lit(w) for w in map(labels.plain, CONTENTS_LABELS))))
    return own.where(F.col("line").rlike("[ء-ي]") & ~named).join(boilerplate.select("doc_id", "line"), ["doc_id", "line"], "left_anti").distinct()


def classified(lines: DataFrame, boilerplate: DataFrame, contents: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, seq, kind, text, starts, clause, clause_no, manual): what every line is, in its order on the page (seq).

    kind: stop, heading, table or unit.  Empty and running lines are gone.  A label or part with more on its line gives a
    heading and then a unit's line.  boilerplate and contents: doc_id, line; manual: doc_id, page, table_no, replaces
    (array), text: a table takes the place of the first line that it stands for, and the others go.
    """
    seq = F.struct("block", "line", F.lit(0).alias("part"))
    own = lines.where(_worded(F.col("text"))).withColumn("seq", seq)
    own = own.withColumn("text", F.when(F.col("told") == "table", F.col("text")).otherwise(collapse_whitespace(F.col("text"))))
    # worked out once: lines are looked up by it, and tables are never
    seen = F.explode_outer(F.array(F.when(F.coalesce(F.col("told") != "table", F.lit(True)), for_comparison(F.col("text")))))
    own = own.withColumn("seen", seen).withColumn("probe", F.when(F.col("told").isNull(), F.col("seen")))
    own = own.join(boilerplate.select("doc_id", F.col("line").alias("probe")).distinct(), ["doc_id", "probe"], "left_anti")
    own = own.join(contents.select("doc_id", F.col("line").alias("probe"), F.lit(True).alias("entry")).distinct(), ["doc_id", "probe"], "left")
    if manual is not None:
        gone = manual.select("doc_id", "page", "table_no", F.col("text").alias("typed"), F.explode("replaces").alias("r")).select("doc_id", "page", "table_no", "typed", for_comparison(F.col("r")).alias("probe")).dropDuplicates(["doc_id", "page", "probe"])
        own = own.join(gone, ["doc_id", "page", "probe"], "left")
        first = F.row_number().over(Window.partitionBy("doc_id", "page", "table_no").orderBy("seq"))
        own = own.withColumn("_n", F.when(F.col("table_no").isNotNull(), first)).where("_n is null or _n = 1")
        own = own.withColumn("text", F.coalesce("typed", "text")).withColumn("told", F.when(F.col("table_no").isNotNull(), "table").otherwise(F.col("told"))).withColumn("manual", F.col("table_no").isNotNull())
    else:
        own = own.withColumn("manual", F.lit(False))
    numbers = F.col("told").isNull() & F.col("probe").rlike(r"^\d{1,2}( \d{1,2})*$")
    open_ = F.col("told").isNull() & ~numbers & F.col("entry").isNull()
    # only lines that hold the article's word go through Python; a heading of the layout counts as certain
    asks = (open_ | (F.col("told") == "heading")) & F.coalesce(F.col("seen").contains(labels.ARTICLE), F.lit(False))
    own = own.withColumn("l", F.when(asks, labels.article_labels(F.when(asks, F.col("text")))))
    own = own.persist(StorageLevel.DISK_ONLY)  # read by the order of labels, and again with it
    found = own.where("l.label is not null").select("doc_id", "page", "seq", F.col("l.number").alias("number"), (F.col("l.certain") | (F.col("told") == "heading")).alias("certain"))
    found = found.withColumn("certain", F.coalesce("certain", F.lit(False)))
    taken = labels.counted(found).where("accepted").select("doc_id", "page", "seq", F.lit(True).alias("accepted"))
    own = own.join(taken, ["doc_id", "page", "seq"], "left")
    may = open_ & F.col("accepted").isNull() & F.coalesce(F.col("probe").rlike("|".join(sorted(labels.PARTS))), F.lit(False))
    own = own.withColumn("p", F.when(may, labels.numbered_parts(F.when(may, F.col("text")))))
    label = open_ & F.col("accepted").isNotNull()
    part = open_ & F.col("p.part").isNotNull()
    kind = F.when(F.col("told").isNotNull(), F.col("told")).when(numbers, "stop").when(F.col("entry").isNotNull() | label | part, "heading").otherwise("unit")
    shown = F.when(label, F.col("l.label")).when(part, F.col("p.part")).otherwise(F.col("text"))
    rest = F.when(label, F.col("l.rest")).when(part, F.col("p.rest"))
    both = F.array(F.struct(kind.alias("kind"), shown.alias("text"), F.lit(0).alias("part"), F.lit(False).alias("starts")), F.struct(F.lit("unit").alias("kind"), rest.alias("text"), F.lit(1).alias("part"), F.lit(True).alias("starts")))
    each = own.select("doc_id", "page", "block", "line", "category", "manual", F.explode(F.filter(both, lambda x: x["text"].isNotNull() & (x["text"] != ""))).alias("x"))
    each = each.select("doc_id", "page", "block", "category", "manual", F.struct("block", "line", F.col("x.part").alias("part")).alias("seq"), "x.kind", "x.text", "x.starts")
    unit = F.col("kind") == "unit"
    no = F.when(unit, T.clause_number(F.col("text")))
    clause = unit & (no.isNotNull() | T.bulleted(F.col("text")))
    each = each.withColumn("clause_no", no.cast("string")).withColumn("clause", clause)
    # the first line of a unit in a layout block starts one, and is a clause if the block is a list's item
    opens = F.col("category").isNotNull() & unit & (F.col("seq") == F.min(F.when(unit, F.col("seq"))).over(Window.partitionBy("doc_id", "page", "block")))
    each = each.withColumn("_opens", opens).withColumn("starts", F.col("starts") | F.col("clause") | F.col("_opens")).withColumn("clause", F.col("clause") | (F.col("_opens") & (F.col("category") == LIST)))
    return each.select("doc_id", "page", "seq", "kind", "text", "starts", "clause", "clause_no", "manual")


def units(classified_lines: DataFrame) -> DataFrame:
    """(doc_id, page, unit_no, heading, content_type, lines, clause_no, manual): the units of pages, each under the heading in force."""
    heading = F.when(F.col("kind") == "heading", T.trimmed_heading(F.col("text")))
    classified_lines = classified_lines.persist(StorageLevel.DISK_ONLY)
    own = fill_forward(classified_lines.withColumn("_heading", heading), "_heading").withColumnRenamed("filled", "heading")
    page = Window.partitionBy("doc_id", "page").orderBy("seq")
    begins = F.col("kind").isin("unit", "table") & (F.col("starts") | (F.col("kind") == "table") | (F.coalesce(F.lag("kind").over(page), F.lit("stop")) != "unit"))
    own = own.withColumn("unit_no", F.sum(begins.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("kind").isin("unit", "table"))
    line = F.struct("seq", "text", "kind", "clause", "clause_no", "heading", "manual")
    made = own.groupBy("doc_id", "page", "unit_no").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    first = F.element_at("rows", 1)
    article = F.coalesce(for_comparison(first["heading"]).startswith(labels.ARTICLE), F.lit(False))
    kind = F.when(first["kind"] == "table", "table").when(first["clause"] | article, "clause").otherwise("prose")
    texts = F.transform("rows", lambda r: r["text"])
    return made.select("doc_id", "page", "unit_no", first["heading"].alias("heading"), kind.alias("content_type"), F.when(first["kind"] == "table", F.split(first["text"], "\n")).otherwise(texts).alias("lines"), first["clause_no"].alias("clause_no"), first["manual"].alias("manual"))
