"""Operators on inputs that the tables don't hold, each with the rows that are to come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, tokens
from ..operators import answers, calendars, evaluation, flow, gold, labels, layout, pages, quality, stores, structure, tables
from ..sources import engines, readers, sinks
from ..streaming import logs
from .registry import golden

# ------------------------------------------------------------------ labels, lines, units

_LINES = [
    "المادة الحادية عشرة", "المادة الثانية والعشرون:", "المادة السادس والأربعون: يلتزم الطالب", "وفق المادة (العاشرة)", "نصت المادة الخامسة", "أحكام عامة المادة الثالثة", "المادة الرابعة من اللائحة", "(المادة الأولى",
]


@golden("i, label, number, rest, certain", [(0, _LINES[0], 11, "", True), (1, _LINES[1], 22, "", True), (2, "المادة السادس والأربعون:", 46, "يلتزم الطالب", True), (5, "المادة الثالثة", 3, "أحكام عامة", False)])
def article_labels(spark):
    """Articles' labels, and mentions that are none."""
    df = spark.createDataFrame(list(enumerate(_LINES)), "i int, line string")
    return df.select("i", labels.article_labels("line").alias("l")).where("l.label is not null").select("i", "l.label", "l.number", "l.rest", "l.certain")


@golden("i, rest, part", [(0, "", "ثانياً: الجزاءات والغرامات"), (1, "أحكام", "أولاً : مدة الإعارة")])
def numbered_parts(spark):
    """Short numbered parts that end a line."""
    lines = ["ثانياً: الجزاءات والغرامات", "أحكام أولاً : مدة الإعارة", "أولاً يلتزم الطالب", "ثالثاً: واحد اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    return df.select("i", labels.numbered_parts("line").alias("p")).where("p.part is not null").select("i", "p.rest", "p.part")


@golden("page, seq, number, accepted", [(1, 1, 6, False), (1, 2, 1, True), (1, 3, 4, True), (2, 1, 9, False), (2, 2, 7, True), (3, 1, 72, True), (3, 2, 75, True), (4, 1, 3, True), (4, 2, 72, False)])
def articles_counted(spark):
    """Labels taken in order: uncertain ones within three of the last, certain ones and the first article always."""
    rows = [(1, 1, 6, False), (1, 2, 1, False), (1, 3, 4, False), (2, 1, 9, False), (2, 2, 7, False), (3, 1, 72, True), (3, 2, 75, False), (4, 1, 3, True), (4, 2, 72, False)]
    df = spark.createDataFrame(rows, "page int, seq int, number int, certain boolean").withColumn("doc_id", F.lit("d"))
    return labels.counted(df).select("page", "seq", "number", "accepted")


def _pages(spark):
    cell = lambda c, t, h=None: (c, t, h)
    rows = [
        ("d", 1, "الفهرس\nالقبول والتسجيل\nنشرة القسم", None),
        ("d", 2, "نشرة القسم\nالقبول والتسجيل\nيقدم الطالب طلبه\nإلى القسم\n.2 يسجل المقرر\n12\nنص بعد الرقم\nالمادة الثانية: يعلن القسم النتيجة", None),
        ("d", 3, None, [cell("Page-header", "نشرة القسم"), cell("Section-header", "الجزاءات :"), cell("List-item", "يحرم الطالب"), cell("Text", "نص أول\nنص ثان"), cell("Table", "أ ب", "<table><tr><th>البند</th><th>الحد</th></tr><tr><td>كتب</td><td>3</td></tr></table>"), cell("Picture", "صورة"), cell("Text", "typed line\nتتمة")]),
    ]
    return spark.createDataFrame(rows, f"doc_id string, page int, text string, blocks {pages.BLOCKS}")


def _classified(spark):
    lines = pages.lines_of(_pages(spark))
    running = spark.createDataFrame([("d", "نشره القسم")], "doc_id string, line string")
    contents = pages.contents_entries(lines, spark.createDataFrame([("d", 1)], "doc_id string, contents_page int"), running)
    typed = spark.createDataFrame([("d", 3, 1, ["typed line"], "س: ص")], "doc_id string, page int, table_no int, replaces array<string>, text string")
    return pages.classified(lines.where("page > 1"), running, contents, typed)


@golden(
    "page, block, line, part, kind, text, starts, clause_no",
    [
        (2, 0, 1, 0, "heading", "القبول والتسجيل", False, None), (2, 0, 2, 0, "unit", "يقدم الطالب طلبه", False, None), (2, 0, 3, 0, "unit", "إلى القسم", False, None), (2, 0, 4, 0, "unit", ".2 يسجل المقرر", True, "2"),
        (2, 0, 5, 0, "stop", "12", False, None), (2, 0, 6, 0, "unit", "نص بعد الرقم", False, None), (2, 0, 7, 0, "heading", "المادة الثانية:", False, None), (2, 0, 7, 1, "unit", "يعلن القسم النتيجة", True, None),
        (3, 1, 0, 0, "heading", "الجزاءات :", False, None), (3, 2, 0, 0, "unit", "يحرم الطالب", True, None), (3, 3, 0, 0, "unit", "نص أول", True, None), (3, 3, 1, 0, "unit", "نص ثان", False, None),
        (3, 4, 0, 0, "table", "البند: كتب، الحد: 3", False, None), (3, 6, 0, 0, "table", "س: ص", False, None), (3, 6, 1, 0, "unit", "تتمة", True, None),
    ],
)
def page_lines(spark):
    """What every line of pages is, from their text or their layout."""
    c = _classified(spark)
    return c.select("page", "seq.block", "seq.line", "seq.part", "kind", "text", "starts", "clause_no")


@golden(
    "page, unit_no, heading, content_type, lines, clause_no, manual",
    [
        (2, 1, "القبول والتسجيل", "prose", "يقدم الطالب طلبه|إلى القسم", None, False), (2, 2, "القبول والتسجيل", "clause", ".2 يسجل المقرر", "2", False), (2, 3, "القبول والتسجيل", "prose", "نص بعد الرقم", None, False),
        (2, 4, "المادة الثانية", "clause", "يعلن القسم النتيجة", None, False), (3, 1, "الجزاءات", "clause", "يحرم الطالب", None, False), (3, 2, "الجزاءات", "prose", "نص أول|نص ثان", None, False),
        (3, 3, "الجزاءات", "table", "البند: كتب، الحد: 3", None, False), (3, 4, "الجزاءات", "table", "س: ص", None, True), (3, 5, "الجزاءات", "prose", "تتمة", None, False),
    ],
)
def page_units(spark):
    """The units of pages, each under the heading in force."""
    return pages.units(_classified(spark)).select("page", "unit_no", "heading", "content_type", F.array_join("lines", "|").alias("lines"), "clause_no", "manual")


@golden("line", [("القبول والتسجيل",)])
def contents_headings(spark):
    """Entries of a contents page, without running lines and its own labels."""
    lines = pages.lines_of(_pages(spark))
    return pages.contents_entries(lines, spark.createDataFrame([("d", 1)], "doc_id string, contents_page int"), spark.createDataFrame([("d", "نشره القسم")], "doc_id string, line string")).select("line")


@golden("draft_no, heading, content_type, units, clause_no, text", [(1, "h", "clause", 2, "1–2", "one two\nthree four five"), (2, "h", "table", 1, None, "x y z"), (3, None, "prose", 1, None, "a b"), (4, "k", "prose", 1, None, " ".join(["w"] * 180)), (5, "k", "prose", 2, None, "w " * 49 + "w\nz")])
def merged_units(spark):
    """Units cut into windows and short ones put together."""
    rows = [(1, "h", "clause", "one two", "1"), (2, "h", "clause", "three four five", "2"), (3, "h", "table", "x y z", None), (4, None, "prose", "a b", None), (5, "k", "prose", " ".join(["w"] * 200), None), (6, "k", "prose", "z", None)]
    units = spark.createDataFrame(rows, "seq int, heading string, content_type string, text string, clause_no string").select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), "*", F.array().cast("array<string>").alias("lines"))
    cut = structure.pieces(units).withColumn("seq", F.col("seq") * 100 + F.col("part"))
    m = structure.merge(cut)
    return m.select("draft_no", "heading", "content_type", F.size("texts").alias("units"), structure.clause_range(F.col("clause_nos")).alias("clause_no"), F.array_join("texts", "\n").alias("text"))


@golden("pos, text, table_no", [(1, "a", None), (2, None, 9), (4, "d", None)])
def replaced_lines(spark):
    """Lines that a table typed by hand stands for."""
    lines = spark.createDataFrame([("d", 1, 1, "a"), ("d", 1, 2, "b"), ("d", 1, 3, "c"), ("d", 1, 4, "d")], "doc_id string, page int, pos int, text string")
    t = spark.createDataFrame([("d", 1, 9, ["b", "c"])], "doc_id string, page int, table_no int, replaces array<string>")
    return structure.replace_lines(lines, t).select("pos", "text", "table_no")


# ------------------------------------------------------------------ layout, tables, Markdown

_COLUMNS = [
    ("Page-header", "الهيئة الملكية", 1140, 28, 1414, 105), ("Section-header", "ثانيا الجزاءات والغرامات", 478, 117, 723, 147), ("Text", "للمكتبة الحق في أن تحرم من الاستعارة", 53, 215, 694, 303), ("Text", "يجوز للمكتبة حرمان المستعير", 53, 308, 694, 363),
    ("Section-header", "سياسة الاعارة", 946, 206, 1220, 273), ("Section-header", "أولا مدة الاعارة", 946, 335, 1220, 370), ("Table", "الفئة عدد الكتب", 834, 433, 1334, 647), ("Page-footer", "6", 1346, 754, 1359, 774),
]
_CARDS = [
    ("Text", "بداية فترة الاعتذار", 47, 635, 568, 701), ("Table", "الأحد", 148, 707, 534, 800), ("Text", "نهاية فترة الحذف", 809, 639, 1147, 704), ("Table", "الخميس", 786, 707, 1168, 800), ("Text", "بداية الفصل", 1452, 641, 1722, 704), ("Table", "الأحد", 1411, 707, 1795, 800),
    ("Text", "نهاية فترة التأجيل", 640, 960, 1197, 1090), ("Table", "الخميس", 792, 1097, 1173, 1190), ("Text", "إجازة منتصف العام", 1452, 1026, 1751, 1090), ("Table", "الجمعة", 1415, 1097, 1815, 1190),
]
_PICTURE = [("Section-header", "طريقة اصدار العضوية", 623, 125, 1084, 202), ("Picture", "", 639, 285, 900, 544), ("Text", "تعبئة النموذج", 1043, 277, 1400, 310), ("Text", "وصول رابط", 1082, 402, 1372, 464)]
_LATIN = [("Text", "Left column, read first", 53, 215, 694, 303), ("Text", "Right column", 946, 206, 1220, 273)]
_NO_BOX = [("Text", "للمكتبة الحق", 53, 215, 694, 303), ("Section-header", "سياسة", 946, 206, 1220, 273), ("Text", "نص بلا موضع", None, None, None, None)]


@golden("page, reading", [("cards", "4,5,2,3,0,1,8,9,6,7"), ("columns", "0,4,5,6,1,2,3,7"), ("latin", "0,1"), ("no box", "0,1,2"), ("picture", "0,1,2,3")])
def layout_order(spark):
    """The order to read a page's blocks in: two columns, rows of cards, a picture beside text, a Latin page, a block without a box."""
    rows = [(n, [(c, t, None if l is None else (float(l), float(a), float(r), float(b))) for c, t, l, a, r, b in blocks]) for n, blocks in (("columns", _COLUMNS), ("cards", _CARDS), ("picture", _PICTURE), ("latin", _LATIN), ("no box", _NO_BOX))]
    df = spark.createDataFrame(rows, "page string, blocks array<struct<category:string,text:string,box:struct<l:double,t:double,r:double,b:double>>>")
    return df.select("page", F.array_join(layout.block_order("blocks").cast("array<string>"), ",").alias("reading"))


@golden("case, found", [("a thin box beside a tall one's middle", "1|0"), ("right to left", "1,0"), ("a stroke above the line", "0,1,2")])
def printed_rows(spark):
    """Boxes as printed rows: a box belongs to a row if each lies at the other's middle."""
    cases = [("a thin box beside a tall one's middle", [(60, 6, 70, 8), (0, 0, 50, 10)]), ("right to left", [(0, 0, 10, 10), (20, 1, 30, 9)]), ("a stroke above the line", [(90, 0, 100, 10), (60, 2, 80, 9), (0, 1, 50, 11)])]
    return spark.createDataFrame([(n, "|".join(",".join(map(str, r)) for r in layout.line_rows(b))) for n, b in cases], "case string, found string")


@golden("answer, how, blocks", [(0, "json", 2), (1, "recovered", 2), (2, "recovered", 1), (3, "text", 0), (4, "json", 1)])
def layout_answers(spark):
    """How engines' layout answers could be read, and how many blocks they hold."""
    b = '{"category": "Text", "text": "one"}'
    made = [f"[{b}, {b}]", f"[{b}{b}]", f'[{b}, {{"category": "Te', "## a title", f"```json\n[{b}]\n```"]
    df = spark.createDataFrame(list(enumerate(made)), "answer int, response string").withColumn("l", layout.parsed_layout("response"))
    return df.select("answer", "l.how", F.coalesce(F.size("l.blocks"), F.lit(0)).alias("blocks"))


@golden("i, row, sentence", [(0, 0, "Both: r، Both: 1، C: x y"), (0, 1, "Both: r، Both: 2"), (1, 0, "البند: كتب، الحد: 3")])
def table_sentences(spark):
    """Rows of HTML tables as sentences, spans spread over their cells."""
    html = ["<table><thead><tr><th colspan=2>Both</th><th>C</th></tr></thead><tr><td rowspan=2>r</td><td>1</td><td>x<br>y</td></tr><tr><td>2<td></tr></table>", "<table><tr><th>البند</th><th>الحد</th></tr><tr><td>كتب</td><td>3</td></tr></table>", "<p>none</p>"]
    return spark.createDataFrame(list(enumerate(html)), "i int, html string").select("i", F.posexplode(tables.table_sentences("html")).alias("row", "sentence"))


_MARKDOWN = [
    ("# عنوان", "عنوان"), ("### عنوان فرعي", "عنوان فرعي"), ("**تعريفات:**", "تعريفات:"), ("*مائل*", "مائل"), ("- يلتزم الطالب", "يلتزم الطالب"), ("1. يلتزم الطالب", "1. يلتزم الطالب"), ("1\\. يلتزم", "1. يلتزم"), ("\\*note\\*", "*note*"),
    ("نسبة $70\\%$ من الدرجة", "نسبة 70% من الدرجة"), ("سطر<br>سطر", "سطر\nسطر"), ("<u>نص</u>", "نص"), ("a < b > c", "a < b > c"), ("A &amp; B &eacute;", "A & B é"), ("plain", "plain"),
]


@golden("i, text", [(i, t) for i, (_, t) in enumerate(_MARKDOWN)])
def markdown_texts(spark):
    """Markdown as the text that it prints."""
    return spark.createDataFrame([(i, m) for i, (m, _) in enumerate(_MARKDOWN)], "i int, m string").select("i", text.markdown_text(F.col("m")).alias("text"))


@golden("i, width, height", [(0, 2492, 3500), (1, 2828, 3948), (2, 56, 56)])
def model_sizes(spark):
    """The sizes that a vision model sees images in."""
    return spark.createDataFrame([(0, 2480, 3508), (1, 5000, 7000), (2, 20, 20)], "i int, w int, h int").select("i", layout.model_size(F.col("w"), F.col("h")).alias("s")).select("i", "s.*")


@golden("key, engine, text, blocks, error", [("a", "scripted", "one", 1, None), ("b", "scripted", None, None, "KeyError")])
def engine_readings(spark):
    """Pages read by an engine that answers from a table; a page that it fails on has the error."""
    import hashlib

    known = {hashlib.sha256(b"page a").hexdigest(): {"text": "one", "blocks": [{"category": "Text", "text": "one"}]}}
    images = spark.createDataFrame([("a", bytearray(b"page a")), ("b", bytearray(b"page b"))], "key string, png binary")
    r = engines.read(images, lambda: engines.Scripted(known))
    return r.select("key", "engine", "text", F.when(F.col("blocks").isNotNull(), F.size("blocks")).alias("blocks"), F.substring_index("error", ":", 1).alias("error"))


@golden("doc_id, fonts", [("a", 2), ("b", 1)])
def fonts_sampled(spark):
    """Fonts that the first pages of documents name."""
    return readers.font_sample(spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 6, "z"), ("b", 1, "x"), ("b", 2, "x")], "doc_id string, page int, font string"))


# ------------------------------------------------------------------ calendars


@golden("line, segment, text, l, r", [(1, 1, "abc", 0.0, 32.0), (1, 2, "de", 45.0, 60.0), (2, 1, "yx", 80.0, 100.0), (2, 2, "z", 10.0, 20.0)])
def line_segments(spark):
    """A line's characters parted at wide gaps, whichever way it runs."""
    a = [(1, i, c, lo, hi) for i, (c, lo, hi) in enumerate([("a", 0, 10), ("b", 12, 20), ("c", 24, 32), (" ", 33, 34), ("d", 45, 50), ("e", 51, 60)])]
    b = [(2, i, c, lo, hi) for i, (c, lo, hi) in enumerate([("y", 90, 100), ("x", 80, 88), ("z", 10, 20)])]
    return calendars.segments(spark.createDataFrame([(n, i, c, float(lo), float(hi)) for n, i, c, lo, hi in a + b], "line int, pos int, ch string, l double, r double"), "line")


@golden("i, semester", [(0, "الفصل الدراسي الأول"), (1, "Second Semester"), (2, None)])
def semester_headings(spark):
    """The semester that the text above a card names."""
    return spark.createDataFrame([(0, "تقويم الفصل  الدراسي الأول 1448"), (1, "Calendar, Second Semester"), (2, "no heading")], "i int, t string").select("i", calendars.semester_heading(F.col("t")).alias("semester"))


@golden("text", [("Calendar\nWeeks count from Sunday\nToday: 2026-10-13 (First, week 8)\nFirst: 2026-08-23 - 2027-01-16\nSecond: 2027-01-17 - 2027-05-31",)])
def calendar_sources(spark):
    """A source that tells the time: today by a given clock, the semesters and the week."""
    spans = spark.createDataFrame([("First", "2026-08-23", "2027-01-17"), ("Second", "2027-01-17", "2027-06-01")], "name string, start string, end string").select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    # ten in the evening is the next day three hours further east
    return calendars.calendar_source(spans, calendars.today(F.lit("2026-10-12 22:00:00").cast("timestamp")), "Weeks count from Sunday")


@golden("day, y, m, d", [("2026-08-23", 1448, 3, 10), ("2026-10-11", 1448, 4, 30)])
def hijri_days(spark):
    """Umm al-Qura dates."""
    made = calendars.hijri_dates(spark, "2026-08-01", "2027-07-31")
    return made.where("day in (date '2026-08-23', date '2026-10-11')").select(F.col("day").cast("string").alias("day"), "y", "m", "d")


@golden("name, start, end", [("a", "2026-08-23", "2027-01-17"), ("b", "2027-01-17", "2027-06-01")])
def semester_spans(spark):
    """Semesters from the cards that give their first days."""
    cards = [("a", "بداية الفصل الأول: 2026/08/23"), ("b", "بداية الفصل الثاني: 2027/1/17"), ("c", "بداية الفصل الصيفي: 2027/06/01"), ("x", "none")]
    starts = spark.createDataFrame(cards, "name string, t string").select("name", calendars.semester_start(F.col("t")).alias("start")).where("start is not null")
    return calendars.semesters(starts).select("name", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@golden("segment, anchor", [(1, 1), (2, 2), (3, None)])
def cards_of_segments(spark):
    """The card that each segment belongs to."""
    s = spark.createDataFrame([(1, 1, 0.0, 20.0, 40.0, 30.0), (1, 2, 190.0, 20.0, 230.0, 30.0), (1, 3, 600.0, 20.0, 640.0, 30.0)], "page int, pos int, l double, t double, r double, b double")
    a = spark.createDataFrame([(1, 1, 0.0, 40.0, 50.0, 50.0), (1, 2, 200.0, 40.0, 250.0, 50.0)], "page int, pos int, l double, t double, r double, b double")
    return calendars.card_of(s, a, "page").select("segment", "anchor")


@golden("pos, band, place", [(1, 1, 2), (2, 1, 1), (3, 2, 1)])
def card_bands(spark):
    """Rows of cards, right to left."""
    a = spark.createDataFrame([(1, 1, 0.0, 40.0, 50.0, 50.0), (1, 2, 200.0, 52.0, 250.0, 60.0), (1, 3, 0.0, 70.0, 50.0, 80.0)], "page int, pos bigint, l double, t double, r double, b double")
    return calendars.bands(a, "page").select("pos", "band", "place")


@golden("row_id, problem", [(2, "not published: 2026-09-30"), (3, "not one event's first and last day"), (5, "not one event's first and last day"), (5, "not published: 2026-12-01")])
def unpublished_dates(spark):
    """Printed dates that a published calendar hasn't got, and ranges that are no event's."""
    rows = [(1, "2026/09/26-23 م"), (2, "2026/09/30"), (3, "2026/09/25-23"), (4, "odd"), (5, "2026/12/01-2026/09/24"), (6, "2026/09/24")]
    rows[4] = (5, "2026/12/01-09/24")
    ics = "BEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20260923\r\nDTEND;VALUE=DATE:20260927\r\nEND:VEVENT\r\n"
    spans = readers.ics_spans(spark.createDataFrame([("f", ics)], "file string, ics string"))
    return calendars.against_published(spark.createDataFrame(rows, "row_id int, date_gregorian string"), spans)


@golden("day, name, week", [("2026-10-04", "First", 7), ("2026-10-13", "First", 8), ("2027-01-16", "First", 21), ("2027-06-01", None, None)])
def days_in_semesters(spark):
    """The semester and week of days."""
    spans = spark.createDataFrame([("First", "2026-08-23", "2027-01-17"), ("Second", "2027-01-17", "2027-06-01")], "name string, start string, end string").select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    days = spark.createDataFrame([(x,) for x in ("2026-10-04", "2026-10-13", "2027-01-16", "2027-06-01")], "day string").select(F.to_date("day").alias("day"))
    return calendars.placed_days(days, spans).withColumn("day", F.col("day").cast("string"))


# ------------------------------------------------------------------ measures


@golden("form, cer", [("normalized", 0.0), ("raw", 0.2)])
def error_forms(spark):
    """Error rates of a reading as it is and with its spelling unified."""
    df = spark.createDataFrame([("x", "أحمدة", "احمدة")], "engine string, truth string, reading string")
    out = None
    for form in evaluation.FORMS:
        part = evaluation.error_rates(df, ["engine"], form).select(F.lit(form).alias("form"), "cer")
        out = part if out is None else out.unionByName(part)
    return out


@golden("i, declines, gap", [(0, True, False), (1, True, True), (2, False, True), (3, False, False), (4, True, False)])
def declining_answers(spark):
    """Answers that decline: blank, in the fixed words, or naming a gap with nothing cited."""
    rows = [(0, " "), (1, "The sources do not give the fee."), (2, "It takes 3 days [1]. The sources do not give the fee."), (3, "Yes [2]."), (4, "No answer in the sources.")]
    a = F.col("t")
    return spark.createDataFrame(rows, "i int, t string").select("i", answers.declines(a, text.citations(a), ["No answer in the sources"], ["The sources do not give"]).alias("declines"), text.says(a, ["The sources do not give"]).alias("gap"))


@golden("i, prompt", [(0, "<sources>\n[1] T\nbody\n</sources>\n\nNote.\n\nQuestion: who?"), (1, "Question: what?")])
def model_prompts(spark):
    """What models are asked."""
    df = spark.createDataFrame([(0, "who?", ["[1] T\nbody"], "Note."), (1, "what?", [], None)], "i int, q string, b array<string>, n string")
    return df.select("i", answers.prompt(F.col("q"), F.col("b"), F.col("n")).alias("prompt"))


@golden("page, by, letters, words", [(1, "a", 10, 2), (1, "b", 0, 0)])
def inspected_pages(spark):
    """Arabic letters and words of a page by two parsers."""
    df = spark.createDataFrame([("d", 1, "a", "يقدم الطالب 12"), ("d", 1, "b", "page 12")], "doc_id string, page int, by string, text string")
    return quality.inspected(df).select("page", "by", "letters", "words")


# ------------------------------------------------------------------ measures of runs


@golden("pattern, text, first, last, edits", [("adc", "xxabcxx", 2, 5, 1), ("abd", "xxabcxx", 2, 4, 1), ("ab", "xxabxxab", 2, 4, 0), ("abc", "xx", 0, 0, 3), ("", "xx", 0, 0, 0)])
def located_parts(spark):
    """Where a text holds something nearest to a pattern."""
    df = spark.createDataFrame([("adc", "xxabcxx"), ("abd", "xxabcxx"), ("ab", "xxabxxab"), ("abc", "xx"), ("", "xx")], "pattern string, text string")
    return df.select("pattern", "text", evaluation.located("pattern", "text").alias("x")).select("pattern", "text", F.col("x.start").alias("first"), F.col("x.end").alias("last"), "x.edits")


@golden("a, b, words", [("a b c", "a x c d", 2), ("", "a", 1), ("k i t t e n", "s i t t i n g", 3)])
def word_distances(spark):
    """Levenshtein distances of word sequences."""
    w = lambda c: F.filter(F.split(c, " "), lambda x: F.length(x) > 0)
    return spark.createDataFrame([("a b c", "a x c d"), ("", "a"), ("k i t t e n", "s i t t i n g")], "a string, b string").select("a", "b", evaluation.word_distance(w(F.col("a")), w(F.col("b"))).alias("words"))


@golden("engine, pieces, cer, wer", [("x", 2, 0.454545, 1.0), ("y", 1, None, None)])
def engine_error_rates(spark):
    """Character and word error rates of engines, weighted by length."""
    return evaluation.error_rates(spark.createDataFrame([("x", "kitten", "sitting"), ("x", "flaw.", "lawn."), ("y", "", "a")], "engine string, truth string, reading string"), ["engine"])


@golden("cutoff, sound_low, broken_high, gap", [(1000, 0.99, 0.88, 0.11)])
def gate_separation(spark):
    """How far apart sound and broken pages lie at a cutoff."""
    return quality.separation(spark.createDataFrame([(1000, 0.95, 0.99), (1000, 0.9, 1.0), (1000, 0.5, 0.88), (1000, 0.2, 0.78)], "cutoff int, precision double, validity double"))


@golden("qid, quote_no, rank, held", [("a", 1, 1, True), ("a", 2, 7, True), ("b", 1, None, False)])
def evidence_ranks(spark):
    """The best rank of any chunk that holds a quote."""
    holders = spark.createDataFrame([("a", 1, "c1"), ("a", 1, "c9"), ("a", 2, "c2"), ("b", 1, None)], "qid string, quote_no int, chunk_id string")
    ranking = spark.createDataFrame([("a", "c1", 1), ("a", "c9", 3), ("a", "c2", 7)], "qid string, chunk_id string, rank int")
    return evaluation.rank_evidence(holders, ranking)


@golden("qid, cited, unknown, prec, rec, exact", [("a", "1,2", "9", 0.5, 1.0, True), ("b", "", "", None, None, None)])
def run_measures(spark):
    """Citations and numbers of runs, from the sources they were given and the chunks that hold the quotes."""
    runs = spark.createDataFrame([("a", "It takes 3 days [1][2, 9].", ["c1", "c5"]), ("b", None, ["c1"])], "qid string, answer string, sources array<string>")
    goldset = spark.createDataFrame([("a", 3.0), ("b", None)], "qid string, answer_numeric double")
    holders = spark.createDataFrame([("a", 1, ["c1", "c7"])], "qid string, quote_no int, chunk_ids array<string>")
    m = answers.run_measures(runs, goldset, holders)
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return m.select("qid", shown("cited").alias("cited"), shown("cited_unknown").alias("unknown"), F.col("precision").alias("prec"), F.col("recall").alias("rec"), F.col("numeric_exact").alias("exact"))


@golden(
    "arm, answered, cited, prec, rec, numbers, refused, gap_named, declined_wrongly, gap_on_answerable, retried, refused_unasked, p50",
    [("A", "1/2", "-", None, None, "-", "1/1", "-", "1/2", "0/2", "-", "-", 2.0), ("flow", "2/2", "1/2", 0.5, 0.75, "1/1", "-", "1/1", "0/2", "0/2", "1/3", "0/3", 4.0)],
)
def arm_measures(spark):
    """What arms come to."""
    none: list[int] = []
    rows = [
        ("A", "answer", False, False, none, none, None, None, None, 1, 10, 1, 1.0), ("A", "answer", True, False, none, none, None, None, None, 1, 10, 1, 2.0), ("A", "refuse", True, False, none, none, None, None, None, 1, 10, 1, 3.0),
        ("flow", "answer", False, False, [1], none, 0.5, 1.0, True, 1, 10, 1, 5.0), ("flow", "compare", False, False, [1], [9], 0.5, 0.5, None, 2, 10, 1, 4.0), ("flow", "answer_and_name_gap", False, True, [1], none, None, None, None, 1, 10, 1, 3.0),
    ]
    df = spark.createDataFrame(rows, "arm string, behaviour string, declined boolean, gap_named boolean, cited array<int>, cited_unknown array<int>, precision double, recall double, numeric_exact boolean, attempts int, tokens_in int, tokens_out int, seconds double")
    s = answers.arm_summary(df).withColumnsRenamed({"precision": "prec", "recall": "rec"})
    return s.drop("tokens_in", "tokens_out")


@golden("i, numbers", [(0, "25.0,3.75"), (1, "1500.0,21.0"), (2, "12.0,3.0")])
def numbers_read(spark):
    """The numbers in texts, in digits and in words."""
    df = spark.createDataFrame([(0, "٢٥% و 3,75"), (1, "1,500 ريال وواحد وعشرون يوما"), (2, "المادة الثالثة صفحة 12")], "i int, t string")
    return df.select("i", F.array_join(text.numbers(F.col("t")).cast("array<string>"), ",").alias("numbers"))


@golden("i, seconds", [(0, 7.5), (1, 3723.5), (2, None)])
def retry_delays(spark):
    """How long a service asks to wait."""
    return spark.createDataFrame([(0, '{"retryDelay": "7.5s"}'), (1, "retry in 1h2m3.5s"), (2, "no")], "i int, t string").select("i", answers.retry_delay(F.col("t")).alias("seconds"))


@golden("i, text, finish, tokens_in, thinking", [(0, "ab", "STOP", 5, 2), (1, None, "BLOCKED: OTHER", None, 0), (2, None, "NO_CANDIDATE", None, 0)])
def service_replies(spark):
    """A model service's replies, thoughts left out."""
    made = ['{"candidates":[{"content":{"parts":[{"text":"x","thought":true},{"text":"a"},{"text":"b"}]},"finishReason":"STOP"}],"usageMetadata":{"promptTokenCount":5,"thoughtsTokenCount":2}}', '{"promptFeedback":{"blockReason":"OTHER"}}', "{}"]
    df = spark.createDataFrame(list(enumerate(made)), "i int, body string").select("i", answers.reply(F.col("body")).alias("r"))
    return df.select("i", F.nullif("r.text", F.lit("")).alias("text"), "r.finish", "r.tokens_in", F.col("r.tokens_thinking").alias("thinking"))


@golden("i, label", [(0, "CORRECT"), (1, "REFUSED"), (2, None)])
def hand_labels(spark):
    """Labels written by hand."""
    return spark.createDataFrame([(0, " correct"), (1, "r"), (2, "maybe")], "i int, t string").select("i", answers.hand_label(F.col("t")).alias("label"))


@golden("i, heading, cell, glued", [(0, "القبول", "الفصل الأول", "ab cd"), (1, "a", "x", "abcd")])
def small_repairs(spark):
    """Headings trimmed, cells joined, glued words parted where one cut alone leaves known words."""
    df = spark.createDataFrame([(0, " القبول :-", ["الفـصل", "الأول"], "abcd", ["ab", "cd"]), (1, "- a", ["x"], "abcd", ["ab"])], "i int, h string, parts array<string>, w string, known array<string>")
    return df.select("i", text.trimmed_heading(F.col("h")).alias("heading"), text.cell(F.col("parts")).alias("cell"), text.split_glued(F.col("w"), F.col("known")).alias("glued"))


@golden("i, query", [(0, "شروط التحويل"), (1, "withdrawal dates"), (2, "fees")])
def query_lines(spark):
    """Queries written one a line: marks off, each once, three at most."""
    df = spark.createDataFrame([("1. شروط التحويل\n- \"withdrawal dates\"\n\nشروط التحويل\n• fees\nmore",)], "t string")
    return df.select(F.posexplode(tokens.query_lines(F.col("t"))).alias("i", "query"))


@golden("paragraph", [("five six seven",)])
def unread_paragraphs(spark):
    """Paragraphs of a reading that no block holds."""
    df = spark.createDataFrame([("one two three four\n\nfive six seven\n\n12", ["one two three four five", "x 12"])], "t string, blocks array<string>")
    return df.select(F.explode(tokens.unread_paragraphs(F.col("t"), F.col("blocks"))).alias("paragraph"))


# ------------------------------------------------------------------ questions


def _questions(spark):
    ref = "array<struct<doc_id:string,pdf_page:int,role:string,quotes:array<array<string>>>>"
    q = lambda d, p, *quotes: (d, p, "evidence", [list(x) for x in quotes])
    rows = [
        ("g001", "ar", "fact", "supported", True, "dev", "t1", [q("d", 1, ["15 وحدة"])], True), ("g002", "en", "fact", "document_conflict", True, None, "t1", [q("d", 1, ["absent"])], True),
        ("x3", "fr", "odd", "unknown", False, "test", None, [q("d", 9, ["lost"])], False), ("g004", "ar", "fact", "unsupported", True, None, "t2", [], True), ("g005", "ar", "fact", "supported", True, None, "t3", [], True),
    ]
    return spark.createDataFrame(rows, f"qid string, lang string, type string, answerability_status string, answerable boolean, split string, topic_group string, source_refs {ref}, reviewed boolean")


@golden("qid, behaviour", [("g001", "answer"), ("g002", "report_conflict"), ("g004", "refuse"), ("g005", "answer"), ("x3", None)])
def question_behaviours(spark):
    """How questions are to be met."""
    return _questions(spark).select("qid", gold.behaviour(F.col("answerability_status")).alias("behaviour"))


@golden("qid", [("g001",)])
def answerable_questions(spark):
    """The questions of a split that the sources answer."""
    return gold.answerable(_questions(spark), "dev").select("qid")


@golden("qid, problem", [("g002", "one document"), ("g004", "answerable against status"), ("g005", "no source"), ("x3", "id"), ("x3", "language"), ("x3", "no topic group"), ("x3", "split"), ("x3", "status"), ("x3", "type")])
def question_problems(spark):
    """Everything wrong with questions."""
    return gold.problems(_questions(spark), "qid", gold.question_rules(("fact", "procedure")))


@golden("n, problem", [(1, "no field lang"), (1, "unknown field colour")])
def question_fields(spark):
    """Fields of raw questions that are missing or not allowed."""
    raw = spark.createDataFrame([(0, '{"qid": "g001", "lang": "ar"}'), (1, '{"qid": "g002", "colour": 1}')], "n int, line string")
    return gold.unknown_fields(raw, "n", "line", ["qid", "lang", "split"], ["qid", "lang"])


@golden("qid, doc_id, page, quote_no", [("g002", "d", 1, 1), ("x3", "d", 9, None)])
def quotes_missing(spark):
    """Quotes that their pages don't hold."""
    pages_ = spark.createDataFrame([("d", 1, "الحد الأعلى 15وحدة في الفصل")], "doc_id string, page int, text string")
    return gold.quotes_missing(_questions(spark), pages_)


@golden("qid, split, status", [("g001", "final", "frozen"), ("g005", "dev", "frozen")])
def frozen_questions(spark):
    """A set as it is frozen."""
    own = _questions(spark).where("qid in ('g001', 'g005')")
    return gold.frozen(own, own.limit(0).select("qid"), ["g001"]).select("qid", "split", "status")


@golden("place, name", [(0, "a"), (1, "c")])
def split_chosen(spark):
    """Groups that fill a split nearest to the types' shares."""
    made = gold.choose_split([("a", {"x": 2}), ("b", {"x": 3}), ("c", {"y": 2}), ("d", {"y": 9})], {"x": 0.5, "y": 0.5}, 4, 200)
    return spark.createDataFrame(list(enumerate(sorted(made))), "place int, name string")


@golden("stratum, plain, n", [("p", False, 2), ("p", True, 2), ("q", False, 1), ("q", True, 2)])
def drawn_by_halves(spark):
    """An equal share of each stratum, up to half of it from the rows that go first."""
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("stratum"), (F.col("id") % 5 != 0).alias("plain"))
    made = gold.stratified(df, "stratum", "id", 7, first=~F.col("plain"))
    # the first half goes to rows that aren't plain; later ones may be either, so only what is certain is counted
    return made.groupBy("stratum", "plain").agg(F.count("*").alias("n")).select("stratum", "plain", F.when(F.col("plain"), F.least("n", F.lit(2))).otherwise(F.least("n", F.when(F.col("stratum") == "p", 2).otherwise(1))).cast("int").alias("n"))


@golden("item, run, qid, hand, judge", [(1, "r", "q1", "CORRECT", "correct"), (2, "r", "q2", "WRONG", "partial")])
def labels_to_runs(spark):
    """Hand labels put to the answers they were given for."""
    lab = spark.createDataFrame([(1, "CORRECT"), (2, "WRONG")], "item int, label string")
    key = spark.createDataFrame([(1, "r", "q1"), (2, "r", "q2")], "item int, run string, qid string")
    runs = spark.createDataFrame([("r", "q1", "correct"), ("r", "q2", "partial")], "run string, qid string, judge string")
    return gold.labelled_items(lab, key, runs)


# ------------------------------------------------------------------ the flow


def _flow(spark):
    asked = [(q, f"question {q}", lang) for q, lang in (("a", "en"), ("b", "en"), ("c", "ar"), ("d", "en"), ("e", "en"), ("f", "en"), ("g", "en"))]
    questions = spark.createDataFrame(asked, "qid string, question string, language string")
    rankings = spark.createDataFrame([(q, f"c{i}", i) for q in "abcdef" for i in range(1, 13)], "qid string, item_id string, rank int")
    replies = [("a", 1, "Yes [1]."), ("b", 1, "Maybe."), ("b", 2, "Yes [7]."), ("c", 1, "x [6]"), ("c", 2, "x [11]"), ("d", 1, "I do not know."), ("d", 2, "I do not know."), ("e", 1, ""), ("e", 2, "Sure."), ("f", 1, "Yes [1].")]
    return questions, rankings, spark.createDataFrame(replies, "qid string, attempt int, text string")


@golden(
    "qid, attempts, outcome, reason, cited, answer",
    [
        ("a", 1, "answered", "", "1", "Yes [1]."), ("b", 2, "answered", "", "7", "Yes [7]."), ("c", 2, "refused", "unknown citation", "", "لا جواب"), ("d", 2, "declined", "declined", "", "I do not know."),
        ("e", 2, "refused", "no citation", "", "No answer."), ("f", 0, "refused", "low confidence", "", "No answer."), ("g", 0, "refused", "no sources", "", "No answer."),
    ],
)
def flow_outcomes(spark):
    """Questions answered from sources: refused early, checked, tried again with more sources, declined."""
    questions, rankings, replies = _flow(spark)
    sure = spark.createDataFrame([("a", 2.0), ("b", -4.0), ("c", 0.0), ("d", 0.0), ("e", 0.0), ("f", -4.5)], "qid string, score double")
    made = flow.answered(questions, rankings, flow.replayed(replies), lambda c: text.says(c, ["do not know"]), {"en": "No answer.", "ar": "لا جواب"}, sure, -4.0)
    return made.withColumn("cited", F.array_join(F.col("cited").cast("array<string>"), ","))


@golden("qid, attempts, outcome, reason", [("a", 2, "refused", "not grounded"), ("f", 1, "answered", "")])
def flow_verified(spark):
    """A source added for a question keeps it from early refusal; a checker has the last word."""
    questions, rankings, replies = _flow(spark)
    added = spark.createDataFrame([("f", "calendar")], "qid string, source string")
    verify = lambda a: a.select("qid", (F.col("qid") == "f").alias("grounded"))
    more = replies.unionByName(spark.createDataFrame([("a", 2, "Yes [1].")], "qid string, attempt int, text string"))
    made = flow.answered(questions.where("qid in ('a', 'f')"), rankings, flow.replayed(more), lambda c: F.lit(False), {"en": "No answer."}, spark.createDataFrame([("f", -9.0)], "qid string, score double"), -4.0, added, verify)
    return made.select("qid", "attempts", "outcome", "reason")


@golden("arm, sources", [("A", 0), ("B", 12), ("C", 5)])
def arm_sources(spark):
    """How many sources each way of answering gets."""
    questions, rankings, replies = _flow(spark)
    out = None
    for name in flow.ARMS:
        part = flow.arm(questions.where("qid = 'a'"), rankings, flow.replayed(replies), name).select(F.lit(name).alias("arm"), F.size("sources").alias("sources"))
        out = part if out is None else out.unionByName(part)
    return out


@golden("qid, item_id, rank", [("a", 2, 1), ("a", 1, 2), ("b", 3, 1)])
def rewritten_search(spark):
    """Questions searched as asked and as rewritten, fused."""
    questions = spark.createDataFrame([("a", "x"), ("b", "z")], "qid string, question string")
    queries = flow.rewritten(questions, lambda q: ["y"] if q == "x" else [])
    found = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("y", 2, 1), ("z", 3, 1)], "query string, item_id long, rank int")
    return flow.searched(queries, lambda qs: qs.join(found, "query").select("q_id", "item_id", "rank"), 5)


# ------------------------------------------------------------------ requests


@golden("event_id, allowed", [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, True)])
def limited_events(spark):
    """At most two events a minute of each user: what isn't allowed doesn't count."""
    rows = [(1, "u", 0), (2, "u", 10), (3, "u", 20), (4, "u", 60), (5, "u", 65), (6, "u", 70), (7, "v", 20)]
    df = spark.createDataFrame(rows, "event_id long, user string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    return logs.limited(df, "user", "ts", 2).select("event_id", "allowed")


@golden("request_id, question", [("r1", "call [redacted]"), ("r3", "who?")])
def accepted_requests(spark):
    """Requests of 1 to 500 characters, without personal data."""
    df = spark.createDataFrame([("r1", " call 0501234567890 "), ("r2", " "), ("r3", "who?"), ("r4", "x" * 501), ("r5", None)], "request_id string, question string")
    return logs.accepted(df)


@golden("key, found", [("a", True), ("b", False)])
def replayed_requests(spark):
    """Requests that a store answers, and those still to ask."""
    held, open_ = logs.replayed(spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", "x"), ("c", "y")], "key string, answer string"))
    return held.select("key", F.lit(True).alias("found")).unionByName(open_.select("key", F.lit(False).alias("found")))


@golden("event", [("event: step\ndata: {\"name\":\"retrieve\",\"n\":5}\n\n",)])
def step_events(spark):
    """Steps as server-sent events."""
    return spark.createDataFrame([("retrieve", 5)], "name string, n int").select(sinks.server_event(F.lit("step"), F.struct("name", "n")).alias("event"))


# ------------------------------------------------------------------ stores and files


@golden("key, score", [("k1", 0.5), ("k2", 1.5)])
def stored_scores(spark):
    """Scores looked up in a store that has them all, pruned of what nothing refers to."""
    store = spark.createDataFrame([("k1", 0.5), ("k2", 1.5), ("old", 9.0)], "key string, score double")
    wanted = spark.createDataFrame([("k1",), ("k2",)], "key string")
    kept = stores.made_by(stores.described(stores.pruned(store, wanted), model="m1"), model="m1")
    return stores.lookup(wanted, kept, "score").select("key", "score")


@golden("key, text", [("k", "new")])
def usable_readings(spark):
    """Cached readings that may be used again."""
    rows = [("k", "old", False, None, 1), ("k", "new", False, None, 2), ("k", "cut", True, None, 3), ("d", None, False, None, 1), ("e", "x", False, "damaged", 1)]
    return stores.usable(spark.createDataFrame(rows, "key string, text string, truncated boolean, error string, read_at int")).select("key", "text")


@golden("record", [('{"page":{"doc_id":"d","page":1},"gate":{"verdict":"trusted","token_validity":0.99}}',)])
def page_records(spark):
    """A page's record as one JSON text; without a reading it has none."""
    df = spark.createDataFrame([("d", 1, "trusted", 0.99)], "doc_id string, page int, verdict string, token_validity double")
    return df.select(stores.page_record(F.struct("doc_id", "page"), F.struct("verdict", "token_validity"), F.lit(None).cast("struct<engine:string>")).alias("record"))


@golden("doc_id, page, text", [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "x"), ("b", 2, " y")])
def form_feed_pages(spark):
    """Pages of texts parted by form feeds; a blank last one is none."""
    return readers.form_feed_pages(spark.createDataFrame([("a", "one\ftwo\f\n"), ("b", "x\f y")], "doc_id string, text string"))


@golden("name, doc_id, page, region, kind", [("g_p03.txt", "g", 3, None, "partial"), ("g_p03.csv", "g", 3, None, "table"), ("g_p04.txt", "g", 4, None, "page"), ("g_p04_r2.txt", "g", 4, 2, "region")])
def truth_files(spark):
    """Pieces of ground truth by their files' names."""
    return readers.truth_pieces(spark.createDataFrame([("g_p03.txt",), ("g_p03.csv",), ("g_p04.txt",), ("g_p04_r2.txt",), ("notes.md",)], "name string"))


@golden("file, producer, creator", [("a", "Adobe", ""), ("b", "", "Writer")])
def file_metadata(spark):
    """Metadata of files, missing as empty."""
    return readers.metadata(spark.createDataFrame([("a", " Adobe ", None), ("b", None, "Writer")], "file string, producer string, creator string"))


@golden("doc_id, page", [("a", 2), ("b", 2)])
def second_pages(spark):
    """One page of each document."""
    return readers.page(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1)], "doc_id string, page int"), 2)


# ------------------------------------------------------------------ small pieces


@golden("i, fi, words", [(0, "five fields", "five fields"), (1, "x", "x")])
def lost_ligatures(spark):
    """Ligatures lost in extraction, and the distinct words of texts as compared."""
    df = spark.createDataFrame([(0, "\x1fve \x1felds"), (1, "x x")], "i int, t string")
    fixed = text.fi_ligature(F.col("t"))
    return df.select("i", F.when(F.col("i") == 0, fixed).otherwise("x").alias("fi"), F.array_join(tokens.word_set(fixed), " ").alias("words"))


@golden("i, texts", [(0, "a|P|new|b"), (1, "a|new|foot")])
def inserted_paragraphs(spark):
    """Added paragraphs put after the largest picture, else before the feet at the end."""
    df = spark.createDataFrame([(0, ["a", "P", "b"], ["Text", "Picture", "Text"], [0.1, 0.5, 0.1]), (1, ["a", "foot"], ["Text", "Page-footer"], [0.1, 0.1])], "i int, texts array<string>, categories array<string>, areas array<double>")
    return df.select("i", F.array_join(layout.insert_added(F.col("texts"), F.col("categories"), F.col("areas"), F.array(F.lit("new"))), "|").alias("texts"))


@golden("qid, score", [("a", 0.9), ("b", 0.2)])
def best_scores(spark):
    """The best score among a question's first sources."""
    ranking = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 6), ("b", 1, 1)], "qid string, item_id long, rank int")
    scores = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 2.0), ("b", 1, 0.2)], "qid string, item_id long, score double")
    return flow.confidence_of(ranking, scores)


@golden("n, rankings", [(0, "BM25+d1"), (1, "BM25+d2"), (2, "BM25+d1+d2")])
def compared_fusions(spark):
    """Which rankings are fused when retrievers are compared."""
    return spark.createDataFrame([(n, "+".join(f)) for n, f in enumerate(flow.fusions(["d1", "d2"]))], "n int, rankings string")


@golden("item_id, score", [(1, 1.0), (2, 0.5)])
def overlap_scores(spark):
    """Pairs scored by a stand-in: the share of a question's words that a text holds."""
    return spark.createDataFrame([(1, "late forms", "forms are late"), (2, "late forms", "late")], "item_id long, q string, t string").select("item_id", flow.overlap(F.col("q"), F.col("t")).alias("score"))
