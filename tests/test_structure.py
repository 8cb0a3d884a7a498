from pyspark.sql import functions as F

from warraq.operators import calendars, labels, layout, quality, structure, tables
from warraq.plans.catalog import QUERIES


def test_article_labels():
    assert labels.article_label("المادة الحادية عشرة").number == 11
    assert labels.article_label("المادة الثانية والعشرون:").number == 22
    assert labels.article_label("المادة السادس والأربعون:").number == 46
    assert labels.article_label("وفق المادة (العاشرة)") is None
    assert labels.article_label("نص المادة الثانية: يعلن") is None and labels.article_label("نص المادة الثانية:").certain
    assert labels.article_label("المادة") is None and labels.article_label("") is None
    assert labels.article_label("المادة الأولى والعشرون والثالثة والرابعة:") is None  # three ordinals at most


def test_labels_are_taken_in_order_over_pages(spark):
    rows = [("d", 1, 1, 6, False), ("d", 2, 1, 5, True), ("d", 9, 1, 6, False), ("d", 9, 2, 20, False), ("e", 1, 1, 1, False), ("e", 1, 2, 4, False), ("e", 1, 3, 8, False)]
    df = spark.createDataFrame(rows, "doc_id string, page int, seq int, number int, certain boolean")
    got = {(r.doc_id, r.page, r.seq): r.accepted for r in labels.counted(df).collect()}
    assert got == {("d", 1, 1): False, ("d", 2, 1): True, ("d", 9, 1): True, ("d", 9, 2): False, ("e", 1, 1): True, ("e", 1, 2): True, ("e", 1, 3): False}
    assert labels.counted(df.limit(0)).count() == 0


def test_windows_cover_and_overlap():
    for count, ends in ((500, [100, 170, 260]), (180, []), (1, []), (700, [])):
        made = structure.windows(count, ends)
        assert made[0][0] == 0 and made[-1][1] == count and all(b - a <= 180 for a, b in made)
        assert all(c == b - 30 for (_, b), (c, _) in zip(made, made[1:]))
    assert structure.grouped([100, 80, 1, 300, 5]) == [[0, 1], [2], [3], [4]]


def test_merge_and_chunks(spark):
    rows = [("d", 1, 1, "h", "clause", "one two", "1"), ("d", 1, 2, "h", "clause", "three four five", "2"), ("d", 1, 3, "h", "table", "x y z", None), ("d", 1, 4, None, "prose", "a b", None)]
    units = spark.createDataFrame(rows, "doc_id string, page int, seq int, heading string, content_type string, text string, clause_no string")
    made = structure.merge(units)
    assert [(r.draft_no, len(r.texts)) for r in made.orderBy("draft_no").collect()] == [(1, 2), (2, 1), (3, 1)]
    docs = spark.createDataFrame([("d", "T", "all", None)], "doc_id string, title string, scope string, effective string")
    got = structure.chunks(made, docs).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.clause_no) for r in got] == [("d_p1_c1", "1–2"), ("d_p1_c2", None)]


def test_fill_forward_over_stretches(spark, monkeypatch):
    import random

    monkeypatch.setattr(structure, "STRETCH", 3)
    rng, rows, want, now = random.Random(7), [], {}, {}
    for d in "ab":
        for p in range(1, 30):
            for q in range(rng.randrange(3)):
                v = rng.choice([None, None, None, f"{d}{p}{q}"])
                rows.append((d, p, q, v))
                now[d] = v or now.get(d)
                want[d, p, q] = now[d]
    df = spark.createDataFrame(rows, "doc_id string, page int, seq int, heading string").repartition(5)
    assert {(r.doc_id, r.page, r.seq): r.filled for r in structure.fill_forward(df, "heading").collect()} == want


def test_fill_forward_over_pages(spark):
    rows = [("d", 1, 1, None), ("d", 1, 2, "A"), ("d", 2, 1, None), ("d", 3, 1, None), ("d", 3, 2, "B"), ("e", 1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id string, page int, seq int, heading string")
    got = {(r.doc_id, r.page, r.seq): r.filled for r in structure.fill_forward(df, "heading").collect()}
    assert got == {("d", 1, 1): None, ("d", 1, 2): "A", ("d", 2, 1): "A", ("d", 3, 1): "A", ("d", 3, 2): "B", ("e", 1, 1): None}


def test_manual_tables_replace_lines(spark):
    lines = spark.createDataFrame([("d", 1, 1, "a"), ("d", 1, 2, "b"), ("d", 1, 3, "c")], "doc_id string, page int, pos int, text string")
    t = spark.createDataFrame([("d", 1, 9, ["b", "c", "gone"])], "doc_id string, page int, table_no int, replaces array<string>")
    assert [(r.pos, r.table_no) for r in structure.replace_lines(lines, t).orderBy("pos").collect()] == [(1, None), (2, 9)]
    assert [r.replaces for r in structure.unmatched_lines(lines, t).collect()] == ["gone"]


def test_grids():
    html = "<table><thead><tr><th colspan=2>Both</th><th>C</th></tr></thead><tr><td rowspan=2>r</td><td>1</td><td>x<br>y</td></tr><tr><td>2<td></tr></table>"
    lines = tables.grid(tables.rows_of(html))
    assert lines == [(True, ["Both", "Both", "C"]), (False, ["r", "1", "x y"]), (False, ["r", "2", ""])]
    assert tables.sentences_of(html) == ["Both: r، Both: 1، C: x y", "Both: r، Both: 2"]
    assert tables.rows_of("") == [] and tables.sentences_of("<p>no table</p>") == []


def test_layout(spark):
    box = lambda l, t, r, b: {"l": l, "t": t, "r": r, "b": b}  # noqa: E731, E741
    two = [{"category": "Text", "text": "عنوان", "box": box(0, 0, 1, 0.1)}, {"category": "Text", "text": "العمود الأيسر", "box": box(0, 0.2, 0.4, 0.9)}, {"category": "Text", "text": "العمود الأيمن", "box": box(0.6, 0.2, 1, 0.9)}]
    assert layout.reading_order(two) == [0, 2, 1]
    assert layout.reading_order([b | {"text": "left to right"} for b in two]) == [0, 1, 2] and layout.reading_order([]) == []
    assert layout.reading_order([{"category": "Text", "text": "x", "box": None}]) == [0]
    assert layout.line_rows([(0, 0, 1, 10), (2, 1, 3, 9), (0, 20, 1, 30)]) == [[1, 0], [2]]
    assert layout.layout_blocks('[{"category": "Text", "text": "a"}, {"category": "Ti') == ([{"category": "Text", "text": "a"}], "recovered")
    assert layout.layout_blocks("plain words") == (None, "text")
    assert layout.layout_blocks(None) == (None, "text")


def test_date_cells(spark):
    df = spark.createDataFrame([("2026/09/26-23م",), ("1448/08/08-07/30هـ",), ("2026/13/01م",), ("soon",), (None,)], "c string")
    rows = [r.x for r in df.select(calendars.date_cell(F.col("c")).alias("x")).collect()]
    assert (rows[0].first, rows[0].last) == ((2026, 9, 26), (2026, 9, 23)) and (rows[1].first, rows[1].last) == ((1448, 8, 8), (1448, 7, 30))
    assert [r.problem for r in rows] == [None, None, "out of range", "malformed", "malformed"]


def test_weeks_and_hijri(spark):
    df = spark.sql("select explode(array(date'2026-10-04', date'2026-10-13', date'2027-01-16', date'2027-01-17')) d")
    w = [r[0] for r in df.select(calendars.week(F.col("d"), F.lit("2026-08-23").cast("date"), F.lit("2027-01-17").cast("date"))).collect()]
    assert w == [7, 8, 21, None]
    h = {str(r.day): (r.y, r.m, r.d) for r in calendars.hijri_dates(spark, "2026-08-23", "2026-10-11").collect()}
    assert h["2026-08-23"] == (1448, 3, 10) and h["2026-10-11"] == (1448, 4, 30)


def test_cards_and_bands(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 10.0), (1, 2, 200.0, 5.0, 300.0, 15.0), (1, 3, 0.0, 60.0, 100.0, 70.0)], "page int, pos long, l double, t double, r double, b double")
    s = spark.createDataFrame([(1, 1, 10.0, 12.0, 90.0, 20.0), (1, 2, 500.0, 12.0, 560.0, 20.0)], "page int, pos long, l double, t double, r double, b double")
    assert {r.segment: r.anchor for r in calendars.card_of(s, a, "page").collect()} == {1: 1, 2: None}
    assert {r.pos: (r.band, r.place) for r in calendars.bands(a, "page").collect()} == {1: (1, 2), 2: (1, 1), 3: (2, 1)}


def test_routes_and_gate(spark):
    df = spark.createDataFrame([("Microsoft® Word 2019", None), ("Adobe PDF library 15.00", None), ("", ""), ("x", "Adobe Illustrator"), (None, None)], "p string, c string")
    got = [tuple(r.x)[0:3:2] for r in df.select(quality.route(F.col("p"), F.col("c")).alias("x")).collect()]
    assert got == [("ocr", "microsoft_office"), ("text_layer", "adobe"), ("text_layer", "default"), ("text_layer", "adobe"), ("text_layer", "default")]
    q = spark.createDataFrame([(30, 0, 0, 0.95), (30, 0, 0, 0.949), (0, 0, 0, None), (5, 1, 0, 0.5)], "arabic_tokens int, cid_placeholders int, replacement_chars int, token_validity double")
    rows = quality.gate(q).collect()
    assert [r.verdict for r in rows] == ["trusted", "untrusted", "no_arabic_text", "untrusted"]
    assert rows[3].rejected_by == ["too_few_words", "cid_placeholders", "token_validity"]


def test_article_labels_in_any_encoding(spark, tmp_path):
    shaped = "\ufe8d\ufedf\ufee4\ufe8e\ufea9\ufe93 الثالثة:"
    lines = ["المادة الأولى:", "الما\u200bدة الثانية:", shaped, "المَادَّة الرابعة:", "\u202bالمادّة\u202c الخامسة:", "من المادة الأولى", "نص", None]
    spark.createDataFrame([(1, "d", 1, 1, lines), (1, "d", 1, 1, lines), (2, "d", 1, 2, None)], "unit_id long, doc_id string, page int, seq int, lines array<string>").write.parquet(f"{tmp_path}/units.parquet")
    rows = sorted((r.unit_id, r.i, r.number) for r in QUERIES["unit_articles"](spark, str(tmp_path)).collect())
    assert rows == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 5)]
