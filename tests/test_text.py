from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from warraq.functions import normalize, text, tokens
from warraq.functions.normalize import plain


def col(spark, values, made):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(made(F.col("t"))).collect()]


def test_stems(spark):
    words = {"الطلاب": "طلاب", "والطلاب": "طلاب", "بالكليه": "كل", "للطالب": "طالب", "المعلومات": "معلوم", "ومن": "ومن", "وقت": "وقت", "وقتها": "قت", "له": "له"}
    assert dict(zip(words, col(spark, list(words), tokens.light_stem))) == words


def test_terms(spark):
    assert col(spark, ["وش شروط التحويل من الكلية؟"], lambda c: tokens.terms(c, stem=False)) == [["شروط", "التحويل", "الكليه"]]
    assert col(spark, ["٢٥%"], lambda c: tokens.terms(c, stopwords=False, stem=False)) == [["25"]]
    assert col(spark, ["", None], tokens.terms) == [[], None]


def test_normalization_steps(spark):
    values = ["ﻻ ﺑﺄس", "أحمدُ  في​ المدرسة،", "١٢٫٥٪", "ـــكتاب", "ﷺ", "", None]
    assert col(spark, values, normalize.for_comparison) == ["لا باس", "احمد في المدرسه,", "12.5%", "كتاب", "صلي الله عليه وسلم", "", None]
    assert col(spark, ["é", None], normalize.raw_form) == ["é", None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ابتثأإآىةﺍﻻﻼﷲًّـ١۲a ​ ،", max_size=12), min_size=20, max_size=20))
def test_driver_and_column_normalize_alike(spark, values):
    assert col(spark, values, normalize.for_comparison) == [plain(v) for v in values]


def test_evidence_words(spark):
    assert col(spark, ["15وحدة (20%)"], tokens.evidence_words) == [" 15 وحده 20 "]


def test_clause_numbers(spark):
    values = {".2 نص": 2, "-1 نص": 1, "1) نص": 1, "3 . نص": 3, "12. نص": 12, "3.75 من 4": None, "(15) يوما": None, "12 وحدة": None}
    assert dict(zip(values, col(spark, list(values), text.clause_number))) == values


def test_redaction(spark):
    values = ["mail a.b@c.org now", "call +966 55 123 4567 please", "id 12345678", "in 2026 and 3.75", None]
    assert col(spark, values, text.redact) == ["mail [redacted] now", "call [redacted] please", "id [redacted]", "in 2026 and 3.75", None]


def test_citations_and_numbers(spark):
    assert col(spark, ["as [1، 3] and [٢] and [1]"], text.citations) == [[1, 3, 2]]
    assert col(spark, ["خمسة عشر يوماً و 3,5 و 1,000"], text.numbers) == [[3.5, 1000.0, 15.0]]
    assert col(spark, ["خمس وعشرون، ثلاثة"], text.word_numbers) == [[25.0, 3.0]]


def test_letters_and_keys(spark):
    assert col(spark, ["สاق", "الساعاת", "ส alone", "\u001fle"], lambda c: text.fi_ligature(text.repair_letters(c))) == ["سباق", "الساعات", "ส alone", "file"]
    assert col(spark, ["x"], lambda c: text.text_key(F.lit("passage"), c)) == ["".join(__import__("hashlib").sha256(b"passage\0x").hexdigest()[:24])]


def test_query_lines(spark):
    assert col(spark, ['1. "first"\n- second\n\n3.75 stays\nsecond\nfifth'], tokens.query_lines) == [["first", "second", "3.75 stays"]]


def test_glued_words(spark):
    known = F.array(*map(F.lit, ["بداية", "الفصل"]))
    assert col(spark, ["بدايةالفصل", "الفصل", "مجهول"], lambda c: text.split_glued(c, known)) == ["بداية الفصل", "الفصل", "مجهول"]
