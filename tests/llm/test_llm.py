"""The training-data operators against brute force, round trips and held-out texts, on small tables with every oddity."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from warraq.llm import common, mixing, packing, reading_level, repeated_lines, reply_defects, same_look, scan_repair, splitting, tokens
from warraq.llm.look import Automaton, LookForm, Trie, Wording, by_table

WORDS = "the student selects a free course at records office teacher reads book today committee returns marked papers Starts الطالب يقدم طلب التسجيل في مكتب القبول".split()


@pytest.fixture(scope="module")
def path():
    import os

    if not os.path.exists(tokens.TOKENIZER):
        pytest.skip("no tokenizer here")
    return tokens.TOKENIZER


# ------------------------------------------------------------------ looks


def test_looks_alike_and_not():
    look = LookForm(WORDS)
    same = [("ﺍﻟﻄﺎﻟﺐ", "الطالب"), ("ｔｈｅ", "the"), ("thе", "the"), ("st​udent", "student"), ("résumé", "résumé"), ("ی" + "قدم", "يقدم"), ("أحمد", "أحمد"), ("ﻻم", "لام"), ("۱۲", "١٢"), ("a  b", "a b"), ("e‑form", "e-form")]
    for a, b in same:
        assert look.text(a) == look.text(b), (a, b)
    seen = [("The", "the"), ("١", "1"), ("كتابُ", "كتاب"), ("،", ","), ("أحمد", "احمد"), ("ab", "a b"), ("على", "علي"), ("۴", "٤"), ("-", "–")]
    for a, b in seen:
        assert look.text(a) != look.text(b), (a, b)
    assert look.text(None) is None and look.text(" ​ ") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="the student الطالبکی​ً́ٔﻻａе-.", max_size=15))
def test_automaton_agrees_with_the_table(token):
    assert " ".join(LookForm(WORDS).text(token).split()) == " ".join(x for x in (by_table(t) for t in token.split()) if x)


def test_budget_of_the_automaton():
    a = Automaton(Trie(["student", "studend"]), budget=1)
    assert a.match("studemt") == "student" and a.match("student") == "student" and a.match("stemt") is None


def test_the_vocabulary_reads_letters_that_look_like_several():
    look, bare = LookForm(["final", "It", "office", "course", "عليها"]), LookForm()
    for stored, word in (("finaӀ", "final"), ("Іt", "It"), ("cօսrse", "course"), ("عليہا", "عليها"), ("оffісе", "office")):
        assert look.text(stored) == word == look.text(word), stored
    # the table alone reads an upright stroke as capital i and leaves letters of their own; so do words that the vocabulary hasn't got
    assert bare.text("finaӀ") == "finaI" and bare.text("cօսrse") == "cօսrse" and look.text("finӀ") == "finI"
    assert sum(look.text(w) != bare.text(w) for w in ("finaӀ", "cօսrse", "عليہا")) == 3


def test_classes_of_the_same_look(spark):
    rows = [("unit", "d", i, "the book" if i % 2 else "thе book") for i in range(1, 8)] + [("unit", "d", 20, "other"), ("unit", "e", 21, "the book"), ("unit", "d", 1, "the book"), ("unit", None, 30, "x"), ("unit", "d", 31, None)]
    got = same_look.classes(spark.createDataFrame(rows, "kind string, doc_id string, item_id long, text string"), WORDS).collect()
    assert {(r.item_id, r.class_id, r.members, r.spellings) for r in got} == {(i, 1, 7, 2) for i in range(1, 8)}


def test_pairs_of_a_large_class(spark, monkeypatch):
    monkeypatch.setattr(same_look, "TOGETHER", 3)
    rows = [("unit", "d", i, "the book" if i % 2 else "thе book") for i in range(1, 20)] + [("unit", "d", 1, "the book")]
    got = [tuple(r)[1:] for r in same_look.pairs(spark.createDataFrame(rows, "kind string, doc_id string, item_id long, text string"), WORDS).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(1, 20) for j in range(i + 1, 20) if (i + j) % 2}


def test_pairs_of_the_same_look(spark):
    rows = [("unit", "d", 1, "the book"), ("unit", "d", 2, "thе  book"), ("unit", "d", 2, "thе  book"), ("unit", "d", 3, "the book"), ("unit", "e", 4, "ｔhe book"), ("unit", "d", 5, None), ("unit", None, 6, "the book"), ("unit", "d", 7, ""), ("unit", "d", 8, "The book")]
    df = spark.createDataFrame(rows, "kind string, doc_id string, item_id long, text string")
    assert {tuple(r) for r in same_look.pairs(df, WORDS).collect()} == {("unit", 1, 2), ("unit", 2, 3)}
    forms = {r.item_id: r.form for r in same_look.canonical(df, WORDS).collect()}
    assert len(forms) == 8 and forms[2] == "the book" and forms[5] is None
    assert same_look.pairs(df.limit(0), WORDS).count() == 0


# ------------------------------------------------------------------ repeated lines


def brute_repeated(items):
    wording = Wording(LookForm(WORDS))
    pages, seen, where = defaultdict(set), defaultdict(set), defaultdict(set)
    for kind, source, page, item, lines in items:
        if source is None:
            continue
        pages[kind, source].add(page)
        for no, line in enumerate(lines or [], 1):
            w = wording.line(line or "")
            if any(c.isalpha() for c in w):
                seen[kind, source, w].add(page)
                where[kind, source, w].add((kind, item, no))
    hot = {k for k, v in seen.items() if len(v) >= 5 and len(v) * 10 >= len(pages[k[:2]])}
    return {x for k in hot for x in where[k]}


def test_repeated_lines_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    items = []
    for i in range(900):
        source = "hot" if i < 400 else rng.choice(["a", "b", "c", None])
        lines = [f"Page {i} of 900" if rng.random() < 0.5 else "body " + "".join(rng.choices("xyz", k=6)) for _ in range(rng.randrange(6))]
        lines += ["Follow us" if rng.random() < 0.12 else "ＦＯＬＬＯＷ us", None, ""] if rng.random() < 0.3 else []
        items.append(("document", source, i, i, lines))
    items += items[:50]
    df = spark.createDataFrame(items, "kind string, source string, page long, item_id long, lines array<string>").repartition(7)
    want = brute_repeated(items)
    assert want and {tuple(r) for r in repeated_lines.find(df, WORDS).collect()} == want
    clean = {r.item_id: r for r in repeated_lines.without(df, WORDS).collect()}
    assert len(clean) == 900 and sum(r.removed for r in clean.values()) == len(want)


def test_summary_keeps_what_is_frequent(spark):
    rng = np.random.default_rng(0)
    words = np.concatenate([rng.integers(1000, 10**6, 20_000), np.repeat([1, 2, 3], 700)])
    rng.shuffle(words)
    df = spark.createDataFrame([(5, 40, int(w)) for w in words], "gid long, cap long, wording long").repartition(6)
    got = {r.wording: r.n for r in repeated_lines.heavy_hitters(df, every=500).collect()}
    bound = len(words) / 41
    assert all(got.get(w, 0) + bound >= 700 and got.get(w, 0) <= 700 for w in (1, 2, 3)) and len(got) <= 6 * 40


def test_repeated_lines_of_empty_tables(spark):
    df = spark.createDataFrame([], "kind string, source string, page long, item_id long, lines array<string>")
    assert repeated_lines.find(df, WORDS).count() == 0


# ------------------------------------------------------------------ scans


def test_words_of_scans():
    w = scan_repair.Words([*WORDS, "department", "turns", "modern"])
    assert [w.judge(t) for t in ("student", "studcnt", "departrnent", "0ffice.", "GDF-430:", "unheard", "الطاלب", "اJطالب", "و")] == [0, 1, 1, 1, 0, 2, 1, 1, 0]
    assert w.broken("stu-", "dent")[0] and w.broken("الطا¬", "لب")[0] and w.broken("depart­", "ment.")[0] and w.broken("الطاـ", "لب")[0]
    assert not w.broken("the", "book")[0] and not w.broken("free.", "course")[0] and not w.broken("-", "book")[0]


def test_scan_defects_end_to_end(spark):
    def lines(p):
        return ["records office | papers", f"{WORDS[p]} teacher {WORDS[p + 3]} b0ok", f"{WORDS[p + 5]} {WORDS[p + 1]} committee re-", f"turns {WORDS[p + 2]} papers.", f"- {p} -"]

    units = spark.createDataFrame(
        [(p, "d", p, p, "prose", lines(p) if p != 4 else lines(p)[:2], " ".join(lines(p)) if p != 4 else " ".join(lines(p)[:2]), "ocr") for p in range(1, 7)] + [(9, "t", 1, 1, "prose", ["thc book"], "thc book", "text_layer"), (10, "d", 7, 1, "prose", None, None, "ocr")],
        "unit_id long, doc_id string, page int, seq int, content_type string, lines array<string>, text string, extraction_method string",
    ).union(spark.createDataFrame([(1, "d", 1, 1, "prose", lines(1), " ".join(lines(1)), "ocr")], "a long, b string, c int, d int, e string, f array<string>, g string, h string"))
    readings = spark.createDataFrame([(1, "d", 2, "\n".join(lines(2))), (2, "d", 3, None)], "reading_id long, doc_id string, page int, text string").select("reading_id", "doc_id", "page", F.struct("text").alias("result"))
    drafts = spark.createDataFrame([(1, "d", 1, [" ".join(lines(1)), "thc book re- turns"]), (2, "t", 1, ["thc book"])], "draft_id long, doc_id string, page int, texts array<string>")
    found = {tuple(r) for r in scan_repair.find(units, readings, drafts, WORDS).collect()}
    per_unit = {(1, "running_line"), (2, "misread"), (3, "broken_word"), (5, "page_number")}
    assert {(k, i, n, x) for k, i, n, x in found if k == "unit" and i == 1} == {("unit", 1, n, x) for n, x in per_unit}
    assert {(n, x) for k, i, n, x in found if k == "reading"} == per_unit
    assert {(n, x) for k, i, n, x in found if k == "draft"} == {(1, x) for _, x in per_unit} | {(2, "misread"), (2, "broken_word")}
    assert not any(i in (9, 10) for k, i, *_ in found if k == "unit")
    items = scan_repair.unit_items(units).unionByName(scan_repair.reading_items(readings))
    text = {r.item_id: r.text for r in scan_repair.paragraphs(items, WORDS).collect() if r.kind == "reading"}
    assert text == {1: f"{WORDS[2]} teacher {WORDS[5]} book {WORDS[7]} {WORDS[3]} committee returns {WORDS[4]} papers."}


def test_drafts_are_put_right(spark):
    def lines(p):
        return ["records office | papers", f"{WORDS[p]} teacher b0ok", f"{WORDS[p + 1]} committee re-", f"turns {WORDS[p + 2]} papers.", f"- {p} -"]

    units = spark.createDataFrame([(p, "d", p, lines(p), " ".join(lines(p)), "ocr") for p in range(1, 7)] + [(20, "d", 2, lines(2), " ".join(lines(2)), "ocr")], "unit_id long, doc_id string, page int, lines array<string>, text string, extraction_method string")
    readings = spark.createDataFrame([], "reading_id long, doc_id string, page int, text string").select("reading_id", "doc_id", "page", F.struct("text").alias("result"))
    rows = [(1, "d", 1, [" ".join(lines(1)), "thc book re- turns"]), (2, "d", 2, [" ".join(lines(2))]), (2, "d", 2, [" ".join(lines(2))]), (3, "t", 1, ["thc book"]), (4, "d", 3, []), (5, "d", 3, [None, "thc papers"]), (6, "d", 3, None)]
    rows += [(7, "d", 9, ["Records office | papers the stu dent reads 9 marked b0ok today. - 9 -"]), (8, "d", 8, ["a free stu- records office | papers 8 dent reads 8 papers"])]
    drafts = spark.createDataFrame(rows, "draft_id long, doc_id string, page int, texts array<string>")
    items = scan_repair.unit_items(units).unionByName(scan_repair.reading_items(readings))
    labels = scan_repair.labelled(items, WORDS)
    made = scan_repair.paragraphs(items, WORDS, labels)
    whole = {p: f"{WORDS[p]} teacher book {WORDS[p + 1]} committee returns {WORDS[p + 2]} papers." for p in (1, 2)}
    found = sorted(tuple(r) for r in scan_repair.draft_paragraphs(units, readings, drafts, made, labels, WORDS).select("kind", "item_id", "text").collect())
    assert found == [("draft", 1, whole[1] + "\n\nthe book returns"), ("draft", 2, whole[2]), ("draft", 4, ""), ("draft", 5, "the papers"), ("draft", 6, ""), ("draft", 7, "the student reads 9 marked book today."), ("draft", 8, "a free student reads 8 papers")]
    defects = {tuple(r)[1:] for r in scan_repair.find(units, readings, drafts, WORDS).where("kind = 'draft' and item_id > 6").collect()}
    assert defects == {(i, 1, x) for i in (7, 8) for x in ("running_line", "page_number", "broken_word")} | {(7, 1, "misread")}


def test_labels_decide(spark, monkeypatch):
    units = [(p, "d", p, [f"{WORDS[p]} teacher reads", "Records office | papers"] if p % 2 else ["Records office | papers", f"the {WORDS[p]} returns marked papers.", f"- {p} -"], "ocr") for p in range(1, 9)]
    items = scan_repair.unit_items(spark.createDataFrame(units, "unit_id long, doc_id string, page int, lines array<string>, extraction_method string"))
    of = lambda: {tuple(r)[1:] for r in scan_repair.line_defects(scan_repair.labelled(items, WORDS)).collect()}
    found = of()
    assert {(i, 1 if i % 2 == 0 else 2, "running_line") for i in range(1, 9)} | {(i, 3, "page_number") for i in range(2, 9, 2)} <= found
    # a model that takes heads and feet for body text: the same counts, but no line is a running one
    blind = scan_repair.prior()
    blind[: len(scan_repair.STATES)] = blind[len(scan_repair.STATES) : len(scan_repair.STATES) * 6] = 0
    blind[1] = 1
    blind[len(scan_repair.STATES) :][1 : 25 : 5] = 1
    monkeypatch.setattr(scan_repair, "fitted", lambda codes: blind)
    assert not {x for x in of() if x[2] in ("running_line", "page_number")}


def test_model_of_lines_against_brute_force():
    rng = np.random.default_rng(3)
    items = [rng.integers(0, scan_repair.CODES, n) for n in (1, 2, 4, 4, 3)]
    model, k = scan_repair.Model(scan_repair.prior()), len(scan_repair.STATES)
    import itertools

    total = np.zeros(len(scan_repair.prior()))
    for x, label in zip(items, model.label(items)):
        paths = {}
        for s in itertools.product(range(k), repeat=len(x)):
            p = model.start[s[0]] * model.emit[x[0], s[0]]
            for t in range(1, len(x)):
                p *= model.move[s[t - 1], s[t]] * model.emit[x[t], s[t]]
            paths[s] = p
        assert paths[tuple(label)] >= max(paths.values()) * (1 - 1e-9)
        weight = sum(paths.values())
        for s, p in paths.items():
            p /= weight
            total[s[0]] += p
            for t in range(1, len(x)):
                total[k + s[t - 1] * k + s[t]] += p
            for t in range(len(x)):
                at = k + k * k
                for size, place in zip(scan_repair.SIZES, scan_repair.PLACES):
                    total[at + s[t] * size + x[t] // place % size] += p
                    at += k * size
    assert np.allclose(model.expected(items), total)


def test_written_tables_can_be_cleared(spark):
    import glob

    made = common.written(spark.range(5).withColumn("x", F.array(F.lit(1))))
    assert made.count() == 5 and common.written(spark.range(0)).count() == 0
    folder = made.inputFiles()[0].split("://")[-1].rsplit("/", 2)[0]
    assert glob.glob(folder.replace("file:", "") + "/*")
    common.clear_written(spark)
    assert not glob.glob(folder.replace("file:", "") + "/*")


def test_lexica_longer_than_what_is_sent(spark, monkeypatch):
    lexicon = spark.createDataFrame([(w, 100 - n) for n, w in enumerate([*WORDS, "department", "modern", "final"])] * 2 + [(None, 5)], "word string, frequency long")
    whole, cut = common.vocabulary(lexicon), common.vocabulary(lexicon, 4)
    assert whole.rest is None and len(whole.words) == len(set(WORDS)) + 3 and cut.words == whole.words[:4] and {r.word for r in cut.rest.collect()} == set(whole.words[4:])

    def lines(p):
        return ["Records office | papers", f"{WORDS[p]} teacher {WORDS[p + 3]} b0ok", f"{WORDS[p + 5]} departrnent committee re-", "turns finaӀ papers.", f"- {p} -"]

    units = spark.createDataFrame([(p, "d", p, lines(p), " ".join(lines(p)), "ocr") for p in range(1, 7)] + [(9, "d", 9, None, None, "ocr")], "unit_id long, doc_id string, page int, lines array<string>, text string, extraction_method string")
    readings = spark.createDataFrame([(1, "d", 2, "\n".join(lines(2)))], "reading_id long, doc_id string, page int, text string").select("reading_id", "doc_id", "page", F.struct("text").alias("result"))
    drafts = spark.createDataFrame([(1, "d", 1, [" ".join(lines(1)), "thc b0ok stu- dent"])], "draft_id long, doc_id string, page int, texts array<string>")
    rows = lambda df: sorted(map(str, df.collect()))
    items = scan_repair.unit_items(units).unionByName(scan_repair.reading_items(readings))
    assert rows(scan_repair.find(units, readings, drafts, cut)) == rows(scan_repair.find(units, readings, drafts, whole)) != rows(scan_repair.find(units, readings, drafts, cut.words))
    assert rows(scan_repair.paragraphs(items, cut)) == rows(scan_repair.paragraphs(items, whole)) != rows(scan_repair.paragraphs(items, cut.words))
    labels = scan_repair.labelled(items, whole)
    put = lambda v: rows(scan_repair.draft_paragraphs(units, readings, drafts, scan_repair.paragraphs(items, v, labels), labels, v))
    assert put(cut) == put(whole) != put(cut.words)
    texts = spark.createDataFrame([("unit", "d", 1, "the finaӀ book"), ("unit", "d", 2, "the final book"), ("unit", "d", 3, None)], "kind string, doc_id string, item_id long, text string")
    assert rows(same_look.canonical(texts, cut)) == rows(same_look.canonical(texts, whole)) != rows(same_look.canonical(texts, cut.words))
    assert rows(same_look.pairs(texts, cut)) == rows(same_look.pairs(texts, whole)) == ["Row(kind='unit', id_a=1, id_b=2)"]
    asked = [(1, "arm A", "Where is the book?", "student reads marked papers today at office."), (2, "arm A", "Where is the book?", "papers mar"), (3, "arm A", "Where is the book?", "quod erat demonstrandum fuit."), (4, "arm B", None, "The finaӀ book")]
    exchanges = spark.createDataFrame(asked, "exchange_id long, purpose string, prompt string, text string")
    assert rows(reply_defects.find(exchanges, cut)) == rows(reply_defects.find(exchanges, whole)) != rows(reply_defects.find(exchanges, cut.words))
    pages = spark.createDataFrame([("document", "s", i, i, ["finaӀ note" if i % 2 else "final note", "body " + "x" * (i + 1)]) for i in range(20)], "kind string, source string, page long, item_id long, lines array<string>")
    assert rows(repeated_lines.find(pages, cut)) == rows(repeated_lines.find(pages, whole)) and repeated_lines.without(pages, cut).agg(F.sum("removed")).first()[0] == 20
    samples = spark.createDataFrame([(i, "en", 1 + i % 5, "The student reads a book. The final paper returns.") for i in range(10)], "sample_id long, lang string, level int, text string")
    docs = spark.createDataFrame([(1, "finaӀ", "finaӀ\nthe student reads", "s"), (2, None, "The finaӀ paper.", None)], "doc_id long, title string, text string, source string")
    assert rows(reading_level.levels(docs, samples, cut)) == rows(reading_level.levels(docs, samples, whole))


# ------------------------------------------------------------------ replies


CASES = [
    ("When does term start?", "In week 3 [1].", []), ("When does term start?", "", ["empty"]), ("When does term start?", None, ["empty"]), ("Q", " ​[1][2] ", ["empty"]), ("Q", "```\n```", ["empty"]), ("Q", "Answer:", ["empty"]),
    ("Where is the form for the course kept by the records office?", "where is the form for the course kept by the records office", ["copies_question"]),
    ("Question: Where is the form for the course?", "You ask: Where is the form for the course? [1]", ["copies_question"]),
    ("Where is the form for the course kept?", "Where is the form for the course kept? The committee returns the marked papers at the records office today.", []),
    ("Where is the book?", "Sorry, I am not able to answer this; please contact the records office.", ["refusal"]),
    ("أين مكتب القبول؟", "عذراً، لا أستطيع الإجابة عن هذا السؤال.", ["refusal"]),
    ("Where is the book?", "The passages do not give the fee, but the student reads the book at the office.", []),
    ("Where is the book?", "The student selects a free course at the records off", ["truncated"]), ("Where is the book?", "The student reads the book today. 2.", ["truncated"]),
    ("Where is the book?", "الطالب يقدم طلب التسجيل في مكتب القبول.", ["other_language"]), ("Reply in Arabic: Where is the book?", "The student reads the book at the office.", ["other_language"]),
    ("Reply in Arabic: Where is the book?", "الطالب يقدم طلب التسجيل في مكتب القبول.", []), (None, "The student reads the book.", []),
]


def test_reply_defects(spark):
    judge = reply_defects.Judge(WORDS + "where is form for kept by does term start in week not give but passages do fee question sorry I am able to answer this please contact عذرا لا أستطيع الإجابة عن هذا السؤال أين".split())
    for prompt, reply, want in CASES:
        assert judge.defects(prompt, reply) == want, (prompt, reply)
    rows = [(1, "arm A", "Where?", ""), (1, "arm A", "Where?", ""), (2, "judge", "Where?", ""), (3, None, "Where?", "")]
    df = spark.createDataFrame(rows, "exchange_id long, purpose string, prompt string, text string")
    assert [tuple(r) for r in reply_defects.find(df, WORDS).collect()] == [(1, "empty")]


# wordings written for this test
HELD_OUT = """I'm afraid I can't assist with that.|The documents provided do not mention this.|I'm sorry, but I have no information on that topic.|Unfortunately, none of the sources address this point.
That is something I cannot discuss.|We are not in a position to confirm this.|There is no information about this in the excerpts.|I have not found anything on this in the text.|My apologies, I don't have the details you are asking for.
This question goes beyond my knowledge.|I must refrain from answering.|Nothing in the context answers your question.|It is not possible to answer this from the given documents.|I would prefer not to say.
Regrettably, this request is outside my area of expertise; kindly ask the registrar.|I am not authorised to give advice about that.|The excerpts say nothing about it.|The answer is not available in the sources.|No answer was found.
I couldn't locate this in the material.|You may wish to consult the registrar, as I cannot determine this.|The text lacks this information.|That isn't covered by the passages.|I have no idea.|Sorry, that is beyond what I can answer.|We do not have that information at present.
The context provided contains no answer to this.|I'm unable to find that in the references.|Apologies, but I can't provide an answer.|I lack the information needed to answer.
ليس لدي جواب عن ذلك.|لا أملك معلومات حول هذا الموضوع.|النصوص المرفقة لا تذكر شيئاً عن ذلك.|أعتذر، لا يمكنني مساعدتك في هذا الطلب.|للأسف لم أعثر على إجابة في الوثائق.|هذا السؤال يتجاوز حدود معرفتي.|لا تتضمن المصادر جواباً عن سؤالك.
لا يوجد في النص ما يجيب عن السؤال.|أمتنع عن التعليق على هذا الأمر.|يصعب علي تحديد ذلك، يرجى مراجعة القسم.|لم تتطرق الوثائق إلى هذه المسألة.|ليس من صلاحيتي إعطاء هذه المعلومات.|المستندات تخلو من أي إشارة إلى ذلك.|لا تتوافر عندي تفاصيل عن هذا.|لم أتمكن من إيجاد الجواب.|لا أدري.""".replace("\n", "|").split("|")
ANSWERS = """The student may not transfer after week 3.|No, late forms are not accepted.|I cannot find a fee, but the term lasts 16 weeks.|The passages set the limit at 18 hours.|Students are not allowed to register without approval.
You cannot appeal after the deadline.|There is no fee for the service.|The committee cannot change the grade.|A grade of 60 is not enough.|Only the dean can approve this.|Please submit the form at the records office.|The request is refused without a signature.
The library does not lend reference books.|Nothing is due before registration.|The exam is outside the main hall.|Contact the records office within 5 days.|لا يقبل الطلب بعد الموعد.|لا يحق للطالب التأجيل أكثر من فصلين.|لا يمكن للطالب تسجيل أكثر من 18 ساعة.
ليس على الطالب رسوم.|لا توجد رسوم للخدمة.|لم تحدد المقاطع الرسوم، أما المدة فهي 3 أيام.|لا تقبل الوثائق غير المصدقة.|لا يسمح بالدخول بعد بدء الاختبار.""".replace("\n", "|").split("|")


# three further sets, each written before the slots were widened for what it showed to be missing; the last one was not used for that
LATER = """I regret that I cannot be of help here.|The attached documents are silent about this issue.|None of the passages talk about it.|I don't think I can answer this.|Your question falls outside the scope of these documents.|There isn't enough context to answer.
I was unable to find any relevant information.|We cannot provide legal advice.|This is not something the documents cover.|The sources I was given don't say.|It is impossible to tell from the text.|I have to decline.
Unfortunately I can't say.|I am not certain about this.|No such information is available.|The material does not specify.|I'd rather leave this unanswered.|As a language model I cannot comment on that.
Sorry, I couldn't find an answer to your question.|I do not possess that knowledge.|لا أستطيع تأكيد ذلك.|المعلومات المطلوبة غير متوفرة.|لم أجد ما يتعلق بسؤالك في النصوص.|لا تحتوي الوثيقة على هذه المعلومة.
آسف، هذا خارج نطاق معرفتي.|ليس بوسعي الرد على هذا.|أعتذر عن عدم تمكني من المساعدة.|لا يمكن تحديد الجواب من المقاطع المتاحة.|السياق لا يوضح ذلك.|لا فكرة لدي.
I have nothing on that in my sources.|The requested detail is missing from the excerpts.|I can only say that the documents leave this open.|My apologies, this is something I'm not able to clarify.|The passages give no indication of this.|That information isn't in the text I was given.
I wouldn't be able to tell you.|No passage deals with your question.|I am afraid the context offers no answer.|We are unable to respond to this request.|There's nothing about it in the documents.|I'm not permitted to discuss this topic.
This exceeds what I am able to answer.|I did not find that in the references.|Sorry, I don't have access to such data.|لا أستطيع أن أجزم بذلك.|لم يذكر النص هذا الأمر.|لا تسعفني المصادر بجواب.
عذراً، لا تتوفر بيانات عن هذا السؤال.|هذا ليس من اختصاصي.|لم أتوصل إلى إجابة.|يؤسفني أنني لا أملك جواباً.|ليست لدي صلاحية للحديث عن ذلك.|لا علم لنا بهذا الموضوع.""".replace("\n", "|").split("|")
LAST = """Regretfully, that is not something I can provide.|The text does not go into this.|I have found no mention of it.|It is outside my remit to say.|Sorry, no details are given on that.|I am not sure what the answer is.
The passages supplied contain nothing on this subject.|I would not want to guess.|There is no evidence of that in the passages.|We do not know.|Unfortunately the documents lack that detail.|I'm sorry, I can't discuss this.
Nothing was found about your request.|The information you want is unavailable to me.|This matter is not addressed in the sources.|لا تتوفر إجابة في المستندات.|لا يسعني الإجابة عن هذا.|ليس في النصوص ما يشير إلى ذلك.
لست مؤهلاً للإجابة عن سؤالك.|لا أملك ما يكفي من المعلومات.|نعتذر، لا نستطيع تلبية هذا الطلب.|لم ترد أي معلومة بهذا الشأن.""".replace("\n", "|").split("|")
MORE_ANSWERS = """The passing grade is not stated as a percentage but as points.|I found the answer in the second passage: 12 hours.|The form is not available online.|Answers are due on Sunday.|You do not need approval.|The department could not extend the period.
The office knows the deadline.|Information is given at the desk.|There is no exam in summer.|The question paper has three parts.|لا يلزم تقديم الطلب ورقيا.|لم يعد القسم يقبل الطلبات.
المعلومات متاحة في لوحة القسم.|لا يشترط حضور المرشد.|ليس هناك رسوم على التحويل.|The committee does not discuss grades.|The course is open to all students.|Some seats are missing from the list.
The plan is beyond the second year.|The guide does not recommend late registration.|I took the form to the office.|The answer is 12 hours.|No questions are allowed in the exam.|The student cannot answer by phone.
لا يملك القسم قاعة.|خارج أوقات الدوام لا تقبل الطلبات.|لا يجيب المكتب بعد الظهر.|النص منشور في اللوحة.""".replace("\n", "|").split("|")


def test_refusals_worded_otherwise():
    judge = reply_defects.Judge(WORDS)
    missed = [x for x in HELD_OUT + LATER + LAST if not judge.refuses(x)]
    assert len(missed) <= 0.1 * len(HELD_OUT + LATER + LAST), missed
    assert sum(map(judge.refuses, LAST)) >= 0.8 * len(LAST)
    assert not [x for x in ANSWERS + MORE_ANSWERS if judge.refuses(x)]


def test_copies_by_common_subsequence():
    judge, q = reply_defects.Judge([]), "where is the form for internal transfer kept by the records office of the marine institute in summer".split()
    assert judge.copies(q, q) and judge.copies(q + q, q)
    assert judge.copies([w for i, w in enumerate(q) if i % 4 != 1], q)  # no run of three words is left
    assert judge.copies([*q[:5], "please", *q[5:11], "indeed", *q[11:], "then"], q)
    assert not judge.copies([*q, "the", "dean", "keeps", "it"], q) and not judge.copies([*q, "room", "12"], q) and not judge.copies([], q) and not judge.copies(q, [])


def test_question_layouts():
    for prompt in ("Passages:\n[1] a b.\n\nQuestion: Who?", "### Question\nWho?\n### Passages\n[1] x\n### Answer in the language of the question", "Who?\n\nUse only the passages below.\n1) a", '<passages>\n<p n="1">a</p>\n</passages>\n<question>Who?</question>', "Who?", "Q: Who?\nA:", "You answer from texts.\n\nUser: Who?\n\nAssistant:", "These are texts.\n\n[1] a b\n[2] c d\n\nWho?", "Use them.\n\n[1] a.\n\nWho?"):
        assert reply_defects.question_of(prompt) == "Who?"


# ------------------------------------------------------------------ splitting


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 900), st.integers(1, 60), st.integers(0, 70), st.integers(0, 10**6))
def test_pieces_round_trip(n, limit, overlap, seed):
    rng = random.Random(seed)
    text = " ".join(f"w{i}" + rng.choice(["", "", "", ".", ",", ";", ".\n", " –"]) for i in range(n))
    cut = rng.randrange(len(text) + 1)
    made = splitting.split([text[:cut], text[cut:]], limit, overlap)
    words = [m for m in "\n".join([text[:cut], text[cut:]]).split() if any(c.isalnum() for c in m)]
    own = max(0, min(overlap, limit - 1))
    back = []
    for p in made:
        ws = [w for w in p["text"].split() if any(c.isalnum() for c in w)]
        assert len(ws) == p["n_words"] <= limit or len(made) == 1 and len(words) <= limit
        if p["piece_no"] > 1:
            assert ws[:own] == back[len(back) - own :]
        back += ws[own if p["piece_no"] > 1 else 0 :]
    assert back == words
    assert len(made) == 1 or len(made) >= -(-(len(words) - own) // (limit - own))


def test_splitting_tables(spark):
    limits = spark.createDataFrame([("prose", 10, 2), ("table", 5, 0)], "content_type string, max_words int, overlap_words int")
    rows = [(1, "prose", "a b. " * 20), (1, "prose", "a b. " * 20), (2, "prose", "short"), (3, "other", "a " * 99), (4, None, "a " * 99), (5, "prose", None), (6, "table", "a b c\nd e f"), (7, "prose", "a " * 10), (8, "prose", " - " * 50)]
    units = spark.createDataFrame(rows, "unit_id long, content_type string, text string")
    got = splitting.pieces(splitting.unit_items(units), limits)
    assert {r.item_id for r in got.collect()} == {1, 6}
    assert [r.cut_at for r in got.where("item_id = 6").orderBy("piece_no").collect()] == ["line", "end"]
    assert splitting.pieces(splitting.unit_items(units.limit(0)), limits).count() == 0


# ------------------------------------------------------------------ packing and mixing


def test_hilbert_neighbours_touch():
    cells = sorted((tokens.hilbert([x, y], 3), x, y) for x in range(8) for y in range(8))
    assert [c[0] for c in cells] == list(range(64))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(cells, cells[1:]))


def test_packing(spark, path):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 30, 90, 400])))) for i in range(300)] + [(900, None), (901, ""), (0, "the")]
    docs[0] = (0, "the")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    kinds = spark.createDataFrame([("short", 64, 1), ("long", 256, 2), (None, 5, 0), ("none", 0, 0)], "container_kind string, capacity_tokens int, separator_tokens int")
    sizes = {r.doc_id: r.n_tokens for r in tokens.sized(df, path).collect()}
    placed = packing.pack(df, kinds, path, tasks=4).collect()
    for kind, capacity, separator in (("short", 64, 1), ("long", 256, 2)):
        own = [r for r in placed if r.container_kind == kind]
        used, count, got = Counter(), Counter(), Counter()
        for r in own:
            used[r.container_id] += r.n_tokens
            count[r.container_id] += 1
            got[r.doc_id] += r.n_tokens
        assert got == {d: n for d, n in sizes.items() if n}
        assert all(used[c] + separator * (count[c] - 1) <= capacity for c in used)
        assert all(max(r.piece_no for r in own if r.doc_id == d) == 1 for d, n in sizes.items() if 0 < n <= capacity)
    fill = {r.container_kind: r.fill for r in packing.fill(packing.pack(df, kinds, path, tasks=4), kinds).collect()}
    assert set(fill) == {"short", "long"} and min(fill.values()) > 0.9
    assert packing.pack(df.limit(0), kinds, path).count() == 0


def test_documents_that_fill_no_container(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 8)
    rows = [("k", i, 1, 60, i, 100, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "container_kind string, doc_id long, piece_no int, n_tokens long, key long, capacity long, separator long").coalesce(1)
    assert packing._pack(df, last=False).where("container_id is null").count() == 300
    assert packing._pack(df, last=True).select("container_id").distinct().count() == 300


def test_min_cost_flow_prefers_first_uses():
    flows = mixing.route([(("a",), 100), (("a", "b"), 50), (("b",), 10)], [("a", 0.5, 1), ("b", 0.5, 3)], 200)
    by = Counter()
    for p, s, n in flows:
        by[s] += n
    assert by == {"a": 100, "b": 100}
    # the least cost: b's quota comes from first uses of what a doesn't need
    used = mixing.route([(("a", "b"), 100), (("b",), 100)], [("a", 0.5, 2), ("b", 0.5, 2)], 200)
    assert sorted(used) == [(("a", "b"), "a", 100), (("b",), "b", 100)]
    assert mixing.reachable([(("a",), 100), (("b",), 10)], [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 9)]) in range(74, 77) and mixing.reachable([], [("a", 1.0, 1)]) == 0
    assert mixing.route([(("a",), 10)], [("a", 0.5, 2), ("b", 0.5, 1)], 100) == [(("a",), "a", 20)]


def test_mixing(spark, path):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaabbc"), " ".join(rng.choices(WORDS, k=rng.randrange(1, 40)))) for i in range(400)]
    rows += [(1000 + i, "b", rows[i][2]) for i in range(20)] + [(2000, "a", None), (2001, None, "x"), (2002, "unlisted", "x y z"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("empty", 0.1, 9)], "source string, target_share double, max_repeats int")
    chosen = mixing.select(df, targets, total=4000, path=path)
    got = chosen.collect()
    limits, source = {"a": 1, "b": 2, "c": 4}, {r[0]: r[1] for r in rows}
    assert all(0 < r.uses <= limits[r.source] and source[r.doc_id] == r.source for r in got) and len({r.doc_id for r in got}) == len(got)
    share = {r.source: r for r in mixing.shares(chosen, targets).collect()}
    assert abs(share["a"].tokens - 2000) < 80 and abs(share["b"].tokens - 1200) < 80 and share["empty"].tokens == 0
    again = mixing.select(df.repartition(9), targets, total=4000, path=path)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got}
    assert mixing.select(df.limit(0), targets, path=path).count() == 0
    odd = mixing.shares(mixing.select(df.withColumn("source", F.concat(F.lit("x\ny"), "source")), targets.withColumn("source", F.concat(F.lit("x\ny"), "source")), path=path), targets.withColumn("source", F.concat(F.lit("x\ny"), "source")))
    for r in odd.collect():
        assert r.source == "x\nyempty" and r.tokens == 0 or abs(r.of_aim - r.target_share) < 0.02, r


# ------------------------------------------------------------------ reading level


EASY, HARD = "the student reads a book today", "pursuant provisions adjudicative authority supersedes procedural irregularities"


def test_reading_levels(spark):
    rng = random.Random(4)
    sentence = lambda base: " ".join(rng.sample(base.split(), 5)).capitalize() + "."
    samples = spark.createDataFrame([(i, "en", 1 if i % 2 else 5, " ".join(sentence(EASY if i % 2 else HARD) for _ in range(5))) for i in range(40)], "sample_id long, lang string, level int, text string")
    rows = [(i, f"Title {i}", "\n".join(["Follow us", f"Title {i}", *(sentence(HARD if i % 3 == 0 else EASY) for _ in range(4))]), "s") for i in range(30)]
    rows += [(100, None, None, "s"), (101, None, "", None), (102, None, "12 34", "t"), (103, None, "\n".join(sentence(HARD)[:-1] for _ in range(20)), None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string, source string")
    got = {r.doc_id: r for r in reading_level.levels(docs, samples, WORDS).collect()}
    assert len(got) == 34
    assert all((got[i].hard_share == 1.0) == (i % 3 == 0) and got[i].words == 20 for i in range(30))
    assert (got[100].level, got[100].hard_share, got[101].words, got[102].level) == (None, 0.0, 0, None) and got[103].hard_share == 1.0
    none = {r.doc_id: r.level for r in reading_level.levels(docs, samples.limit(0), WORDS).collect()}
    assert set(none.values()) == {None}


def test_held_out_levels():
    rng = random.Random(5)
    words = {k: [f"w{k}{i}" for i in range(30)] for k in range(1, 6)}
    text = lambda k: " ".join(" ".join(rng.choices(words[k] + words[max(1, k - 1)], k=8)) + "." for _ in range(6))
    model = reading_level.fit([(k, text(k)) for k in range(1, 6) for _ in range(20)], [])
    plain = reading_level.Plain(LookForm())
    tried = [(k, model.level(s)) for k in range(1, 6) for _ in range(10) for s in reading_level.sentences([text(k)], plain)]
    assert sum((a >= 4) == (b >= 4) for a, b in tried) > 0.9 * len(tried)
