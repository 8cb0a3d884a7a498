"""Measures and rules of text quality: pages, documents, producers, lexica."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize, text, tokens

#: Validity below this, or fewer words, fails a page; words under the frequency don't count as known.
MIN_VALIDITY, MIN_WORDS, MIN_FREQUENCY = 0.95, 20, 1000

# Fixed values: (rule, pattern, path, expected failure) by what wrote a document; the first that fits holds.
PRODUCERS = [
    ("pdfium", r"\bpdfium\b", "text_layer", "presentation_forms"),
    ("adobe", r"\badobe\b.*\b(pdf library|illustrator)\b", "text_layer", "presentation_forms"),
    ("microsoft_office", r"\bmicrosoft\b.*\b(word|powerpoint)\b", "ocr", "lossy_substitution"),
]


def route(producer: Column, creator: Column) -> Column:
    """struct(path, expected_failure, rule, matched_on): from the producer, else the creator, else the default."""
    chain: Column | None = None
    for name, value in (("producer", producer), ("creator", creator)):
        seen = normalize.metadata_text(F.coalesce(value, F.lit("")))
        for rule, pattern, path, failure in PRODUCERS:
            hit = F.struct(F.lit(path).alias("path"), F.lit(failure).alias("expected_failure"), F.lit(rule).alias("rule"), F.lit(name).alias("matched_on"))
            chain = F.when(seen.rlike(pattern), hit) if chain is None else chain.when(seen.rlike(pattern), hit)
    return chain.otherwise(F.struct(F.lit("text_layer").alias("path"), F.lit("unknown").alias("expected_failure"), F.lit("default").alias("rule"), F.lit(None).cast("string").alias("matched_on")))


def lexicon(frequencies: DataFrame, cutoff: int = MIN_FREQUENCY, merge_first: bool = False) -> DataFrame:
    """(word): the words known, as compared. The cutoff holds for each spelling, or with ``merge_first`` for their sum."""
    own = frequencies.select(normalize.for_comparison(F.col("word")).alias("word"), "frequency")
    if merge_first:
        own = own.groupBy("word").agg(F.sum("frequency").alias("frequency"))
    return own.where((F.col("frequency") >= cutoff) & (F.length("word") > 0)).select("word").distinct()


def cutoffs(frequencies: DataFrame, at: list[int]) -> DataFrame:
    """(cutoff, words): how many words reach each frequency."""
    limits = F.explode(F.array(*map(F.lit, at))).alias("cutoff")
    counted = frequencies.select("frequency", limits).groupBy("cutoff").agg(F.count_if(F.col("frequency") >= F.col("cutoff")).alias("words"))
    return counted


def unsorted_rows(lines: DataFrame, at: str = "line_no") -> DataFrame:
    """Rows of a frequency list that break its descending order (none in a sound one).

    Rows are laid out by range of their place; a range's first row is compared with the last of the range before it, which
    comes from a table of a row a range, so no task holds the whole list.
    """
    laid = lines.repartitionByRange(at).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    lasts = laid.groupBy("_range").agg(F.max_by("frequency", at).alias("_last"))
    edge = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_edge"))  # a row a range
    within = F.lag("frequency").over(Window.partitionBy("_range").orderBy(at))
    both = laid.withColumn("_within", within).join(edge, "_range").withColumn("before", F.coalesce("_within", "_edge"))
    return both.where(F.col("before") < F.col("frequency")).drop("_range", "_within", "_edge")


def page_quality(pages: DataFrame, known: DataFrame, *key: str) -> DataFrame:
    """The nine measures of each page (key..., text): counts, ratios, and the shares of known and one-letter words.

    Words are counted by an equi-join of distinct words with the lexicon, so lexica of any size serve; shares are null without words.
    """
    t = F.col("text")
    n = text.char_stats(t)
    base = pages.select(
        *key,
        (n["arabic_letters"] + n["latin_letters"] + n["ascii_digits"] + n["arabic_indic_digits"]).alias("content_chars"),
        text.ratio(n["presentation_forms"], n["presentation_forms"] + n["arabic_letters"], 4).alias("presform_ratio"),
        text.ratio(n["bidi_controls"] * 1000, n["chars"], 2).alias("bidi_per_1k"),
        text.ratio(n["c0_controls"] * 1000, n["chars"], 2).alias("c0_per_1k"),
        n["replacement_chars"].alias("replacement_chars"),
        text.cid_placeholders(t).alias("cid_placeholders"),
    )
    words = pages.select(*key, F.explode(tokens.arabic_tokens(t)).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("times"))
    judged = words.join(known.select("word", F.lit(1).alias("known")), "word", "left")
    shares = judged.groupBy(*key).agg(
        F.sum("times").alias("arabic_tokens"),
        (F.sum(F.when(F.col("known") == 1, F.col("times")).otherwise(0)) / F.sum("times")).alias("token_validity"),
        (F.sum(F.when(F.length("word") == 1, F.col("times")).otherwise(0)) / F.sum("times")).alias("single_letter_share"),
    )
    return base.join(shares, list(key), "left").fillna(0, ["arabic_tokens"])


#: (name, what fails) of each rule, in the order in which failures are told.
GATE = [
    ("no_arabic_words", "arabic_tokens = 0"),
    ("too_few_words", f"arabic_tokens between 1 and {MIN_WORDS - 1}"),
    ("cid_placeholders", "cid_placeholders > 0"),
    ("replacement_characters", "replacement_chars > 0"),
    ("token_validity", f"token_validity < {MIN_VALIDITY}"),
]


def gate(quality: DataFrame, rules: list[tuple[str, str]] = GATE) -> DataFrame:
    """Adds verdict (trusted, untrusted, no_arabic_text) and rejected_by, all rules (name, what fails) that failed."""
    failed = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in rules)))
    verdict = F.when(F.array_contains("rejected_by", "no_arabic_words"), "no_arabic_text").when(F.size("rejected_by") > 0, "untrusted").otherwise("trusted")
    return quality.withColumn("rejected_by", failed).withColumn("verdict", verdict)


def document_paths(verdicts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, pages, trusted, no_arabic, path): text_layer where most pages with Arabic text are trusted."""
    counted = verdicts.groupBy(doc).agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "trusted").alias("trusted"), F.count_if(F.col("verdict") == "no_arabic_text").alias("no_arabic"))
    return counted.withColumn("path", F.when(F.col("trusted") * 2 > F.col("pages") - F.col("no_arabic"), "text_layer").otherwise("ocr"))


def page_methods(verdicts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds method: a page's text layer is used if it is trusted and its document's is."""
    paths = document_paths(verdicts, doc).select(doc, "path")
    return verdicts.join(paths, doc).withColumn("method", F.when((F.col("path") == "text_layer") & (F.col("verdict") == "trusted"), "text_layer").otherwise("ocr"))


def needs_rereading(read_words: Column, layer_words: Column) -> Column:
    """A reading with under half of a text layer's words, where the layer has ten or more."""
    return (layer_words >= 10) & (read_words < 0.5 * layer_words)


def document_stats(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Character counts of documents whose pages are joined by line feeds, and characters a page."""
    stats = text.char_stats(F.col("text"))
    each = pages.select(doc, *(c.alias(k) for k, c in stats.items()))
    joined = F.sum("chars") + F.count("*") - 1
    return each.groupBy(doc).agg(F.count("*").alias("pages"), joined.alias("chars"), *(F.sum(k).alias(k) for k in text.CLASSES), F.round(joined / F.count("*"), 1).alias("chars_per_page"))


def runs_survive(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, total, intact, reversed, missing) of the distinct digit and Latin runs of a truth in what was extracted.

    Runs of one character, and those that read the same backwards, are not counted.
    """
    runs = truth.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+|[A-Za-z]+)"), 1))).alias("run")).where((F.length("run") > 1) & (F.reverse("run") != F.col("run")))
    both = runs.join(found.select(key, F.col("text").alias("got")), key, "left")
    intact = F.coalesce(F.col("got").contains(F.col("run")), F.lit(False))
    turned = ~intact & F.coalesce(F.col("got").contains(F.reverse("run")), F.lit(False))
    return both.groupBy(key).agg(F.count("*").alias("total"), F.count_if(intact).alias("intact"), F.count_if(turned).alias("reversed"), F.count_if(~intact & ~turned).alias("missing"))


def separation(calibration: DataFrame, by: str = "cutoff") -> DataFrame:
    """(by, sound_low, broken_high, gap): how far apart the validity of sound pages (precision 0.9 on) and broken ones lies."""
    sound = F.col("precision") >= 0.9
    low, high = F.min(F.when(sound, F.col("validity"))), F.max(F.when(~sound, F.col("validity")))
    return calibration.groupBy(by).agg(low.alias("sound_low"), high.alias("broken_high"), F.round(low - high, 6).alias("gap"))


def agreement(predicted: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """(key, predicted, decided, agree) of two routings."""
    return predicted.select(key, F.col("path").alias("predicted")).join(decided.select(key, F.col("path").alias("decided")), key).withColumn("agree", F.col("predicted") == F.col("decided"))



def inspected(pages: DataFrame) -> DataFrame:
    """(doc_id, page, by, letters, words): Arabic letters and words of pages as several parsers read them (doc_id, page, by, text)."""
    own = normalize.for_comparison(F.col("text"))
    return pages.select("doc_id", "page", "by", F.regexp_count(own, F.lit("[ء-غف-ي]")).cast("int").alias("letters"), F.size(tokens.arabic_tokens(F.col("text"))).alias("words"))
