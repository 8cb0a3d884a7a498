"""Measures of answered questions: citations, numbers, agreement with evidence, and what runs come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.normalize import collapse_whitespace, for_comparison

# Labels a judge may give.
VERDICTS = ("CORRECT", "PARTIAL", "WRONG", "REFUSED")


def cited(answer: Column, sources: Column) -> Column:
    """struct(known, unknown): the numbers an answer cites that its sources have, and those they don't, in order."""
    all_ = text.citations(answer)
    return F.struct(F.filter(all_, lambda n: (n >= 1) & (n <= F.size(sources))).alias("known"), F.filter(all_, lambda n: (n < 1) | (n > F.size(sources))).alias("unknown"))


def cited_sources(known: Column, sources: Column) -> Column:
    """The sources that the known citations name."""
    return F.transform(known, lambda n: F.element_at(sources, n))


def citation_measures(cited_ids: Column, holders: Column) -> Column:
    """struct(precision, recall): cited chunks that hold a quote; quotes that a cited chunk holds. 0 where there is nothing.

    holders: an array per quote of the chunks that hold it.
    """
    useful = F.filter(cited_ids, lambda c: F.exists(holders, lambda h: F.array_contains(h, c)))
    found = F.filter(holders, lambda h: F.arrays_overlap(h, cited_ids))
    rate = lambda a, b: F.when(F.size(b) > 0, F.size(a) / F.size(b)).otherwise(0.0)
    return F.struct(rate(useful, cited_ids).alias("precision"), rate(found, holders).alias("recall"))


def verdict(c: Column, labels: tuple[str, ...] = VERDICTS) -> Column:
    """The last verdict written in a judge's reply, or null."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)VERDICT\W*(" + "|".join(labels) + r")\b"), 1)
    return F.upper(F.try_element_at(found, F.lit(-1)))


def hand_label(c: Column, labels: tuple[str, ...] = VERDICTS) -> Column:
    """A label written in full or by its first letter, or null."""
    own = F.upper(F.trim(c))
    chain = None
    for x in labels:
        hit = own.isin(x, x[0])
        chain = F.when(hit, x) if chain is None else chain.when(hit, x)
    return chain


def source_block(number: Column, title: Column, page: Column, heading: Column, clause: Column, body: Column) -> Column:
    """A numbered source as it is shown to a model; attributes only where there are any."""
    head = F.concat_ws(" | ", F.concat(F.lit("["), number, F.lit("]")), title, F.concat(F.lit("p. "), page), heading, F.concat(F.lit("clause "), clause))
    return F.concat(head, F.lit("\n"), body)


def readable_ranges(c: Column) -> Column:
    """A short date range (y/m/d-d, higher end first as printed right to left) spelled in full, lower end first."""
    shape = r"(\d{4})/(\d{1,2})/(\d{1,2})-(\d{1,2})(?!\d|/)"
    y, m, a, b = (F.regexp_extract(c, shape, i) for i in (1, 2, 3, 4))
    low, high = F.least(a.cast("int"), b.cast("int")), F.greatest(a.cast("int"), b.cast("int"))
    day = lambda d: F.concat(y, F.lit("/"), m, F.lit("/"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(c.rlike(shape), F.regexp_replace(c, F.regexp_extract(c, shape, 0), F.concat(day(low), F.lit(" - "), day(high)))).otherwise(c)


def reply(body: Column) -> DataFrame | Column:
    """struct(text, finish, tokens_in, tokens_out, tokens_thinking) of a model service's JSON reply; thoughts are left out."""
    shape = (
        "candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>,"
        "promptFeedback struct<blockReason:string>,usageMetadata struct<promptTokenCount:int,candidatesTokenCount:int,thoughtsTokenCount:int>"
    )
    own = F.from_json(body, shape)
    first = F.try_element_at(own["candidates"], F.lit(1))
    parts = F.filter(first["content"]["parts"], lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    finish = F.when(first.isNull(), F.coalesce(F.concat(F.lit("BLOCKED: "), own["promptFeedback"]["blockReason"]), F.lit("NO_CANDIDATE"))).otherwise(first["finishReason"])
    usage = own["usageMetadata"]
    return F.struct(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), finish.alias("finish"), usage["promptTokenCount"].alias("tokens_in"),
        usage["candidatesTokenCount"].alias("tokens_out"), F.coalesce(usage["thoughtsTokenCount"], F.lit(0)).alias("tokens_thinking"),
    )


def retry_delay(c: Column) -> Column:
    """Seconds that a service asks to wait: its retryDelay, or 'retry in 1h2m3.4s'; null if it says none."""
    told = F.regexp_extract(c, r'"retryDelay"\s*:\s*"([\d.]+)s"', 1)
    shape = r"(?i)retry in (?:(\d+)h)?(?:(\d+)m)?([\d.]+)s"
    part = lambda i, n: F.coalesce(F.when(F.regexp_extract(c, shape, i) != "", F.regexp_extract(c, shape, i).cast("double")), F.lit(0.0)) * n
    return F.when(told != "", told.cast("double")).when(c.rlike(shape), part(1, 3600) + part(2, 60) + part(3, 1))


def run_summary(runs: DataFrame, by: str = "arm") -> DataFrame:
    """What runs come to by arm: answered, cited, shares as hits/total, tokens, and the middle time by nearest rank.

    runs: by, text, finish, tokens_in, tokens_out, seconds.
    """
    from .evaluation import nearest_rank

    said = F.length(collapse_whitespace(F.coalesce("text", F.lit("")))) > 0
    quoted = F.size(text.citations(F.coalesce(F.col("text"), F.lit("")))) > 0
    share = lambda hits: F.concat_ws("/", F.count_if(hits).cast("string"), F.count("*").cast("string"))
    sums = runs.groupBy(by).agg(F.count("*").alias("questions"), share(said).alias("answered"), share(quoted).alias("cited"), F.count_if(F.col("finish") == "MAX_TOKENS").alias("cut"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    times = nearest_rank(runs, "seconds", [by], {"p50": 0.5, "p95": 0.95}).drop("n")
    return sums.join(times, by, "left")


def names_phrase(answer: Column, phrases: list[str]) -> Column:
    """Whether an answer holds one of the fixed phrases, or is blank."""
    return (F.length(F.trim(F.coalesce(answer, F.lit("")))) == 0) | text.says(answer, phrases)


def grounded_terms(answer: Column, sources: Column) -> Column:
    """The share of an answer's words, as compared, that its sources' texts hold; null without words."""
    own = F.array_distinct(F.regexp_extract_all(for_comparison(F.regexp_replace(answer, r"\[[^\]]*\]", " ")), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    held = F.regexp_extract_all(for_comparison(F.array_join(sources, " ")), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, held)) / F.size(own))


def run_measures(runs: DataFrame, gold: DataFrame, holders: DataFrame) -> DataFrame:
    """Runs (qid, answer, sources) with what their citations and numbers come to: cited, cited_unknown, cited_ids, precision, recall, numeric_exact.

    gold: qid, answer_numeric; holders: qid, quote_no, chunk_ids (the chunks that hold the quote).
    """
    held = holders.groupBy("qid").agg(F.collect_list("chunk_ids").alias("holders"))
    both = runs.join(gold.select("qid", "answer_numeric"), "qid").join(held, "qid", "left").withColumn("c", cited(F.coalesce("answer", F.lit("")), F.col("sources")))
    both = both.withColumn("cited_ids", cited_sources(F.col("c.known"), F.col("sources")))
    measured = F.when(F.col("holders").isNotNull() & (F.size("cited_ids") > 0), citation_measures(F.col("cited_ids"), F.col("holders")))
    exact = F.when(F.col("answer_numeric").isNotNull(), text.states_number(F.coalesce("answer", F.lit("")), F.col("answer_numeric")))
    return both.select(*runs.columns, F.col("c.known").alias("cited"), F.col("c.unknown").alias("cited_unknown"), "cited_ids", measured["precision"].alias("precision"), measured["recall"].alias("recall"), exact.alias("numeric_exact"))


def hit_share(hits: Column, of: Column) -> Column:
    """"hits/total" of the rows ``of`` holds for, "-" without any."""
    of, hits = F.coalesce(of, F.lit(False)), F.coalesce(hits, F.lit(False))
    return F.when(F.count_if(of) > 0, F.concat_ws("/", F.count_if(of & hits).cast("string"), F.count_if(of).cast("string"))).otherwise("-")


def arm_summary(records: DataFrame, by: str = "arm") -> DataFrame:
    """What arms come to, a row each.

    records: by, behaviour, declined, gap_named, cited, cited_unknown, precision, recall, numeric_exact, attempts, tokens_in,
    tokens_out, seconds.  Questions to be answered are those whose behaviour is neither refusal nor naming a gap.
    """
    c = F.col
    answerable = ~c("behaviour").isin("refuse", "answer_and_name_gap")
    flow = c(by) == "flow"
    return records.groupBy(by).agg(
        hit_share(~c("declined"), answerable).alias("answered"),
        hit_share((F.size("cited") > 0) & (F.size("cited_unknown") == 0), answerable & ~c("declined") & (c(by) != "A")).alias("cited"),
        F.round(F.avg(F.when(answerable, c("precision"))), 4).alias("precision"), F.round(F.avg(F.when(answerable, c("recall"))), 4).alias("recall"),
        hit_share(c("numeric_exact"), answerable & c("numeric_exact").isNotNull()).alias("numbers"),
        hit_share(c("declined"), c("behaviour") == "refuse").alias("refused"),
        hit_share(~c("declined") & c("gap_named"), c("behaviour") == "answer_and_name_gap").alias("gap_named"),
        hit_share(c("declined"), answerable).alias("declined_wrongly"), hit_share(c("gap_named"), answerable).alias("gap_on_answerable"),
        hit_share(c("attempts") > 1, flow).alias("retried"), hit_share(c("attempts") == 0, flow).alias("refused_unasked"),
        F.round(F.avg("tokens_in"), 4).alias("tokens_in"), F.round(F.avg("tokens_out"), 4).alias("tokens_out"), F.median("seconds").alias("p50"),
    )


def quality_table(judged: DataFrame, by: str = "run") -> DataFrame:
    """(by, n, accuracy, correct_or_partial, wrong_outside): what judges said of runs (by, judge, behaviour); shares as hits/total."""
    c, every = F.col, F.lit(True)
    return judged.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((c("judge") == "correct").cast("int")), 6).alias("accuracy"), hit_share(c("judge").isin("correct", "partial"), every).alias("correct_or_partial"), hit_share(c("judge") == "wrong", c("behaviour") == "refuse").alias("wrong_outside"))


def cost_table(runs: DataFrame, by: str = "run") -> DataFrame:
    """(by, p50, p95, tokens_in, tokens_out): times by nearest rank, and tokens a question."""
    from .evaluation import nearest_rank

    sums = runs.groupBy(by).agg(F.round(F.avg("tokens_in"), 4).alias("tokens_in"), F.round(F.avg("tokens_out"), 4).alias("tokens_out"))
    return nearest_rank(runs, "seconds", [by], {"p50": 0.5, "p95": 0.95}).drop("n").join(sums, by)


def type_table(judged: DataFrame, labels: list[str], by: str = "run", kind: str = "type") -> DataFrame:
    """(by, kind, n, a column per label, accuracy): judges' labels of each kind of question."""
    counts = judged.groupBy(by, kind).pivot("judge", labels).count().fillna(0, labels)
    n = sum((F.col(x) for x in labels), F.lit(0))
    return counts.withColumn("n", n).withColumn("accuracy", F.round(F.col(labels[0]) / F.col("n"), 6))


def declines(answer: Column, cited_numbers: Column, decline: list[str], gap: list[str]) -> Column:
    """Whether an answer declines: blank, one of the phrases that decline, or naming a gap while citing nothing."""
    return names_phrase(answer, decline) | (text.says(answer, gap) & (F.coalesce(F.size(cited_numbers), F.lit(0)) == 0))


def prompt(question: Column, blocks: Column, note: Column | None = None) -> Column:
    """What a model is asked: numbered sources, a note if there is any, and the question; without sources the question alone."""
    asked = F.concat(F.lit("Question: "), question)
    listed = F.concat(F.lit("<sources>\n"), F.array_join(blocks, "\n"), F.lit("\n</sources>\n\n"))
    noted = F.coalesce(F.concat(note, F.lit("\n\n")), F.lit("")) if note is not None else F.lit("")
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) == 0, asked).otherwise(F.concat(listed, noted, asked))


def ledger(exchanges: DataFrame) -> DataFrame:
    """What asking cost in tokens and time: a line an exchange that was really asked, with the request's key.

    exchanges: at, model, model_version, purpose, prompt, system, tokens_in, tokens_out, tokens_thinking, seconds, finish, cached.
    """
    key = F.substring(F.sha2(F.to_json(F.struct("model", "prompt", "system", "max_tokens", "temperature")), 256), 1, 16)
    asked = exchanges.where("not coalesce(cached, false)")
    return asked.select("at", "model", F.col("model_version").alias("version"), "purpose", key.alias("request"), "tokens_in", "tokens_out", "tokens_thinking", "seconds", "finish")
