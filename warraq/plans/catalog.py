"""The engine's queries by name, and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, text, tokens
from ..operators import answers, calendars, evaluation, flow, gold, labels, layout, quality, retrieval, stores, structure
from ..session import spread, table
from ..streaming import logs
from . import golden as _golden  # noqa: F401 (registers its queries)
from . import sql as S
from .registry import QUERIES, SQL, query

#: Searches ask with every row whose id this divides, against all rows.
ASKS_EVERY = 50


def _both(name: str, sql: str, *names: str) -> None:
    """A query that is the same SQL in both engines, over the tables named."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in names:
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    query(sql)(run)


# ------------------------------------------------------------------ retrieval


def _search(spark: SparkSession, d: str, k: int = 10, **switches: bool) -> DataFrame:
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    asked = table(spark, d, "documents").where(F.col("doc_id") % ASKS_EVERY == 0).select(F.col("doc_id").alias("q_id"), F.coalesce("title", F.lit("")).alias("title"))
    return retrieval.bm25(docs, asked, tokens.terms(F.col("text"), **switches), tokens.terms(F.col("title"), **switches), k)


_BM25 = f"""
    with docs as (select doc_id, {S.terms('text')} as ts from documents),
    size as (select count(*) as n, avg(len(ts)) as mean from docs),
    tf as (select doc_id, term, count(*) as tf, any_value(length) as length from (select doc_id, len(ts) as length, unnest(ts) as term from docs) group by 1, 2),
    df as (select term, count(*) as df from tf group by 1),
    asked as (select doc_id as q_id, unnest({S.terms("coalesce(title, '')")}) as term from documents where doc_id % {ASKS_EVERY} = 0),
    wanted as (select q_id, term, count(*) as times from asked group by 1, 2),
    scored as (
        select q_id, doc_id as item_id,
               round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) as score
        from wanted join tf using (term) join df using (term), size group by 1, 2)
    select * from (select q_id, item_id, row_number() over (partition by q_id order by score desc, item_id) as rank, score from scored) where rank <= 10
"""


@query(_BM25)
def bm25_topk(spark, d):
    """The ten best documents for each asked title."""
    return _search(spark, d)


_KNOWN = f"""
    with docs as (select doc_id, {{terms}} as ts from documents),
    size as (select count(*) as n, avg(len(ts)) as mean from docs),
    tf as (select doc_id, term, count(*) as tf, any_value(length) as length from (select doc_id, len(ts) as length, unnest(ts) as term from docs) group by 1, 2),
    df as (select term, count(*) as df from tf group by 1),
    asked as (select doc_id as q_id, unnest({{title}}) as term from documents where doc_id % {ASKS_EVERY} = 0),
    wanted as (select q_id, term, count(*) as times from asked group by 1, 2),
    scored as (select q_id, doc_id as item_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) as score
        from wanted join tf using (term) join df using (term), size group by 1, 2),
    ranked as (select q_id, item_id, row_number() over (partition by q_id order by score desc, item_id) as rank from scored)
    select '{{name}}' as analyzer, count(*) as questions, count(*) filter (rank <= 1) as at_1, count(*) filter (rank <= 5) as at_5, count(*) filter (rank <= 10) as at_10
    from (select distinct doc_id from documents where doc_id % {ASKS_EVERY} = 0) a left join ranked on q_id = doc_id and item_id = doc_id and rank <= 10
"""
_ANALYZERS = {"as written": (False, False, False), "normalized": (True, False, False), "stopwords": (True, True, False), "stemmed": (True, True, True)}


@query(" union all ".join("select * from (" + _KNOWN.format(name=k, terms=S.terms("text", *v), title=S.terms("coalesce(title, '')", *v)) + ")" for k, v in _ANALYZERS.items()))
def bm25_ablation(spark, d):
    """How often each analyzer finds the document whose title is asked, among the first one, five and ten."""
    asked = table(spark, d, "documents").where(F.col("doc_id") % ASKS_EVERY == 0).select(F.col("doc_id").alias("q_id")).distinct()
    rows = None
    for name, (norm, stop, stem) in _ANALYZERS.items():
        own = _search(spark, d, normalize=norm, stopwords=stop, stem=stem).where("item_id = q_id").select("q_id", "rank")
        both = asked.join(own, "q_id", "left")
        part = both.agg(F.count("*").alias("questions"), *(F.count_if(F.col("rank") <= k).alias(f"at_{k}") for k in (1, 5, 10))).select(F.lit(name).alias("analyzer"), "questions", "at_1", "at_5", "at_10")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _ranked_sql(name: str, steps: tuple[bool, bool, bool]) -> str:
    own = _KNOWN.format(name="", terms=S.terms("text", *steps), title=S.terms("coalesce(title, '')", *steps))
    return f"{name} as (select * from ({own[: own.rindex('select ' + chr(39))].rstrip()} select q_id, item_id, rank from ranked where rank <= 100))"


@query(
    f"""with {_ranked_sql("a", _ANALYZERS["stemmed"])}, {_ranked_sql("b", _ANALYZERS["as written"])}, merged as (select *, 0 as ranking from a union all select *, 1 from b),
    fused as (select q_id, item_id, round(sum(1.0::double / (60 + rank)), 9) as score, min((ranking, rank)) as first from merged group by 1, 2)
    select q_id, item_id, rank, score from (select q_id, item_id, score, row_number() over (partition by q_id order by score desc, first) as rank from fused) where rank <= 20"""
)
def lexical_fusion(spark, d):
    """BM25 under the full analyzer and of the words as written, fused."""
    full, plain = _search(spark, d, k=100), _search(spark, d, k=100, normalize=False, stopwords=False, stem=False)
    return retrieval.fuse([full, plain], 20)


@query(
    f"""with toks as (select doc_id, {S.terms('text')} as ts from documents)
    select term, count(distinct doc_id) as df, round(ln(1 + ((select count(*) from documents) - count(distinct doc_id) + 0.5) / (count(distinct doc_id) + 0.5)), 6) as idf
    from (select doc_id, unnest(ts) as term from toks) group by 1"""
)
def bm25_idf(spark, d):
    """Document frequency and idf of every index term."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    n = docs.count()
    df = retrieval.postings(docs, tokens.terms(F.col("text"))).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.round(retrieval.idf(F.lit(n), F.col("df")), 6))


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), e.where(F.col("vec_id") % ASKS_EVERY == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vector"))


_DOT = "list_sum(list_transform(list_zip(a.embedding{0}, b.embedding{0}), lambda p: p[1]::double * p[2]::double))"
_NEAREST = """select q_id, item_id, rank, score from (
    select q_id, item_id, score, row_number() over (partition by q_id order by score desc, item_id) as rank from (
        select a.vec_id as q_id, b.vec_id as item_id, round(DOT, 6) as score from embeddings a, embeddings b where a.vec_id % 50 = 0)) where rank <= KK"""


@query(_NEAREST.replace("DOT", _DOT.format("")).replace("KK", "10"))
def dense_topk(spark, d):
    """The ten nearest vectors by dot product."""
    return retrieval.dense(*_vectors(spark, d), k=10)


def _two(spark, d):
    corpus, asked = _vectors(spark, d)
    return retrieval.dense(corpus, asked, k=100), retrieval.dense(corpus, asked, k=100, dimensions=32)


_RANKINGS = f"""with a as ({_NEAREST.replace("DOT", _DOT.format("")).replace("KK", "100")}), b as ({_NEAREST.replace("DOT", _DOT.format("[1:32]")).replace("KK", "100")}),
    merged as (select *, 0 as ranking from a union all select *, 1 from b),
    fused as (select q_id, item_id, round(sum(1.0::double / (60 + rank)), 9) as score, min((ranking, rank)) as first from merged group by 1, 2),
    ranked as (select q_id, item_id, score, row_number() over (partition by q_id order by score desc, first) as rank from fused)"""


@query(f"{_RANKINGS} select q_id, item_id, rank, score from ranked where rank <= 20")
def rrf_topk(spark, d):
    """Two rankings fused by reciprocal ranks."""
    return retrieval.fuse(list(_two(spark, d)), 20)


@query(f"{_RANKINGS} select q_id, item_id, row_number() over (partition by q_id order by rank > 20, case when rank <= 20 then item_id % 7 end desc, rank) as rank from ranked qualify rank <= 30")
def rerank_head(spark, d):
    """The head of the fused ranking in the order of another score."""
    fused = retrieval.fuse(list(_two(spark, d)))
    scores = fused.select("q_id", "item_id", (F.col("item_id") % 7).cast("double").alias("score"))
    return retrieval.rerank(fused, scores).where("old <= 30 or rank <= 30").where("rank <= 30").select("q_id", "item_id", "rank")


@query(f"{_RANKINGS} select q_id, item_id, rank from (select q_id, item_id, row_number() over (partition by q_id order by rank > 20, case when rank <= 20 then item_id % 7 end desc, rank) as rank from ranked) where rank <= 5")
def hybrid_cascade(spark, d):
    """A hundred candidates of each retriever, fused, reranked, cut to five."""
    a, b = _two(spark, d)
    scores = retrieval.pool([a, b]).select("q_id", "item_id", (F.col("item_id") % 7).cast("double").alias("score"))
    return retrieval.hybrid([a, b], scores).select("q_id", "item_id", "rank")


@query(f"{_RANKINGS} select q_id, item_id, row_number() over (partition by q_id order by first) as first from fused")
def rerank_pool(spark, d):
    """The distinct candidates of both rankings, in the order first seen."""
    return retrieval.pool(list(_two(spark, d)))


# ------------------------------------------------------------------ evaluation


@query(
    f"""with near as ({_NEAREST.replace("DOT", _DOT.format("")).replace("KK", "20")}),
    ranks as (select q_id as qid, q.label as label, b.label = q.label as good, rank from near join embeddings q on q.vec_id = q_id join embeddings b on b.vec_id = item_id),
    per as (select qid, label, {", ".join(f"max(case when good and rank <= {k} then 1.0 else 0.0 end) as recall_{k}, max(case when good and rank <= {k} then 1.0 else 0.0 end) as complete_{k}" for k in evaluation.CUTS)},
        coalesce(1.0 / min(case when good and rank <= 10 then rank end), 0.0) as rr_10, max(case when good then 1 else 0 end) as held from ranks group by 1, 2)
    select label, count(*) as questions, round(1 - sum(1 - held) / count(*), 6) as held, {", ".join(f"round(avg(recall_{k}), 6) as recall_{k}, round(avg(complete_{k}), 6) as complete_{k}" for k in evaluation.CUTS)}, round(avg(rr_10), 6) as mrr_10
    from per group by grouping sets ((), (label))"""
)
def recall_by_label(spark, d):
    """Recall, completeness and reciprocal rank of the dense ranking, where a vector of the same label is relevant: overall and by label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    near = retrieval.dense(*_vectors(spark, d), k=20)
    both = near.join(e.select(F.col("vec_id").alias("q_id"), "label"), "q_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("other")), "item_id")
    best = both.groupBy(F.col("q_id").alias("qid"), "label").agg(F.min(F.when(F.col("label") == F.col("other"), F.col("rank"))).alias("rank")).withColumn("held", F.col("rank").isNotNull())
    per = evaluation.per_question(best).join(best.select("qid", "label"), "qid")
    return evaluation.summary(per, "label")


_CONFIGS = f"""{_RANKINGS}, c as (select 'full' as config, q_id, item_id, rank from a union all select 'short', q_id, item_id, rank from b union all select 'fused', q_id, item_id, rank from ranked),
    per as (select config, q_id, max(case when b.label = q.label and rank <= 1 then 1.0 else 0.0 end) as r1, max(case when b.label = q.label and rank <= 5 then 1.0 else 0.0 end) as r5, max(case when b.label = q.label and rank <= 10 then 1.0 / rank else 0.0 end) as rr
        from c join embeddings q on q.vec_id = q_id join embeddings b on b.vec_id = item_id where q_id <> item_id group by 1, 2)
    select config, count(*) as questions, round(avg(r1), 6) as recall_1, round(avg(r5), 6) as recall_5, round(avg(rr), 6) as mrr_10 from per group by 1"""


@query(_CONFIGS)
def hybrid_evaluation(spark, d):
    """Recall and reciprocal rank of two rankings and of their fusion, where another vector of the same label is relevant."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    a, b = _two(spark, d)
    made = None
    for name, r in (("full", a), ("short", b), ("fused", retrieval.fuse([a, b]))):
        own = r.where("q_id <> item_id").join(e.select(F.col("vec_id").alias("q_id"), "label"), "q_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("other")), "item_id")
        best = own.groupBy(F.col("q_id").alias("qid")).agg(F.min(F.when(F.col("label") == F.col("other"), F.col("rank"))).alias("rank")).withColumn("held", F.col("rank").isNotNull()).withColumn("quote_no", F.lit(1))
        part = evaluation.summary(evaluation.per_question(best)).select(F.lit(name).alias("config"), "questions", "recall_1", "recall_5", "mrr_10")
        made = part if made is None else made.unionByName(part)
    return made


_EW = lambda x: f"' ' || array_to_string(regexp_extract_all({S.norm(x)}, '\\p{{Nd}}+|[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), ' ') || ' '"


def _evidence_chunks(spark, d):
    return table(spark, d, "units").dropDuplicates(["unit_id"]).select(F.col("unit_id").alias("chunk_id"), "doc_id", "page", tokens.evidence_words(F.col("text")).alias("words"))


def _evidence(spark, d):
    first = F.array_join(F.slice(F.split(F.element_at("texts", 1), " "), 1, 6), " ")
    quotes = table(spark, d, "drafts").where(F.size("texts") > 0).select(F.col("draft_id").alias("qid"), F.lit(1).alias("quote_no"), "doc_id", "page", F.array(tokens.evidence_words(first)).alias("parts"))
    return evaluation.evidence(quotes, _evidence_chunks(spark, d))


@query(
    f"""with u as (select distinct unit_id, doc_id, page, {_EW('text')} as words from units),
    q as (select draft_id as qid, doc_id, page, {_EW("array_to_string(string_split(texts[1], ' ')[1:6], ' ')")} as part from drafts where len(texts) > 0)
    select qid, 1 as quote_no, count(unit_id) as holders, min(unit_id) as first from q left join u on q.doc_id = u.doc_id and q.page = u.page and contains(words, part) group by 1"""
)
def evidence_holders(spark, d):
    """How many units of its page hold a draft's opening words."""
    return _evidence(spark, d).groupBy("qid", "quote_no").agg(F.count("chunk_id").alias("holders"), F.min("chunk_id").alias("first"))


@query(
    f"""with u as (select distinct unit_id, doc_id, page, {_EW('text')} as words from units),
    t as (select draft_id, doc_id, page, unnest(texts) as text, generate_subscripts(texts, 1) as quote_no from (select distinct draft_id, doc_id, page, texts from drafts)),
    q as (select draft_id as qid, quote_no, doc_id, page, {_EW('text')} as part from t)
    select qid, quote_no, count(unit_id) as holders, min(unit_id) as first from q left join u on q.doc_id = u.doc_id and q.page = u.page and contains(words, part) group by 1, 2"""
)
def evidence_elements(spark, d):
    """How many units of its page hold the whole of each element of a draft."""
    drafts = table(spark, d, "drafts").dropDuplicates(["draft_id"]).select(F.col("draft_id").alias("qid"), "doc_id", "page", F.posexplode("texts").alias("i", "text"))
    quotes = drafts.select("qid", (F.col("i") + 1).alias("quote_no"), "doc_id", "page", F.array(tokens.evidence_words(F.col("text"))).alias("parts"))
    return evaluation.evidence(quotes, _evidence_chunks(spark, d)).groupBy("qid", "quote_no").agg(F.count("chunk_id").alias("holders"), F.min("chunk_id").alias("first"))


@query(
    """with n as (select purpose, seconds as v, row_number() over (partition by purpose order by seconds) as r, count(*) over (partition by purpose) as n from exchanges where seconds is not null)
    select purpose, max(n) as n, max(case when r = greatest(1, least(n, round_even(n * 0.5, 0)::bigint)) then v end) as p50, max(case when r = greatest(1, least(n, round_even(n * 0.95, 0)::bigint)) then v end) as p95 from n group by 1"""
)
def time_percentiles(spark, d):
    """Nearest-rank percentiles of seconds by purpose."""
    return evaluation.nearest_rank(table(spark, d, "exchanges"), "seconds", ["purpose"], {"p50": 0.5, "p95": 0.95})


@query("select purpose, count(seconds) as n, round(avg(seconds), 9) as mean, true as inside from (select distinct exchange_id, purpose, seconds from exchanges) group by 1")
def bootstrap_seconds(spark, d):
    """Mean seconds of each purpose, and whether its seeded bootstrap interval holds it."""
    made = evaluation.hashed_bootstrap(table(spark, d, "exchanges").dropDuplicates(["exchange_id"]), "seconds", "purpose", "exchange_id")
    return made.select("purpose", "n", F.round("mean", 9).alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("inside"))


_SCORED = "select qid, case when purpose = 'judge' then 'refuse' else lower(purpose) end as behaviour, max(seconds) as score from exchanges where seconds is not null group by 1, 2"


def _scored(spark, d):
    """Exchanges as questions with a score: the judges' stand for those to be refused, the longest wait for the score."""
    e = table(spark, d, "exchanges").where("seconds is not null")
    return e.groupBy("qid", F.when(F.col("purpose") == "judge", "refuse").otherwise(F.lower("purpose")).alias("behaviour")).agg(F.max("seconds").alias("score"))


@query(f"select min(score) as lowest, floor((min(score) - 1) * 2) / 2 as threshold from ({_SCORED}) where behaviour <> 'refuse'")
def refusal_threshold(spark, d):
    """The score under which questions are refused unasked, from the least that should be answered."""
    return flow.refusal_threshold(_scored(spark, d))


@query(f"select behaviour, count(*) as questions, min(score) as lowest, round(median(score), 9) as median, max(score) as highest from ({_SCORED}) group by 1")
def score_spread(spark, d):
    """How scores lie by expected behaviour."""
    return flow.score_spread(_scored(spark, d)).withColumn("median", F.round("median", 9))


@query(f"select threshold::double as threshold, count(*) filter (score < threshold and behaviour <> 'refuse') as wrongly, count(*) filter (score < threshold and behaviour = 'refuse') as rightly, count(*) filter (behaviour <> 'refuse') as to_answer, count(*) filter (behaviour = 'refuse') as to_refuse from ({_SCORED}), (select unnest([1.0, 2.5, 5.0, 10.0]) as threshold) group by 1")
def threshold_sweep(spark, d):
    """How many questions each threshold refuses, wrongly and rightly."""
    return flow.threshold_sweep(_scored(spark, d), [1.0, 2.5, 5.0, 10.0])


@query(f"select qid, behaviour, score from ({_SCORED}) where behaviour = 'refuse' order by score, qid limit 5")
def lowest_scores(spark, d):
    """The five questions of the least score."""
    return flow.lowest(_scored(spark, d).where("behaviour = 'refuse'")).select("qid", "behaviour", "score")


@query(
    "with e as (select distinct exchange_id, qid, purpose, seconds from exchanges), a as (select qid, avg(seconds) as a from e where purpose = 'arm C' group by 1), b as (select qid, avg(seconds) as b from e where purpose in ('arm A', 'arm B', 'arm C') group by 1) select count(*) as n, round(avg(a - b), 6) as mean, true as inside from a join b using (qid)"
)
def paired_difference(spark, d):
    """The mean difference of an arm from all arms, question by question, and whether its interval holds it."""
    e = table(spark, d, "exchanges").dropDuplicates(["exchange_id"])
    a = e.where("purpose = 'arm C'").groupBy("qid").agg(F.avg("seconds").alias("s"))
    b = e.where("purpose in ('arm A', 'arm B', 'arm C')").groupBy("qid").agg(F.avg("seconds").alias("s"))
    m = evaluation.paired_interval(a, b, "qid", "s", 2000)
    return m.select("n", F.round("mean", 6).alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("inside"))


_LANG = "case when regexp_matches(text, '[\\x{600}-\\x{6ff}]') then 'ar' else 'en' end"


@query(f"select lang, count(*) filter ({_LANG} = 'ar') as ar, count(*) filter ({_LANG} = 'en') as en from documents where lang in ('ar', 'en') group by 1")
def confusion_language(spark, d):
    """Languages as declared against languages as detected."""
    own = table(spark, d, "documents").where(F.col("lang").isin("ar", "en")).select("lang", text.language(F.col("text")).alias("found"))
    return evaluation.confusion(own, "lang", "found", ["ar", "en"])


@query(
    f"""with p as (select lang as a, {_LANG} as b from documents where lang is not null and text is not null), c as (select a, b, count(*) as n from p group by 1, 2),
    t as (select sum(n)::bigint as n, sum(case when a = b then n else 0 end)::bigint as agreed from c),
    e as (select sum(x * y) as chance from (select a, sum(n) as x from c group by 1) r join (select b as a, sum(n) as y from c group by 1) s using (a))
    select n, agreed, round((agreed * n - chance) / (n * n - chance), 6) as kappa from t, e"""
)
def kappa_language(spark, d):
    """Cohen's kappa of declared and detected languages."""
    own = table(spark, d, "documents").where("text is not null").select("lang", text.language(F.col("text")).alias("found"))
    return evaluation.kappa(own, "lang", "found")


_RW = lambda x: f"regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


@query(
    f"""with a as (select doc_id, page, unnest({_RW('t')}) as word from (select reading_id, any_value(doc_id) as doc_id, any_value(page) as page, any_value(result.text) as t from readings group by 1)),
    b as (select doc_id, page, unnest({_RW('t')}) as word from (select unit_id, any_value(doc_id) as doc_id, any_value(page) as page, any_value(text) as t from units where extraction_method = 'ocr' group by 1)),
    x as (select doc_id, page, word, count(*) as x from a group by 1, 2, 3), y as (select doc_id, page, word, count(*) as y from b group by 1, 2, 3)
    select doc_id, page, sum(coalesce(x, 0))::bigint as in_a, sum(coalesce(y, 0))::bigint as in_b, sum(least(coalesce(x, 0), coalesce(y, 0)))::bigint as shared from x full join y using (doc_id, page, word) group by 1, 2"""
)
def bag_of_words(spark, d):
    """Words that readings and units of a page share, as bags."""
    a = table(spark, d, "readings").dropDuplicates(["reading_id"]).select("doc_id", "page", F.explode(tokens.marked_words(F.col("result.text"))).alias("word"))
    b = table(spark, d, "units").where("extraction_method = 'ocr'").dropDuplicates(["unit_id"]).select("doc_id", "page", F.explode(tokens.marked_words(F.col("text"))).alias("word"))
    return evaluation.bag_overlap(a, b, ["doc_id", "page"])


@query(
    """with r as (select distinct reading_id, doc_id, page, string_split(result.text, chr(10)) as ls from readings),
    p as (select doc_id, ls, lead(ls) over (partition by doc_id, page order by reading_id) as other from r)
    select doc_id, count(*) filter (len(ls) = len(other)) as compared, count(*) filter (len(ls) <> len(other)) as unequal, coalesce(sum(case when len(ls) = len(other) then len(ls) end), 0)::bigint as lines from p where other is not null group by 1"""
)
def reading_pairs(spark, d):
    """How many pages were read twice, with as many lines or not."""
    p = evaluation.successive(table(spark, d, "readings").dropDuplicates(["reading_id"]), "reading_id", "doc_id", "page")
    same = F.size("ls") == F.size("other")
    return p.groupBy("doc_id").agg(F.count_if(same).alias("compared"), F.count_if(~same).alias("unequal"), F.coalesce(F.sum(F.when(same, F.size("ls"))), F.lit(0)).alias("lines"))


@query()
def reading_errors(spark, d):
    """Character and word error rates between successive readings of a page: line by line, or whole where they have other numbers of lines."""
    p = evaluation.successive(table(spark, d, "readings").dropDuplicates(["reading_id"]), "reading_id", "doc_id", "page")
    whole = lambda c: F.array(F.array_join(c, "\n"))
    same = F.size("ls") == F.size("other")
    pairs = F.arrays_zip(F.when(same, F.col("ls")).otherwise(whole(F.col("ls"))).alias("truth"), F.when(same, F.col("other")).otherwise(whole(F.col("other"))).alias("reading"))
    lines = p.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.truth", "x.reading")
    return evaluation.error_rates(lines, ["doc_id"]).where("cer is not null")


_PAIRED = "select qid, avg(seconds) as s from (select distinct exchange_id, qid, purpose, seconds from exchanges) where purpose = '{}' group by 1"


@query(f"select qid, round(a.s, 6) as ours, round(b.s, 6) as theirs, round(round(a.s, 6) - round(b.s, 6), 6) as difference, case when round(a.s, 6) > round(b.s, 6) then 'better' when round(a.s, 6) < round(b.s, 6) then 'worse' else 'same' end as verdict from ({_PAIRED.format('arm A')}) a join ({_PAIRED.format('arm C')}) b using (qid)")
def paired_arms(spark, d):
    """Two arms' mean seconds, question by question."""
    own = table(spark, d, "exchanges").dropDuplicates(["exchange_id"]).groupBy("purpose", "qid").agg(F.round(F.avg("seconds"), 6).alias("s"))
    arm = lambda name: own.where(F.col("purpose") == name)
    return evaluation.compared(arm("arm A"), arm("arm C"), "s").withColumn("difference", F.round("difference", 6))


# ------------------------------------------------------------------ text


@query(f"select unit_id, {S.norm('any_value(text)')} as text from units group by unit_id")
def normalized_units(spark, d):
    """Every unit's text as texts are compared."""
    return table(spark, d, "units").dropDuplicates(["unit_id"]).select("unit_id", normalize.for_comparison(F.col("text")).alias("text"))


@query(f"select distinct row_id, {S.fold(S.strip('title_ar'))} as printed, {S.collapse(S.strip('nfc_normalize(title_ar)'))} as raw from calendar_rows")
def title_forms(spark, d):
    """Calendar titles with their encoding normalized, and composed."""
    c = F.col("title_ar")
    return table(spark, d, "calendar_rows").dropDuplicates(["row_id"]).select("row_id", normalize.as_printed(c).alias("printed"), normalize.raw_form(c).alias("raw"))


_NW = lambda x: f"len(list_filter(string_split({S.collapse(x)}, ' '), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}_]')))"


@query(
    f"""select doc_id, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as tokens, {_NW('text')} as words, len(regexp_extract_all({S.norm('text')}, '[ء-غف-ي]+')) as arabic,
    len({S.terms('text')}) as terms, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) as marked, (length(text) / 2.5)::decimal(18, 4)::double as estimate from documents"""
)
def token_counts(spark, d):
    """Tokens of each document under the tokenizers."""
    t = F.col("text")
    size = lambda c: F.size(c).cast("long")
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", size(tokens.words(F.lower(t))).alias("tokens"), tokens.word_count(t).cast("long").alias("words"), size(tokens.arabic_tokens(t)).alias("arabic"),
        size(tokens.terms(t)).alias("terms"), size(tokens.marked_words(t)).alias("marked"), F.round(F.length(t) / 2.5, 4).alias("estimate"),
    )


@query(f"select distinct word, ({S.terms('word')})[1] as stem from lexicon")
def stems(spark, d):
    """The first index term of each lexicon word."""
    return table(spark, d, "lexicon").select("word", F.try_element_at(tokens.terms(F.col("word")), F.lit(1)).alias("stem")).distinct()


_STATS = [k for k in text.CLASSES]


@query(
    f"""with u as (select distinct unit_id, doc_id, page, text from units)
    select doc_id, page, (sum(length(text)) + count(*) - 1)::bigint as chars, {", ".join(f"sum({S.count('text', k)})::bigint as {k}" for k in _STATS)} from u group by 1, 2"""
)
def char_counts(spark, d):
    """Characters of each page by class, over its units joined by line feeds."""
    own = table(spark, d, "units").dropDuplicates(["unit_id"]).select("doc_id", "page", *(c.alias(k) for k, c in text.char_stats(F.col("text")).items()))
    return own.groupBy("doc_id", "page").agg((F.sum("chars") + F.count("*") - 1).alias("chars"), *(F.sum(k).alias(k) for k in _STATS))


@query(
    f"""with u as (select distinct unit_id, doc_id, page, text from units), n as (select doc_id, page, sum({S.count('text', 'arabic_letters')})::bigint as found from u group by 1, 2),
    s as (select doc_id, page, arabic_letters from char_stats qualify row_number() over (partition by doc_id, page order by loaded_at desc) = 1)
    select doc_id, page, arabic_letters as told, found from s join n using (doc_id, page) where arabic_letters is not null and arabic_letters <> found"""
)
def char_stats_differences(spark, d):
    """Pages whose stored count of Arabic letters is not what their units hold."""
    stats = table(spark, d, "char_stats").withColumn("at", F.concat_ws("/", "doc_id", "page"))
    told = stores.latest(stats, "at", "loaded_at").where("arabic_letters is not null").select("doc_id", "page", F.col("arabic_letters").alias("told"))
    return told.join(char_counts(spark, d).select("doc_id", "page", F.col("arabic_letters").alias("found")), ["doc_id", "page"]).where("told <> found")


@query("select doc_id, length(text) - length(regexp_replace(text, '[\\p{Hebrew}\\p{Thai}\\p{Cyrillic}\\p{Greek}]', '', 'g')) as foreign_letters, case when regexp_matches(text, '[\\x{600}-\\x{6ff}]') then 'ar' else 'en' end as language from documents")
def foreign_letters(spark, d):
    """Letters of other scripts, and the language detected, of each document."""
    return table(spark, d, "documents").select("doc_id", text.foreign_letters(F.col("text")).alias("foreign_letters"), text.language(F.col("text")).alias("language"))


@query(
    """select distinct exchange_id, regexp_replace(regexp_replace(regexp_replace(prompt, '[\\p{L}\\p{N}._%+-]+@[\\p{L}\\p{N}.-]+\\.\\p{L}{2,}', '[redacted]', 'g'), '\\+?\\p{Nd}(?:[ -]?\\p{Nd}){8,}', '[redacted]', 'g'), '\\p{Nd}{7,}', '[redacted]', 'g') as prompt from exchanges"""
)
def redacted_prompts(spark, d):
    """Prompts without personal data."""
    return table(spark, d, "exchanges").dropDuplicates(["exchange_id"]).select("exchange_id", text.redact(F.col("prompt")).alias("prompt"))


@query(
    """with p as (select distinct exchange_id, translate(text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') as t from exchanges where text is not null)
    select exchange_id, array_to_string(list_transform(list_distinct_ordered, lambda x: x::varchar), ',') as cited from (
        select exchange_id, list_reduce(list_prepend([]::int[], list_transform(flatten(list_transform(regexp_extract_all(t, '\\[(\\d+(?:\\s*[,،]\\s*\\d+)*)\\]', 1), lambda g: regexp_extract_all(g, '\\d+'))), lambda n: [n::int])), lambda acc, x: case when list_contains(acc, x[1]) then acc else list_concat(acc, x) end) as list_distinct_ordered from p)
    where len(list_distinct_ordered) > 0"""
)
def citation_numbers(spark, d):
    """The numbers each reply cites, in order."""
    c = text.citations(F.col("text"))
    return table(spark, d, "exchanges").where("text is not null").dropDuplicates(["exchange_id"]).select("exchange_id", F.array_join(c.cast("array<string>"), ",").alias("cited")).where("cited <> ''")


@query(
    f"""select distinct exchange_id, regexp_matches({S.norm('prompt')}, 'اي\\s*اسبوع(?:[^ي]|$)|الاسبوع\\s+(?:ال)?كم|(?:هذا|ذا)\\s+الاسبوع|هالاسبوع|الاسبوع\\s+(?:الحالي|الجاي|القادم|الماضي)|كم\\s+(?:يوم|ايام|اسبوع|اسابيع|شهر)\\s+(?:باقي|بقي|متبقي|يبقي|علي|عن|لين|حتي|قبل)|(?:باقي|بقي|متبقي)\\s+(?:علي|عن|لين|حتي)|تاريخ\\s+اليوم|اليوم\\s+(?:كم|وش|ايش)|(?:وش|ايش|كم)\\s+(?:ال)?تاريخ')
    or regexp_matches(lower({S.norm('prompt')}), '\\b(?:which|what) week\\b|\\bthis week\\b|\\bcurrent week\\b|\\btoday\\b|\\bdate is it\\b|\\bhow (?:many|long)\\b.*\\b(?:left|until|till|remaining)\\b') as about_time from exchanges"""
)
def time_questions(spark, d):
    """Which prompts ask about time."""
    return table(spark, d, "exchanges").dropDuplicates(["exchange_id"]).select("exchange_id", calendars.asks_about_time(F.col("prompt")).alias("about_time"))


@query(
    r"""with t as (select distinct exchange_id, translate(translate(regexp_replace(translate(text, '٫', '.'), '[\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٬', '01234567890123456789,'), '،', ',') as t from exchanges where text is not null)
    select exchange_id, len(regexp_extract_all(regexp_replace(regexp_replace(t, '(\d),(\d{3})\b', '\1\2', 'g'), '(\d),(\d{1,2})\b', '\1.\2', 'g'), '\d+(?:\.\d+)?')) as numbers from t"""
)
def numbers_stated(spark, d):
    """How many numbers in digits each reply states."""
    return table(spark, d, "exchanges").where("text is not null").dropDuplicates(["exchange_id"]).select("exchange_id", F.size(text.digit_numbers(F.col("text"))).cast("long").alias("numbers"))


@query(
    r"""with t as (select distinct reading_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(result.text, '([ء-غف-ي])ส', '\1سب', 'g'), 'ส([ء-غف-ي])', 'سب\1', 'g'), '([ء-غف-ي])ת', '\1ت', 'g'), 'ת([ء-غف-ي])', 'ت\1', 'g') as t from readings)
    select reading_id, length(t) as chars, length(t) - length(regexp_replace(t, '[ء-غف-ي]', '', 'g')) as arabic from t"""
)
def repaired_readings(spark, d):
    """Characters and Arabic letters of readings, two letters of other scripts put right."""
    fixed = text.fi_ligature(text.repair_letters(F.col("result.text")))
    r = table(spark, d, "readings").dropDuplicates(["reading_id"]).select("reading_id", fixed.alias("t"))
    return r.select("reading_id", F.length("t").cast("long").alias("chars"), text.count_of(F.col("t"), "ء-غف-ي").cast("long").alias("arabic"))


# ------------------------------------------------------------------ quality


@query(
    """with c as (select doc_id, lower(trim(regexp_replace(regexp_replace(producer, '[®™©]', '', 'g'), '\\s+', ' ', 'g'))) as p from corpus_documents)
    select doc_id, case when regexp_matches(p, '\\bpdfium\\b') then 'pdfium' when regexp_matches(p, '\\badobe\\b.*\\b(?:pdf library|illustrator)\\b') then 'adobe' when regexp_matches(p, '\\bmicrosoft\\b.*\\b(?:word|powerpoint)\\b') then 'microsoft_office' else 'default' end as rule,
    case when regexp_matches(p, '\\bmicrosoft\\b.*\\b(?:word|powerpoint)\\b') and not regexp_matches(p, '\\bpdfium\\b|\\badobe\\b.*\\b(?:pdf library|illustrator)\\b') then 'ocr' else 'text_layer' end as path from c"""
)
def routed_documents(spark, d):
    """How each document is to be read, by what wrote it."""
    r = quality.route(F.col("producer"), F.lit(None).cast("string"))
    return table(spark, d, "corpus_documents").select("doc_id", r["rule"].alias("rule"), r["path"].alias("path"))


@query(f"select distinct {S.norm('word')} as word from lexicon where frequency >= 1000 and {S.norm('word')} <> ''")
def lexicon_words(spark, d):
    """The words a page's words are checked against."""
    return quality.lexicon(table(spark, d, "lexicon"))


@query("select cutoff, count(*) filter (frequency >= cutoff) as words from lexicon, (select unnest([1, 100, 1000, 10000, 100000]) as cutoff) group by 1")
def lexicon_cutoffs(spark, d):
    """How many words reach each frequency."""
    return quality.cutoffs(table(spark, d, "lexicon"), [1, 100, 1000, 10_000, 100_000])


def _pages(spark, d):
    """The text of each page: its units' texts, by sequence."""
    u = table(spark, d, "units").dropDuplicates(["unit_id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return u.groupBy("doc_id", "page").agg(joined.alias("text"))


_GATE = f"""
    with u as (select distinct unit_id, doc_id, page, seq, text from units), p as (select doc_id, page, string_agg(text, chr(10) order by seq, text) as text from u group by 1, 2),
    known as (select distinct {S.norm('word')} as word from lexicon where frequency >= 1000),
    w as (select doc_id, page, unnest(regexp_extract_all({S.norm('text')}, '[ء-غف-ي]+')) as word from p),
    v as (select doc_id, page, count(*) as arabic_tokens, count(k.word) / count(*) as validity from w left join known k using (word) group by 1, 2),
    q as (select p.doc_id, p.page, coalesce(arabic_tokens, 0) as arabic_tokens, round(validity, 6) as token_validity, validity, {S.count('text', 'replacement_chars')} as bad from p left join v using (doc_id, page)),
    g as (select doc_id, page, arabic_tokens, token_validity, case when arabic_tokens = 0 then 'no_arabic_text' when arabic_tokens < 20 or bad > 0 or validity < 0.95 then 'untrusted' else 'trusted' end as verdict from q)
"""


def _gated(spark, d):
    return quality.gate(quality.page_quality(_pages(spark, d), quality.lexicon(table(spark, d, "lexicon")), "doc_id", "page"))


@query(_GATE + "select doc_id, page, arabic_tokens, token_validity, verdict from g")
def gated_pages(spark, d):
    """The verdict on each page's text, with what decides it."""
    return _gated(spark, d).select("doc_id", "page", "arabic_tokens", F.round("token_validity", 6).alias("token_validity"), "verdict")


_PATHS = ", paths as (select doc_id, count(*) as pages, count(*) filter (verdict = 'trusted') as trusted, count(*) filter (verdict = 'no_arabic_text') as no_arabic, case when 2 * count(*) filter (verdict = 'trusted') > count(*) - count(*) filter (verdict = 'no_arabic_text') then 'text_layer' else 'ocr' end as path from g group by 1)"


@query(_GATE + _PATHS + " select * from paths")
def document_paths(spark, d):
    """How most of a document's pages are to be read."""
    return quality.document_paths(_gated(spark, d))


@query(_GATE + _PATHS + " select doc_id, page, case when path = 'text_layer' and verdict = 'trusted' then 'text_layer' else 'ocr' end as method from g join paths using (doc_id)")
def page_methods(spark, d):
    """How each page is read."""
    return quality.page_methods(_gated(spark, d)).select("doc_id", "page", "method")


@query(
    _GATE + _PATHS + """, r as (select doc_id, lower(trim(regexp_replace(regexp_replace(producer, '[®™©]', '', 'g'), '\\s+', ' ', 'g'))) as p from corpus_documents)
    select doc_id, case when regexp_matches(p, '\\bmicrosoft\\b.*\\b(?:word|powerpoint)\\b') and not regexp_matches(p, '\\bpdfium\\b|\\badobe\\b.*\\b(?:pdf library|illustrator)\\b') then 'ocr' else 'text_layer' end as predicted, path as decided, predicted = decided as agree
    from r join paths using (doc_id)"""
)
def routes_agreeing(spark, d):
    """Whether the gate reads documents as what wrote them lets expect."""
    predicted = table(spark, d, "corpus_documents").select("doc_id", quality.route(F.col("producer"), F.lit(None).cast("string"))["path"].alias("path"))
    return quality.agreement(predicted, quality.document_paths(_gated(spark, d)), "doc_id")


@query(_GATE + " select doc_id, page, arabic_tokens, token_validity, verdict from g where verdict <> 'trusted'")
def pages_rejected(spark, d):
    """Pages that the gate doesn't pass."""
    return quality.gate(quality.page_quality(_pages(spark, d), quality.lexicon(table(spark, d, "lexicon")), "doc_id", "page"), quality.GATE).where("verdict <> 'trusted'").select("doc_id", "page", "arabic_tokens", F.round("token_validity", 6).alias("token_validity"), "verdict")


@query(
    f"""with u as (select distinct unit_id, doc_id, page, seq, text from units), p as (select doc_id, page, string_agg(text, chr(10) order by seq, text) as t from u group by 1, 2),
    n as (select doc_id, page, length(t) as chars, {", ".join(f"{S.count('t', k)} as {k}" for k in ("presentation_forms", "arabic_letters", "bidi_controls", "c0_controls", "latin_letters", "ascii_digits", "arabic_indic_digits"))} from p)
    select doc_id, page, arabic_letters + latin_letters + ascii_digits + arabic_indic_digits as content_chars, case when presentation_forms + arabic_letters > 0 then round(presentation_forms / (presentation_forms + arabic_letters), 4) else 0.0 end as presform_ratio,
    round(bidi_controls * 1000 / chars, 2) as bidi_per_1k, round(c0_controls * 1000 / chars, 2) as c0_per_1k from n where chars > 0"""
)
def page_measures(spark, d):
    """Characters with content, presentation forms and controls of each page, as ratios."""
    q = quality.page_quality(_pages(spark, d).where("length(text) > 0"), quality.lexicon(table(spark, d, "lexicon")), "doc_id", "page")
    return q.select("doc_id", "page", "content_chars", F.coalesce("presform_ratio", F.lit(0.0)).alias("presform_ratio"), "bidi_per_1k", "c0_per_1k")


@query(
    f"""with r as (select distinct reading_id, doc_id, page, len(regexp_extract_all({S.norm('result.text')}, '[ء-غف-ي]+')) as a from readings where result.text is not null), l as (select doc_id, page, sum(n) as b from (select distinct unit_id, doc_id, page, len(regexp_extract_all({S.norm('text')}, '[ء-غف-ي]+')) as n from units) group by 1, 2)
    select reading_id, a >= 0 and b >= 10 and a < 0.5 * b as again from r join l using (doc_id, page)"""
)
def pages_to_reread(spark, d):
    """Readings with under half of the words of their page's units."""
    words = lambda c: F.size(tokens.arabic_tokens(F.col(c)))
    r = table(spark, d, "readings").where("result.text is not null").dropDuplicates(["reading_id"]).select("reading_id", "doc_id", "page", words("result.text").alias("a"))
    layer = table(spark, d, "units").dropDuplicates(["unit_id"]).groupBy("doc_id", "page").agg(F.sum(words("text")).alias("b"))
    return r.join(layer, ["doc_id", "page"]).select("reading_id", quality.needs_rereading(F.col("a"), F.col("b")).alias("again"))


@query(
    f"""with l as (select distinct doc_id, page, {S.norm('line')} as line from (select doc_id, page, unnest(lines) as line from units)),
    n as (select doc_id, count(distinct page) as n_pages from (select doc_id, page, unnest(lines) from units) group by 1)
    select doc_id, line, count(distinct page) as pages from l join n using (doc_id) where line <> '' and {_NW('line')} <= 8 and not regexp_matches(line, '^\\d{{1,2}}( \\d{{1,2}})*$') and n_pages >= 6
    group by doc_id, line, n_pages having count(distinct page) >= 3 and count(distinct page) >= n_pages * 0.25"""
)
def boilerplate_lines(spark, d):
    """Short lines that documents print on many pages."""
    return structure.boilerplate(spread(table(spark, d, "units").select("doc_id", "page", "lines")).select("doc_id", "page", F.explode("lines").alias("text")))


@query(
    f"""with u as (select distinct unit_id, doc_id, page, text from units), p as (select doc_id, page, sum(length(text)) + count(*) - 1 as n, sum({S.count('text', 'arabic_letters')}) as a from u group by 1, 2)
    select doc_id, count(*) as pages, (sum(n) + count(*) - 1)::bigint as chars, sum(a)::bigint as arabic_letters, round((sum(n) + count(*) - 1) / count(*), 1) as chars_per_page from p group by 1"""
)
def document_stats(spark, d):
    """Characters of each document over all its pages."""
    return quality.document_stats(_pages(spark, d)).select("doc_id", "pages", "chars", "arabic_letters", "chars_per_page")


# ------------------------------------------------------------------ structure


@query("select distinct unit_id, coalesce(last_value(heading ignore nulls) over (partition by doc_id order by page, seq, unit_id rows unbounded preceding), null) as heading from (select distinct unit_id, doc_id, page, seq, heading from units)")
def headings_in_force(spark, d):
    """The heading that each unit stands under."""
    u = table(spark, d, "units").dropDuplicates(["unit_id"]).select("unit_id", "doc_id", "page", F.struct("seq", "unit_id").alias("seq"), "heading")
    return structure.fill_forward(u, "heading").select("unit_id", F.col("filled").alias("heading"))


@query(
    """with u as (select distinct unit_id, doc_id, page, seq, heading from units)
    select unit_id, sum(s) over (partition by doc_id, page order by seq, unit_id rows unbounded preceding)::bigint as unit from (select *, case when heading is not null or row_number() over (partition by doc_id, page order by seq, unit_id) = 1 then 1 else 0 end as s from u)"""
)
def unit_sessions(spark, d):
    """Units numbered by the section of their page that they fall in."""
    u = table(spark, d, "units").dropDuplicates(["unit_id"]).select("unit_id", "doc_id", "page", F.struct("seq", "unit_id").alias("seq"), "heading")
    return structure.sessions(u, F.col("heading").isNotNull(), "doc_id", "page", at="seq").select("unit_id", F.col("unit").cast("long").alias("unit"))


@query(
    f"""with k as (select draft_id, doc_id, page, array_to_string(texts, chr(10)) as text, heading, content_type, list_filter(clause_nos, lambda x: x is not null) as c from drafts where {_NW("array_to_string(texts, chr(10))")} >= 3)
    select doc_id || '_p' || page || '_c' || row_number() over (partition by doc_id, page order by draft_id) as chunk_id, doc_id, title as doc_title, scope, effective, page, heading as section_heading,
    case when len(c) = 0 then null when c[1] = c[-1] then c[1] else c[1] || '–' || c[-1] end as clause_no, content_type, text from k join corpus_documents using (doc_id)"""
)
def chunks(spark, d):
    """Drafts as chunks, with their documents' titles."""
    drafts = table(spark, d, "drafts").withColumn("draft_no", F.col("draft_id"))
    return structure.chunks(drafts, table(spark, d, "corpus_documents"))


@query(
    _GATE + _PATHS + f""", m as (select g.doc_id, g.page, case when path = 'text_layer' and verdict = 'trusted' then 'text_layer' else 'ocr' end as method, q.validity from g join paths using (doc_id) join q on q.doc_id = g.doc_id and q.page = g.page),
    k as (select draft_id, doc_id, page, manual, heading, content_type from drafts where {_NW("array_to_string(texts, chr(10))")} >= 3)
    select doc_id || '_p' || page || '_c' || row_number() over (partition by doc_id, page order by draft_id) as chunk_id, method as extraction_method, round(validity, 3) as gate_score, manual as manually_verified
    from k join corpus_documents using (doc_id) left join m using (doc_id, page)"""
)
def chunk_records(spark, d):
    """How each chunk's page was read, its score and whether it was typed by hand."""
    drafts = table(spark, d, "drafts").withColumn("draft_no", F.col("draft_id"))
    read = quality.page_methods(_gated(spark, d)).select("doc_id", "page", "method", "token_validity")
    return structure.chunks(drafts, table(spark, d, "corpus_documents"), pages=read).select("chunk_id", "extraction_method", "gate_score", "manually_verified")


@query(
    f"""with l as (select distinct unit_id, i, {S.norm('line')} as p, line from (select unit_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from units))
    select unit_id, i, regexp_extract(regexp_extract(p, '^(?:[.\\-]\\d{{1,2}}|\\d{{1,2}} ?[.\\-)])'), '\\d{{1,2}}')::int as clause_no from l where regexp_matches(p, '^(?:[.\\-]\\d{{1,2}}|\\d{{1,2}} ?[.\\-)])(?:[^0-9]|$)')"""
)
def clause_lines(spark, d):
    """Lines that start a numbered clause."""
    lines = table(spark, d, "units").dropDuplicates(["unit_id"]).select("unit_id", F.posexplode("lines").alias("i", "line"))
    return lines.select("unit_id", (F.col("i") + 1).cast("long").alias("i"), text.clause_number(F.col("line")).alias("clause_no")).where("clause_no is not null")


@query("select count(*) as units, count(*) filter (text = case when content_type = 'table' then array_to_string(lines, chr(10)) else array_to_string(lines, ' ') end) as joined from (select distinct unit_id, text, lines, content_type from units)")
def joined_lines(spark, d):
    """How many units' texts are their lines joined."""
    u = table(spark, d, "units").dropDuplicates(["unit_id"])
    own = F.when(F.col("content_type") == "table", F.array_join("lines", "\n")).otherwise(F.array_join("lines", " "))
    return u.agg(F.count("*").alias("units"), F.count_if(F.col("text") == own).alias("joined"))


@query()
def unit_articles(spark, d):
    """Articles' labels among the lines of units, and which of them are taken for headings, in order."""
    lines = table(spark, d, "units").dropDuplicates(["unit_id"]).select("unit_id", "doc_id", "page", "seq", F.posexplode("lines").alias("i", "line"))
    # compared as labels are: stored lines may have presentation forms, vowel marks or unseen characters
    lines = lines.where(normalize.for_comparison(F.col("line")).contains(labels.ARTICLE))
    found = lines.withColumn("l", labels.article_labels("line")).where("l.label is not null").select("unit_id", "i", "doc_id", "page", F.struct("seq", "unit_id", "i").alias("at"), "l.label", "l.number", "l.certain")
    return labels.counted(found, at="at").select("unit_id", "i", "label", "number", "certain", "accepted")


@query()
def merged_drafts(spark, d):
    """Units of each page put together into drafts."""
    u = table(spark, d, "units").dropDuplicates(["unit_id"])
    m = structure.merge(structure.pieces(u.select("doc_id", "page", "seq", "heading", "content_type", "text", "clause_no", "lines")).select("doc_id", "page", (F.col("seq") * 10_000 + F.col("part")).alias("seq"), "heading", "content_type", "text", "clause_no"))
    return m.select("doc_id", "page", "draft_no", "heading", "content_type", F.size("texts").alias("units"), structure.clause_range(F.col("clause_nos")).alias("clause_no"), F.array_join("texts", "\n").alias("text"))



# ------------------------------------------------------------------ calendars

_CELL = r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})(?:\s*-\s*(?:(?:(\d{4})/)?(\d{1,2})/)?(\d{1,2}))?\s*(?:م|هـ?)?\s*$"
_PART = lambda x, i: f"nullif(regexp_extract({x}, '{_CELL}', {i}), '')::int"
_ENDS = (
    f"select distinct row_id, date_gregorian as cell, {_PART('date_gregorian', 1)} as y, {_PART('date_gregorian', 2)} as m, {_PART('date_gregorian', 3)} as d, "
    f"{_PART('date_gregorian', 4)} as y2, {_PART('date_gregorian', 5)} as m2, {_PART('date_gregorian', 6)} as d2 from calendar_rows"
)


@query(
    f"""with e as ({_ENDS}), f as (select row_id, y, m, d, case when d2 is not null then coalesce(y2, y) end as ly, case when d2 is not null then coalesce(m2, m) end as lm, d2 as ld from e)
    select row_id, case when y is null then 'malformed' when not (m between 1 and 12 and d between 1 and 31) or (ld is not null and not (lm between 1 and 12 and ld between 1 and 31)) then 'out of range' end as problem,
    abs(date_diff('day', try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, m, d) as date), try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', ly, lm, ld) as date))) as span from f"""
)
def date_cells(spark, d):
    """Printed dates of calendar rows: what is wrong with them, and the days between a range's ends."""
    c = calendars.date_cell(F.col("date_gregorian"))
    own = table(spark, d, "calendar_rows").dropDuplicates(["row_id"]).select("row_id", c.alias("c"))
    return own.select("row_id", "c.problem", F.when(F.col("c.last").isNotNull(), calendars.span_days(F.col("c"))).alias("span"))


_HIJRI = _ENDS.replace("date_gregorian", "date_hijri")


@query(
    f"""with g as ({_ENDS}), h as ({_HIJRI}), r as (select distinct row_id, title_ar, day_en, date_hijri from calendar_rows),
    e as (select r.*, g.y, g.m, g.d, case when g.d2 is not null then coalesce(g.y2, g.y) end as ly, case when g.d2 is not null then coalesce(g.m2, g.m) end as lm, g.d2 as ld,
        h.y as hy, h.m as hm, h.d as hd, case when h.d2 is not null then coalesce(h.y2, h.y) end as hly, case when h.d2 is not null then coalesce(h.m2, h.m) end as hlm, h.d2 as hld from r join g using (row_id) join h using (row_id)),
    p as (select *, case when y is null then 'malformed' when not (m between 1 and 12 and d between 1 and 31) or (ld is not null and not (lm between 1 and 12 and ld between 1 and 31)) then 'out of range' end as gp,
        case when hy is null then 'malformed' when not (hm between 1 and 12 and hd between 1 and 31) or (hld is not null and not (hlm between 1 and 12 and hld between 1 and 31)) then 'out of range' end as hp,
        try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, m, d) as date) as a, try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', ly, lm, ld) as date) as b from e),
    s as (select *, case when gp is null then case when ld is null then 0 else abs(date_diff('day', a, b)) end end as gs, case when hp is null then case when hld is null then 0 else abs((hly * 12 + hlm) * 30 + hld - (hy * 12 + hm) * 30 - hd) end end as hs,
        array_to_string(list_transform(list_sort(list_filter([a, b], lambda x: x is not null)), lambda x: dayname(x)), ' - ') as due from p)
    select distinct row_id, problem from (select row_id, unnest(list_filter([
        'gregorian ' || gp, case when date_hijri is not null then 'hijri ' || hp end, case when date_hijri is not null and abs(gs - hs) > 1 then 'spans differ' end,
        case when gp is not null or day_en is null then null when a is null or (ld is not null and b is null) then 'no such date' when regexp_replace(trim(day_en), '\\s*-\\s*', ' - ', 'g') <> due then 'should be ' || due end,
        case when trim(coalesce(title_ar, '')) = '' then 'no title' end], lambda x: x is not null)) as problem from s)"""
)
def calendar_problems(spark, d):
    """Everything wrong with calendar rows."""
    return calendars.calendar_report(table(spark, d, "calendar_rows").dropDuplicates(["row_id"]))


@query("select o_orderkey, extract('year' from o_orderdate)::int as year, (floor(date_diff('day', make_date(extract('year' from o_orderdate)::int, 1, 1), o_orderdate::date) / 7) + 1)::int as week from orders")
def weeks_of_orders(spark, d):
    """The week of its year's span that each order falls in, by an interval join with the spans."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    years = o.select(F.year("day").alias("year")).distinct()
    spans = years.select("year", F.make_date("year", F.lit(1), F.lit(1)).alias("start"), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).alias("end"))
    # spans don't overlap: the year is an equi-key beside the interval
    both = o.withColumn("year", F.year("day")).join(F.broadcast(spans), "year").where((F.col("day") >= F.col("start")) & (F.col("day") < F.col("end")))
    return both.select("o_orderkey", "year", calendars.week(F.col("day"), F.col("start"), F.col("end")).alias("week"))


@query("select name, (row_number() over (partition by name order by first))::int as week, first::date as first, (first + interval 6 day)::date as last from (select 'y' || y as name, unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), interval 7 day)) as first from (select distinct extract('year' from o_orderdate)::int as y from orders))")
def week_lists(spark, d):
    """The weeks of each year that has orders."""
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return calendars.weeks(years.select(F.concat(F.lit("y"), "y").alias("name"), F.make_date("y", F.lit(1), F.lit(1)).alias("start"), F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("end")))


# ------------------------------------------------------------------ answers, stores, logs


@query(
    f"""with e as (select distinct exchange_id, purpose, text, finish, tokens_in, tokens_out, seconds from exchanges), n as (select purpose, seconds, row_number() over (partition by purpose order by seconds) as r, count(*) over (partition by purpose) as n from e where seconds is not null),
    t as (select purpose, max(case when r = greatest(1, least(n, round_even(n * 0.5, 0)::bigint)) then seconds end) as p50, max(case when r = greatest(1, least(n, round_even(n * 0.95, 0)::bigint)) then seconds end) as p95 from n group by 1)
    select purpose, count(*) as questions, count(*) filter (length({S.collapse("coalesce(text, '')")}) > 0) || '/' || count(*) as answered, count(*) filter (regexp_matches(translate(coalesce(text, ''), '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\\[\\d+(?:\\s*[,،]\\s*\\d+)*\\]')) || '/' || count(*) as cited,
    count(*) filter (finish = 'MAX_TOKENS') as cut, sum(tokens_in)::bigint as tokens_in, sum(tokens_out)::bigint as tokens_out, any_value(p50) as p50, any_value(p95) as p95 from e join t using (purpose) group by 1"""
)
def run_summary(spark, d):
    """What the exchanges of each purpose come to."""
    return answers.run_summary(table(spark, d, "exchanges").dropDuplicates(["exchange_id"]), "purpose")


@query(r"select exchange_id, case when regexp_matches(text, '(?i)VERDICT\W*(?:CORRECT|PARTIAL|WRONG|REFUSED)\b') then upper(regexp_extract_all(text, '(?i)VERDICT\W*(CORRECT|PARTIAL|WRONG|REFUSED)\b', 1)[-1]) end as verdict from (select distinct exchange_id, text from exchanges where purpose = 'judge')")
def judge_verdicts(spark, d):
    """The last verdict in each judge's reply."""
    e = table(spark, d, "exchanges").where("purpose = 'judge'").dropDuplicates(["exchange_id"])
    return e.select("exchange_id", answers.verdict(F.col("text")).alias("verdict"))


_CITES = "regexp_extract_all(translate(coalesce({0}, ''), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '\\[(\\d+(?:\\s*[,،]\\s*\\d+)*)\\]', 1)"
_CITED = lambda x: f"list_transform(flatten(list_transform({_CITES.format(x)}, lambda g: regexp_extract_all(g, '\\d+'))), lambda n: n::int)"
_REASON = lambda t, k: (
    f"case when length(trim(coalesce({t}, ''))) = 0 then 'declined' when len(list_filter({_CITED(t)}, lambda n: n >= 1)) = 0 and len({_CITED(t)}) = 0 then 'no citation' when len(list_filter({_CITED(t)}, lambda n: n < 1 or n > {k})) > 0 then 'unknown citation' else '' end"
)


@query(
    f"""with e as (select * from (select distinct exchange_id, qid, purpose, text from exchanges where qid is not null) where purpose in ('arm C', 'arm B')),
    q as (select distinct qid from exchanges where qid is not null), a as (select qid, arg_max(text, exchange_id) as t1 from (select qid, coalesce(text, '') as text, exchange_id from e where purpose = 'arm C') group by 1), b as (select qid, arg_max(text, exchange_id) as t2 from (select qid, coalesce(text, '') as text, exchange_id from e where purpose = 'arm B') group by 1),
    r as (select qid, {_REASON('t1', 1)} as r1, {_REASON('t2', 3)} as r2 from q left join a using (qid) left join b using (qid))
    select qid, case when r1 = '' then 1 else 2 end as attempts, case when r1 = '' or r2 = '' then 'answered' when r2 = 'declined' then 'declined' else 'refused' end as outcome, case when r1 = '' then '' else r2 end as reason from r"""
)
def answer_flow(spark, d):
    """Questions answered by stored replies: one source at first, then three; arm C's replies first, arm B's when asked again."""
    e = table(spark, d, "exchanges").where("qid is not null").dropDuplicates(["exchange_id"])
    questions = e.select("qid").distinct().select("qid", F.col("qid").alias("question"), F.lit("en").alias("language"))
    rankings = questions.select("qid", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")).withColumn("item_id", F.col("rank"))
    last = lambda arm, n: e.where(F.col("purpose") == arm).groupBy("qid").agg(F.max_by(F.coalesce("text", F.lit("")), "exchange_id").alias("text")).withColumn("attempt", F.lit(n))
    made = flow.answered(questions, rankings, flow.replayed(last("arm C", 1).unionByName(last("arm B", 2))), lambda c: F.lit(False), {"en": "No answer."}, depths=(1, 3))
    return made.select("qid", "attempts", "outcome", "reason")


_LABELS = ("STOP", "MAX_TOKENS", "SAFETY")
_COUNTED = ", ".join("count(*) filter (finish = '" + x + "') as \"" + x + "\"" for x in _LABELS)


@query(f"with e as (select distinct exchange_id, model, purpose, finish from exchanges where finish in {_LABELS}) select model as run, purpose as type, {_COUNTED}, count(*) as n, round(count(*) filter (finish = 'STOP') / count(*), 6) as accuracy from e group by 1, 2")
def labels_by_type(spark, d):
    """How the exchanges of each model ended, by purpose."""
    e = table(spark, d, "exchanges").where(F.col("finish").isin(*_LABELS)).dropDuplicates(["exchange_id"])
    return answers.type_table(e.select(F.col("model").alias("run"), F.col("purpose").alias("type"), F.col("finish").alias("judge")), list(_LABELS))


@query(
    """with e as (select distinct exchange_id, model, seconds, tokens_in, tokens_out from exchanges), n as (select model, seconds, row_number() over (partition by model order by seconds) as r, count(*) over (partition by model) as n from e where seconds is not null),
    t as (select model, max(case when r = greatest(1, least(n, round_even(n * 0.5, 0)::bigint)) then seconds end) as p50, max(case when r = greatest(1, least(n, round_even(n * 0.95, 0)::bigint)) then seconds end) as p95 from n group by 1)
    select model as run, any_value(p50) as p50, any_value(p95) as p95, round(avg(tokens_in), 4) as tokens_in, round(avg(tokens_out), 4) as tokens_out from e join t using (model) group by 1"""
)
def times_and_tokens(spark, d):
    """Times and tokens of each model."""
    e = table(spark, d, "exchanges").dropDuplicates(["exchange_id"]).withColumnRenamed("model", "run")
    return answers.cost_table(e)


@query("select model, purpose, count(*) as asked, sum(tokens_in)::bigint as tokens_in, sum(tokens_thinking)::bigint as tokens_thinking from (select distinct exchange_id, model, purpose, tokens_in, tokens_thinking from exchanges where not coalesce(cached, false)) group by 1, 2")
def ledger_sums(spark, d):
    """What was really asked of each model, for which purpose, in tokens."""
    lines = answers.ledger(table(spark, d, "exchanges").dropDuplicates(["exchange_id"]))
    return lines.groupBy("model", "purpose").agg(F.count("*").alias("asked"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_thinking").alias("tokens_thinking"))


@query("select purpose as run, count(*) as n, round(avg((finish = 'STOP')::int), 6) as accuracy, count(*) filter (finish in ('STOP', 'MAX_TOKENS')) || '/' || count(*) as correct_or_partial, case when count(*) filter (model_version is null) > 0 then '0/' || count(*) filter (model_version is null) else '-' end as wrong_outside from (select distinct exchange_id, purpose, coalesce(finish, 'none') as finish, model_version from exchanges) group by 1")
def outcomes_by_purpose(spark, d):
    """How many exchanges of each purpose ended well, or nearly."""
    e = table(spark, d, "exchanges").dropDuplicates(["exchange_id"])
    judge = F.when(F.col("finish") == "STOP", "correct").when(F.col("finish") == "MAX_TOKENS", "partial").otherwise("other")
    return answers.quality_table(e.select(F.col("purpose").alias("run"), judge.alias("judge"), F.when(F.col("model_version").isNull(), "refuse").otherwise("answer").alias("behaviour")))


@query("select distinct unit_id, '[' || unit_id || '] | ' || title || ' | p. ' || page || case when heading is not null then ' | ' || heading else '' end || case when clause_no is not null then ' | clause ' || clause_no else '' end || chr(10) || text as block from units join corpus_documents using (doc_id)")
def source_blocks(spark, d):
    """Units as they are shown to a model."""
    u = table(spark, d, "units").dropDuplicates(["unit_id"]).join(table(spark, d, "corpus_documents").select("doc_id", "title"), "doc_id")
    s = lambda c: F.col(c).cast("string")
    return u.select("unit_id", answers.source_block(s("unit_id"), F.col("title"), s("page"), F.col("heading"), F.col("clause_no"), F.col("text")).alias("block"))


@query("select distinct substr(sha256('passage' || chr(0) || text), 1, 24) as key from units where text is not null and text not in (select text from units where unit_id % 2 = 0 and text is not null)")
def store_missing(spark, d):
    """Keys of unit texts that a store of the even units hasn't got."""
    u = stores.keyed(table(spark, d, "units").where("text is not null"), "passage", "text")
    return stores.missing(u, u.where("unit_id % 2 = 0").select("key"))


@query("select unit_id, loaded_at from units qualify row_number() over (partition by unit_id order by loaded_at desc) = 1")
def latest_units(spark, d):
    """The arrival of each unit's last copy."""
    return stores.latest(table(spark, d, "units"), "unit_id", "loaded_at").select("unit_id", "loaded_at")


@query(
    """select exchange_id, problem from (select distinct exchange_id, unnest(list_filter([case when text is null then 'no text' end, case when finish is null then 'no finish' end, case when tokens_out < 1 then 'no tokens' end, case when max_tokens < tokens_out then 'over the limit' end, case when logged_at - "at" > interval 1 day then 'logged late' end], lambda x: x is not null)) as problem from exchanges)"""
)
def exchange_problems(spark, d):
    """Everything wrong with the records of exchanges."""
    late = (F.unix_micros("logged_at") - F.unix_micros("at")) > 86_400_000_000
    rules = [("no text", F.col("text").isNull()), ("no finish", F.col("finish").isNull()), ("no tokens", F.col("tokens_out") < 1), ("over the limit", F.col("max_tokens") < F.col("tokens_out")), ("logged late", late)]
    return gold.problems(table(spark, d, "exchanges"), "exchange_id", rules).distinct()


@query("select exchange_id, count(*) as n from exchanges group by 1 having count(*) > 1")
def repeated_exchanges(spark, d):
    """Exchanges that were stored more than once."""
    return gold.duplicates(table(spark, d, "exchanges"), "exchange_id")


@query("select purpose, model, count(*) as n from exchanges group by 1, 2")
def exchange_counts(spark, d):
    return gold.composition(table(spark, d, "exchanges"), "purpose", "model")


@query("with n as (select source, count(*) as n from (select distinct doc_id, source from documents where source is not null) group by 1), k as (select *, row_number() over (order by source) as i, count(*) over () as k from n) select source, least(n, 240 // k + case when i <= 240 % k then 1 else 0 end)::bigint as drawn from k")
def stratified_counts(spark, d):
    """How many documents are drawn from each site."""
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source").dropDuplicates(["doc_id"])
    return gold.stratified(docs, "source", "doc_id", 240).groupBy("source").agg(F.count("*").alias("drawn"))


@query()
def stratified_sample(spark, d):
    """An equal share of documents from each site, drawn by a seed."""
    return gold.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 240)


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2")
def events_by_hour(spark, d):
    return logs.by_hour(table(spark, d, "events"), "ts", "event_type")


@query("select event_type, count(*) as n, round(sum(value), 4) as total, count(*) filter (value <= 1) as le_1, count(*) filter (value <= 5) as le_5, count(*) filter (value <= 10) as le_10, count(*) filter (value <= 50) as le_50 from events group by 1")
def event_counters(spark, d):
    return logs.counters(table(spark, d, "events"), "event_type", "value")


@query("select event_id, count(*) over w as recent, round(sum(value) over w, 4) as recent_total from events window w as (partition by user_id order by ts range between interval 3600 seconds preceding and current row)")
def rolling_events(spark, d):
    """Each user's events in the hour before each event."""
    return logs.rolling(table(spark, d, "events"), "user_id", "ts", "value", 3600).select("event_id", "recent", "recent_total")


@query("select start, start + interval 60 seconds as \"end\", event_type, count(*) as n from (select event_type, unnest([time_bucket(interval 15 seconds, ts) - interval 15 seconds * i for i in range(4)]) as start from events) group by 1, 2, 3")
def sliding_events(spark, d):
    """Counts in sliding minutes."""
    return logs.by_minute(table(spark, d, "events"), "ts", "event_type")


# ------------------------------------------------------------------ lines, cells, blocks


@query(
    f"""with l as (select doc_id, line, {S.norm('line')} as p from (select doc_id, unnest(lines) as line from (select distinct unit_id, doc_id, lines from units)))
    select doc_id, case when p = '' then 'empty' when regexp_matches(p, '^\\d{{1,2}}( \\d{{1,2}})*$') then 'numbers' when regexp_matches(p, '^(?:[.\\-]\\d{{1,2}}|\\d{{1,2}} ?[.\\-)])(?:[^0-9]|$)') then 'clause' when regexp_matches(line, '^[•●▪◦]') then 'bullet' else 'text' end as class, count(*) as n from l group by 1, 2"""
)
def line_classes(spark, d):
    """How many lines of each kind a document's units have."""
    lines = table(spark, d, "units").dropDuplicates(["unit_id"]).select("doc_id", F.explode("lines").alias("line"))
    c = F.col("line")
    kind = F.when(normalize.for_comparison(c) == "", "empty").when(text.bare_numbers(c), "numbers").when(text.clause_number(c).isNotNull(), "clause").when(text.bulleted(c), "bullet").otherwise("text")
    return lines.groupBy("doc_id", kind.alias("class")).agg(F.count("*").alias("n"))


_DAYS = "(?:الأحد|الإثنين|الاثنين|الثلاثاء|الأربعاء|الخميس|الجمعة|السبت)"


@query(
    f"""with c as (select distinct row_id, cell from (select row_id, unnest([title_ar, title_en, day_ar, day_en, date_gregorian, date_hijri]) as cell from calendar_rows) where cell is not null)
    select row_id, cell, case when regexp_matches(cell, '^\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}(?:-(?:\\d{{1,2}}/)?\\d{{1,2}})? ?م$') then 'gregorian' when regexp_matches(cell, '^\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}(?:-(?:\\d{{1,2}}/)?\\d{{1,2}})? ?هـ?$') then 'hijri'
    when regexp_matches(cell, '^{_DAYS}(?: ?- ?{_DAYS})?$') then 'days_ar' when regexp_matches(lower(cell), '^(?:sun|mon|tues|wednes|thurs|fri|satur)day(?: ?- ?(?:sun|mon|tues|wednes|thurs|fri|satur)day)?$') then 'days_en'
    when {S.count('cell', 'arabic_letters')} > {S.count('cell', 'latin_letters')} then 'arabic' when {S.count('cell', 'latin_letters')} > 0 then 'english' else 'other' end as kind from c"""
)
def segment_kinds(spark, d):
    """What each cell of a calendar card is, by its text alone."""
    cells = F.explode(F.array("title_ar", "title_en", "day_ar", "day_en", "date_gregorian", "date_hijri")).alias("cell")
    return table(spark, d, "calendar_rows").select("row_id", cells).where("cell is not null").distinct().withColumn("kind", text.segment_kind(F.col("cell")))


@query(
    """with c as (select distinct row_id, date_gregorian as c from calendar_rows), p as (select row_id, c, regexp_extract(c, '(\\d{4}/\\d{1,2}/\\d{1,2}-\\d{1,2})(?:[^\\d/]|$)', 1) as r from c)
    select row_id, case when r = '' then c else replace(c, r, regexp_extract(r, '^(\\d{4}/\\d{1,2})/', 1) || '/' || lpad(least(split_part(split_part(r, '/', 3), '-', 1)::int, split_part(r, '-', 2)::int)::varchar, 2, '0') || ' - ' || regexp_extract(r, '^(\\d{4}/\\d{1,2})/', 1) || '/' || lpad(greatest(split_part(split_part(r, '/', 3), '-', 1)::int, split_part(r, '-', 2)::int)::varchar, 2, '0')) end as dates from p"""
)
def readable_dates(spark, d):
    """Printed date ranges spelled in full."""
    return table(spark, d, "calendar_rows").dropDuplicates(["row_id"]).select("row_id", answers.readable_ranges(F.col("date_gregorian")).alias("dates"))


@query(
    """select distinct row_id, array_to_string(list_filter([case when trim(coalesce(title_ar, '')) <> '' then 'title: ' || trim(title_ar) end, case when trim(coalesce(day_en, '')) <> '' then 'day: ' || trim(day_en) end, case when trim(coalesce(date_hijri, '')) <> '' then 'hijri: ' || trim(date_hijri) end], lambda x: x is not null), '، ') as sentence
    from (select row_id, translate(title_ar, chr(160), chr(160)) as title_ar, day_en, date_hijri from calendar_rows)"""
)
def card_sentences(spark, d):
    """Calendar rows as sentences; empty cells are left out."""
    return table(spark, d, "calendar_rows").dropDuplicates(["row_id"]).select(
        "row_id", text.row_sentence(F.array(*map(F.lit, ("title", "day", "hijri"))), F.array("title_ar", "day_en", "date_hijri")).alias("sentence")
    )


_BLOCKS = "select reading_id, page_size, unnest(result.blocks) as b, generate_subscripts(result.blocks, 1) as i from readings where result.blocks is not null"


@query(
    f"""select distinct reading_id, i, b.category as category, round_even(b.box.l * page_size[1], 2) as l, round_even(b.box.t * page_size[2], 2) as t, round_even(b.box.r * page_size[1], 2) as r, round_even(b.box.b * page_size[2], 2) as b,
    round((b.box.r - b.box.l) * (b.box.b - b.box.t), 6) as area from ({_BLOCKS}) where b.box is not null and page_size is not null"""
)
def block_boxes(spark, d):
    """Layout blocks' boxes in points, and their share of the page."""
    r = table(spark, d, "readings").dropDuplicates(["reading_id"]).where("page_size is not null").select("reading_id", "page_size", F.posexplode("result.blocks").alias("i", "x")).where("x.box is not null")
    box = layout.in_points(F.col("x.box"), F.element_at("page_size", 1), F.element_at("page_size", 2))
    return r.select("reading_id", (F.col("i") + 1).cast("long").alias("i"), "x.category", box.alias("p"), F.round(layout.area(F.col("x.box")), 6).alias("area")).select("reading_id", "i", "category", "p.*", "area")


@query(
    f"""with x as (select distinct reading_id, i, b.category as category, b.text as text, b.box as box from ({_BLOCKS})),
    f as (select * from x qualify box is null or row_number() over (partition by reading_id, box order by i) = 1),
    n as (select *, count(*) over (partition by reading_id, category, text) as n, row_number() over (partition by reading_id, category, text order by i) as k from f)
    select reading_id, i, category from n where n < 5 or k = 1"""
)
def distinct_blocks(spark, d):
    """Layout blocks without repeats."""
    r = table(spark, d, "readings").dropDuplicates(["reading_id"]).select("reading_id", F.posexplode("result.blocks").alias("i", "x"))
    b = r.select("reading_id", (F.col("i") + 1).cast("long").alias("pos"), "x.category", "x.text", "x.box")
    return layout.deduplicated(b, "reading_id").select("reading_id", F.col("pos").alias("i"), "category")


@query(
    """with t as (select distinct reading_id, doc_id, page, result.text as text from readings), u as (select doc_id, page, string_agg(text, chr(10) order by seq, text) as got from (select distinct unit_id, doc_id, page, seq, text from units) group by 1, 2),
    r as (select distinct reading_id, doc_id, page, run from (select reading_id, doc_id, page, unnest(regexp_extract_all(text, '[0-9]+|[A-Za-z]+')) as run from t) where length(run) > 1 and reverse(run) <> run),
    j as (select reading_id, coalesce(contains(got, run), false) as intact, coalesce(contains(got, reverse(run)), false) as turned from r left join u using (doc_id, page))
    select reading_id, count(*) as total, count(*) filter (intact) as intact, count(*) filter (not intact and turned) as reversed, count(*) filter (not intact and not turned) as missing from j group by 1"""
)
def surviving_runs(spark, d):
    """Digit and Latin runs of readings that the units of their page hold."""
    r = table(spark, d, "readings").dropDuplicates(["reading_id"]).select("reading_id", "doc_id", "page", F.col("result.text").alias("text"))
    found = r.select("reading_id", "doc_id", "page").join(_pages(spark, d), ["doc_id", "page"]).select("reading_id", "text")
    return quality.runs_survive(r.select("reading_id", "text"), found, "reading_id")


@query("select word, frequency from (select *, lag(frequency) over (order by frequency desc, word) as before from lexicon) where before < frequency")
def lexicon_disorder(spark, d):
    """Lexicon rows out of descending order (none)."""
    numbered = table(spark, d, "lexicon").withColumn("line_no", F.struct((-F.col("frequency")).alias("f"), "word"))
    return quality.unsorted_rows(numbered).select("word", "frequency")


@query()
def sampled_documents(spark, d):
    """A hundred documents drawn by a seed."""
    return gold.seeded(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


# ------------------------------------------------------------------ the star schema

_both(
    "pricing_summary",
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
    from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus""",
    "lineitem",
)
_both(
    "open_orders",
    """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1995-03-15' and l_shipdate > timestamp '1995-03-15' group by l_orderkey, o_orderdate""",
    "customer", "orders", "lineitem",
)
_both(
    "nation_revenue",
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name""",
    "customer", "orders", "lineitem", "supplier", "nation", "region",
)
_both(
    "discounted_revenue",
    "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24",
    "lineitem",
)
_both(
    "order_cube",
    "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by grouping sets ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))",
    "orders",
)
_both(
    "top_orders",
    "select c_custkey, o_orderkey, rank from (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3",
    "orders",
)
_both(
    "idle_customers",
    "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "customer", "orders",
)
_both(
    "shared_nations",
    "select n_nationkey from nation where n_nationkey in (select c_nationkey from customer intersect select s_nationkey from supplier) except select s_nationkey from supplier where s_acctbal < 0 and s_nationkey < 3",
    "nation", "customer", "supplier",
)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The query of the smoke check."""
    return bm25_topk(spark, d)
