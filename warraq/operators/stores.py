"""Content-addressed stores: what is missing, what is kept, and lookups that must be whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_key


def keyed(df: DataFrame, kind: str, column: str) -> DataFrame:
    """Adds the key of a text under its kind."""
    return df.withColumn("key", text_key(F.lit(kind), F.col(column)))


def pair_key(a: Column, b: Column) -> Column:
    """The key of a pair of texts."""
    return text_key(a, b)


def missing(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """The wanted keys, each once, that the store hasn't got."""
    return wanted.select("key").distinct().join(store.select("key"), "key", "left_anti")


def pruned(store: DataFrame, live: DataFrame) -> DataFrame:
    """The store without what nothing refers to any more."""
    return store.join(live.select("key").distinct(), "key", "left_semi")


def lookup(wanted: DataFrame, store: DataFrame, value: str) -> DataFrame:
    """Wanted rows with their stored value; a key the store lacks raises an error that names it."""
    both = wanted.join(store.select("key", value, F.lit(True).alias("_held")), "key", "left")
    return both.withColumn(value, F.when(F.col("_held"), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("not in the store: "), F.col("key"))).cast(dict(store.dtypes)[value]))).drop("_held")


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Each key's row that arrived last."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_keyed(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows to a store, fanned out by the first two digits of the key."""
    rows.withColumn("fan", F.substring("key", 1, 2)).write.mode(mode).partitionBy("fan").parquet(path)


def described(rows: DataFrame, **meta: str) -> DataFrame:
    """Rows with what they were made by (model, prompt and the like), as a map that is stored beside each."""
    return rows.withColumn("meta", F.create_map(*(F.lit(x) for kv in sorted(meta.items()) for x in kv)) if meta else F.lit(None).cast("map<string,string>"))


def made_by(store: DataFrame, **meta: str) -> DataFrame:
    """The store's rows; one that was made by anything else raises an error."""
    same = F.lit(True)
    for k, v in meta.items():
        same = same & F.coalesce(F.try_element_at("meta", F.lit(k)) == v, F.lit(False))
    return store.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("made otherwise: "), F.col("key"))).cast("boolean")))


def usable(readings: DataFrame) -> DataFrame:
    """Cached readings that may be used again: neither cut off nor damaged (without text or with an error); of each key the last."""
    sound = readings.where("not coalesce(truncated, false) and text is not null and error is null")
    return latest(sound, "key", "read_at")


def page_record(page: Column, gate: Column, reading: Column) -> Column:
    """A page's record as one JSON text: the page's own fields, its gate and, if it was read by an engine, the reading."""
    return F.to_json(F.struct(page.alias("page"), gate.alias("gate"), reading.alias("ocr")), {"ignoreNullFields": "true"})
