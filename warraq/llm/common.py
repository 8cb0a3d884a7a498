"""What the training-data operators share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a lexicon that are sent to the workers; what the rest of a longer one says of a text goes there with the text.
VOCABULARY_WORDS = 100_000


class Lexicon(NamedTuple):
    """A frequency list: its most frequent words, and the others (word, frequency) if there are more."""

    words: list[str]
    rest: DataFrame | None


def vocabulary(lexicon: DataFrame, most: int = VOCABULARY_WORDS) -> Lexicon:
    """A list (word, frequency), most frequent words first, then by the word; repeated words count once, null ones not at all."""
    own = lexicon.where("word is not null").groupBy("word").agg(F.max(F.coalesce("frequency", F.lit(0))).alias("frequency"))
    rows = own.orderBy(F.desc("frequency"), "word").limit(most + 1).collect()
    if len(rows) <= most:
        return Lexicon([r.word for r in rows], None)
    last = rows[most - 1]
    after = (F.col("frequency") < last.frequency) | ((F.col("frequency") == last.frequency) & (F.col("word") > last.word))
    return Lexicon([r.word for r in rows[:most]], own.where(after))


def sent(lexicon: Lexicon | list[str]) -> list[str]:
    """The words that go to the workers."""
    return lexicon.words if isinstance(lexicon, Lexicon) else lexicon


def with_rest(items: DataFrame, key: list[str], lexicon: Lexicon | list[str], asks: Callable[[], Callable[[dict], Iterable[Iterable[str]]]], answers: Callable[[str], Iterable[str]]) -> DataFrame:
    """Items with ``rest_words``: the lexicon's words beyond those sent that bear on an item, most frequent first; null without any.

    ``asks()`` gives, once a task, a function from a batch (a dict of columns) to the keys that each item asks for;
    ``answers(word)`` gives the keys that a word answers.  The two meet in an equi-join of hashes, so lexica of any size serve
    and a task holds the words of one item.
    """
    if not isinstance(lexicon, Lexicon) or lexicon.rest is None:
        return items.withColumn("rest_words", F.lit(None).cast("array<string>"))
    kinds = dict(items.dtypes)

    def start():
        ask = asks()

        def work(c: dict) -> dict:
            out: dict[str, list] = {k: [] for k in (*key, "asked")}
            for i, keys in enumerate(ask(c)):
                for h in {_hash(k) for k in keys}:
                    for k in key:
                        out[k].append(c[k][i])
                    out["asked"].append(h)
            return out

        return work

    def hold():
        def work(c: dict) -> dict:
            rows = [(w, f, h) for w, f in zip(c["word"], c["frequency"]) for h in {_hash(k) for k in answers(w)}]
            return dict(zip(("word", "frequency", "asked"), map(list, zip(*rows)))) if rows else {"word": [], "frequency": [], "asked": []}

        return work

    asked = arrow_map(items, start, ", ".join(f"{k} {kinds[k]}" for k in key) + ", asked long").distinct()
    held = arrow_map(lexicon.rest.select("word", F.col("frequency").cast("long").alias("frequency")), hold, "word string, frequency long, asked long")
    word = F.struct((-F.col("frequency")).alias("f"), F.col("word").alias("w"))
    found = asked.join(held, "asked").groupBy(*key).agg(F.transform(F.array_sort(F.collect_set(word)), lambda x: x["w"]).alias("rest_words"))
    return items.join(found, key, "left")


def _hash(key: str) -> int:
    return (xxhash.xxh3_64_intdigest(key) ^ (1 << 63)) - (1 << 63)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder that ``spark.checkpoint.dir`` names: read from there, without the plan that made them.

    Where the setting is missing, as in tests, a folder of this machine takes its place.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
    path = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Take away the tables that this session wrote; frames that read them are of no use afterwards."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="warraq-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_MADE: dict[tuple, object] = {}


def once(make: Callable[[list[str]], object], words: list[str]):
    """``make(words)``, made once a Python worker and used by all of its tasks (it may hold caches, nothing of a task)."""
    key = (make, len(words), hash(tuple(words)))
    if key not in _MADE:
        if len(_MADE) >= 8:
            _MADE.clear()
        _MADE[key] = make(words)
    return _MADE[key]


def arrow_map(df: DataFrame, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain lists: ``start()`` runs once a task and gives the function of a batch.

    The function takes a dict of columns and returns one with the columns of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch.to_pydict()), schema=target)

    return df.mapInArrow(run, schema)
