"""Readers: lines of JSON, frequency lists, tables by hand, calendars, page texts, files of many kinds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The schemas of what the engine reads and writes.
CHUNK = (
    "chunk_id string, doc_id string, doc_title string, scope string, effective string, page int, section_heading string, clause_no string, "
    "content_type string, extraction_method string, gate_score double, manually_verified boolean, text string"
)
QUESTION = "qid string, type string, lang string, question string, answerability_status string, split string, source_refs array<struct<doc_id:string,pdf_page:int,role:string,quotes:array<string>>>"
MANUAL_TABLE = "doc_id string, page int, caption string, columns array<string>, rows array<array<string>>, replaces array<string>, checked string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files of a fixed schema; blank lines are skipped, a malformed one raises an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checked_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, row, problem): every line that isn't blank, parsed or with its text as the problem.

    Lines are numbered within their file; files of gold questions are small, so the numbering's window holds a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.length(F.trim("value")) > 0)
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    parsed = numbered.withColumn("row", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.select("file", "line", "row", F.col("row._bad").alias("problem"))


def frequency_list(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """(word, frequency) of a tab-separated list, cut at a frequency (pushed to the reader as a filter)."""
    return spark.read.schema("word string, frequency bigint").option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path).where(F.col("frequency") >= least)


def zipped_frequency_list(spark: SparkSession, path: str, member: str, least: int = 0) -> DataFrame:
    """The same from a member of a zip archive: an archive is unpacked by one task, a line at a time; its order is checked."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    words, counts, last = [], [], None
                    for no, line in enumerate(io.TextIOWrapper(f, "utf-8"), 1):
                        word, _, count = line.rstrip("\n").partition("\t")
                        if not count.isdigit():
                            raise ValueError(f"{member}:{no}: not a word and a frequency")
                        n = int(count)
                        if last is not None and n > last:
                            raise ValueError(f"{member}:{no}: not in descending order")
                        last = n
                        if n < least:
                            break
                        words.append(word)
                        counts.append(n)
                        if len(words) == 50_000:
                            yield pa.RecordBatch.from_pydict({"word": words, "frequency": counts})
                            words, counts = [], []
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "frequency"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "word string, frequency long")


def manual_tables(spark: SparkSession, path: str) -> DataFrame:
    """Tables typed by hand; a row with more or fewer cells than columns raises an error."""
    t = spark.read.schema(MANUAL_TABLE).option("multiLine", True).json(path)
    whole = F.forall("rows", lambda r: F.size(r) == F.size("columns"))
    return t.where(F.coalesce(F.when(whole, F.lit(True)), F.raise_error(F.concat(F.lit("a row has not one cell a column: "), F.col("doc_id"))).cast("boolean")))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all strings; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def calendar_spans(spark: SparkSession, path: str) -> DataFrame:
    """(file, event, first, last) of iCalendar files: long lines unfolded; the end of an all-day event is exclusive, a timed one's not."""
    return ics_spans(spark.read.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("ics")))


def ics_spans(texts: DataFrame) -> DataFrame:
    """The spans of iCalendar texts (file, ics)."""
    unfolded = F.regexp_replace("ics", r"\r?\n[ \t]", "")
    events = texts.select("file", F.posexplode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), 1)).alias("event", "body"))
    day = lambda name: F.regexp_extract("body", rf"{name}[^:\r\n]*:(\d{{8}})", 1)
    timed = F.col("body").rlike(r"DTEND[^:\r\n]*:\d{8}T")
    first = F.try_to_date(day("DTSTART"), "yyyyMMdd")
    end = F.try_to_date(F.nullif(day("DTEND"), F.lit("")), "yyyyMMdd")
    last = F.when(end.isNull(), first).when(timed, end).otherwise(F.greatest(first, F.date_sub(end, 1)))
    return events.select("file", "event", first.alias("first"), last.alias("last")).where("first is not null")


def form_feed_pages(texts: DataFrame) -> DataFrame:
    """(doc_id, page, text) of texts (doc_id, text) whose pages are parted by form feeds; a blank last page is dropped."""
    parts = F.split("text", "\f")
    kept = F.when(F.element_at(parts, -1).rlike(r"(?U)^\s*$"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return texts.select("doc_id", F.posexplode(kept).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page"), "text")


def truth_pieces(files: DataFrame) -> DataFrame:
    """(name, doc_id, page, region, kind) of ground-truth files named doc_pNN, doc_pNN_rK, .txt or .csv."""
    shape = r"^(.*)_p(\d+)(?:_r(\d+))?\.(txt|csv)$"
    part = lambda i: F.regexp_extract("name", shape, i)
    own = files.where(F.col("name").rlike(shape)).select("name", part(1).alias("doc_id"), part(2).cast("int").alias("page"), F.when(part(3) != "", part(3).cast("int")).alias("region"), part(4).alias("ext"))
    tables = own.where("ext = 'csv'").select("doc_id", "page").distinct().withColumn("has_table", F.lit(True))
    kind = F.when(F.col("ext") == "csv", "table").when(F.col("region").isNotNull(), "region").when(F.col("has_table"), "partial").otherwise("page")
    return own.join(tables, ["doc_id", "page"], "left").select("name", "doc_id", "page", "region", kind.alias("kind"))


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of a folder's files in order of their paths."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length").orderBy("path")


def pages(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple[int, str, str | None]]], pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, page, text, error) of documents, by a parser given by the caller: bytes in, (page, text, error) out.

    A document is parsed by one task; one that can't be parsed comes out as a row with the error.
    """

    def run(batches):
        import os

        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                doc = os.path.splitext(os.path.basename(name))[0]
                try:
                    rows = [(doc, n, t.replace("\r\n", "\n") if t else "", e) for n, t, e in parse(content)]
                except Exception as e:  # noqa: BLE001
                    rows = [(doc, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "page", "text", "error"])

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(run, "doc_id string, page int, text string, error string")


def page(all_pages: DataFrame, number: int) -> DataFrame:
    """One page of each document, counted from 1."""
    if number < 1:
        raise ValueError("pages are counted from 1")
    return all_pages.where(F.col("page") == number)


def metadata(files: DataFrame) -> DataFrame:
    """(file, producer, creator) from bytes or strings: read as UTF-8, trimmed, missing as empty."""
    clean = lambda c: F.coalesce(F.trim(F.decode(F.col(c).cast("binary"), "UTF-8")), F.lit(""))
    return files.select("file", clean("producer").alias("producer"), clean("creator").alias("creator"))


def font_sample(fonts: DataFrame, pages: int = 5) -> DataFrame:
    """(doc_id, fonts): how many fonts the first pages of each document name; fonts: doc_id, page, font."""
    return fonts.where(F.col("page") <= pages).groupBy("doc_id").agg(F.count_distinct("font").alias("fonts"))


def setting(name: str, environment: dict[str, str], dotenv: str = "") -> str | None:
    """A setting by name: from the environment, else from a .env file's text (NAME=value, quotes off, comments aside); blank counts as missing."""
    if environment.get(name, "").strip():
        return environment[name].strip()
    for line in dotenv.splitlines():
        key, sign, value = line.strip().partition("=")
        if sign and not key.startswith("#") and key.removeprefix("export ").strip() == name and (value := value.strip().strip("\"'").strip()):
            return value
    return None
