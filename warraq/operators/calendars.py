"""Calendar cards, date cells, weeks and semesters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How far a segment may lie from the card's anchor, in points, and how tall a row of cards is.
BELOW, ABOVE, ASIDE, BAND, GAP = 12.0, 60.0, 120.0, 20.0, 10.0


def date_cell(c: Column) -> Column:
    """struct(problem, first, last): the ends of a printed date cell as (y, m, d), in printed order; last is null for one day.

    One day ``y/m/d``, or a range whose second end leaves out what is the same, with the suffix of either calendar.
    """
    shape = r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})(?:\s*-\s*(?:(?:(\d{4})/)?(\d{1,2})/)?(\d{1,2}))?\s*(?:م|هـ?)?\s*$"
    part = lambda i: F.regexp_extract(c, shape, i)
    num = lambda i: F.when(part(i) != "", part(i).cast("int"))
    first = F.struct(num(1).alias("y"), num(2).alias("m"), num(3).alias("d"))
    last = F.when(part(6) != "", F.struct(F.coalesce(num(4), num(1)).alias("y"), F.coalesce(num(5), num(2)).alias("m"), num(6).alias("d")))
    sound = lambda x: x["m"].between(1, 12) & x["d"].between(1, 31)
    problem = F.when(~F.coalesce(c.rlike(shape), F.lit(False)), "malformed").when(~sound(first) | F.coalesce(~sound(last), F.lit(False)), "out of range")
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), first).alias("first"), F.when(problem.isNull(), last).alias("last"))


def gregorian(end: Column) -> Column:
    """The date of an end, or null if there is none such."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", end["y"], end["m"], end["d"]))


def span_days(cell: Column, hijri: bool = False) -> Column:
    """Days between the ends of a cell: exact in the Gregorian calendar, by months of 30 days in the other; 0 for one day."""
    if hijri:
        count = lambda e: (e["y"] * 12 + e["m"]) * 30 + e["d"]
        days = F.abs(count(cell["last"]) - count(cell["first"]))
    else:
        days = F.abs(F.date_diff(gregorian(cell["last"]), gregorian(cell["first"])))
    return F.when(cell["first"].isNull(), None).when(cell["last"].isNull(), 0).otherwise(days)


def span_disagreement(g: Column, h: Column) -> Column:
    """Whether the two calendars' spans differ by more than a day; null if either is unknown."""
    return F.abs(span_days(g) - span_days(h, True)) > 1


def weekday_disagreement(cell: Column, days_en: Column) -> Column:
    """What is wrong with the printed English weekdays of a Gregorian cell, or null."""
    ends = F.array_sort(F.array_compact(F.array(gregorian(cell["first"]), gregorian(cell["last"]))))
    due = F.array_join(F.transform(ends, lambda d: F.date_format(d, "EEEE")), " - ")
    printed = F.regexp_replace(F.trim(days_en), r"\s*-\s*", " - ")
    missing = gregorian(cell["first"]).isNull() | (cell["last"].isNotNull() & gregorian(cell["last"]).isNull())
    return F.when(cell["first"].isNull() | days_en.isNull(), None).when(missing, "no such date").when(printed != due, F.concat(F.lit("should be "), due))


def semesters(starts: DataFrame) -> DataFrame:
    """(name, start, end) of semesters from their starts (name, start): each ends where the next begins; the last only closes."""
    end = F.lead("start").over(Window.orderBy("start"))  # a handful of rows a year
    return starts.withColumn("end", end).where(F.col("end").isNotNull())


# How a card gives a semester's first day.
SEMESTER_START = r"بداية الفصل[^:]*:[^0-9]*(20\d\d)/(\d{1,2})/(\d{1,2})"


def semester_start(c: Column) -> Column:
    """The Gregorian date that a card gives for a semester's first day, or null."""
    y, m, d = (F.regexp_extract(c, SEMESTER_START, i) for i in (1, 2, 3))
    return F.when(c.rlike(SEMESTER_START), F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))))


def week(day: Column, start: Column, end: Column) -> Column:
    """The week of a span a day falls in, from 1; null outside it."""
    return F.when((day >= start) & (day < end), F.floor(F.date_diff(day, start) / 7).cast("int") + 1)


def weeks(spans: DataFrame) -> DataFrame:
    """(name, week, first, last): the weeks of spans (name, start, end), seven days each."""
    days = F.posexplode(F.sequence("start", F.date_sub("end", 1), F.expr("interval 7 days"))).alias("i", "first")
    return spans.select("name", days).select("name", (F.col("i") + 1).alias("week"), "first", F.date_add("first", 6).alias("last"))


def hijri_dates(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day, y, m, d): the Umm al-Qura dates of a span of days.

    The calendar's months are asked of the JVM's chronology, one call a month; their days are made by Spark.
    """
    import datetime as dt

    date = spark.sparkContext._jvm.java.time.chrono.HijrahDate
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    # a year of either calendar is at most 3 % longer than the other's, so the guess needs a margin of months only
    guess = lambda day: int((day.toordinal() - dt.date(622, 7, 19).toordinal()) / 29.530588)
    months = [(n // 12 + 1, n % 12 + 1) for n in range(guess(a) - 2, guess(b) + 4)]
    starts = [(y, m, date.of(y, m, 1).toEpochDay()) for y, m in months]
    rows = [(y, m, s, e) for (y, m, s), (_, _, e) in zip(starts, starts[1:])]
    day = F.date_from_unix_date((F.col("s") + F.col("i")).cast("int"))
    spans = spark.createDataFrame(rows, "y int, m int, s long, e long").select("y", "m", "s", F.posexplode(F.sequence(F.col("s"), F.col("e") - 1)).alias("i", "x"))
    return spans.select(day.alias("day"), "y", "m", (F.col("i") + 1).alias("d")).where(F.col("day").between(F.lit(a), F.lit(b)))


def spelled_hijri(y: Column, m: Column, d: Column, months: tuple[str, ...]) -> Column:
    """A date of the other calendar spelled out: day, month's name, year."""
    return F.concat_ws(" ", d.cast("string"), F.element_at(F.array(*map(F.lit, months)), m), y.cast("string"))


def today(clock: Column | None = None, zone: str = "UTC+3") -> Column:
    """The date in the calendar's zone; a clock (a timestamp in UTC) may be given."""
    return F.to_date(F.from_utc_timestamp(F.current_timestamp() if clock is None else clock, zone))


# How a card's heading names its semester.
SEMESTER = r"(الفصل\s+(?:الدراسي\s+)?(?:الأول|الثاني|الثالث|الصيفي))|((?i)(?:first|second|third|summer)\s+semester)"


def semester_heading(c: Column) -> Column:
    """The semester that a text above a card names, in either language, or null."""
    found = F.regexp_extract(c, SEMESTER, 0)
    return F.when(found != "", F.regexp_replace(found, r"\s+", " "))


def calendar_source(spans: DataFrame, day: Column, note: str = "") -> DataFrame:
    """(text): a source that tells a model the time: a header, today's line, a line per semester and the weeks of the running one.

    spans: name, start, end (a handful).
    """
    own = spans.withColumn("_day", day).withColumn("_week", week(F.col("_day"), F.col("start"), F.col("end")))
    line = F.concat(F.col("name"), F.lit(": "), F.col("start").cast("string"), F.lit(" - "), F.date_sub("end", 1).cast("string"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), line.alias("line"))))
    running = F.max(F.when(F.col("_week").isNotNull(), F.concat(F.col("name"), F.lit(", week "), F.col("_week").cast("string"))))
    made = own.agg(F.max("_day").alias("day"), listed.alias("lines"), running.alias("now"))
    head = F.concat_ws("\n", F.lit("Calendar"), F.when(F.lit(note) != "", F.lit(note)), F.concat(F.lit("Today: "), F.col("day").cast("string"), F.coalesce(F.concat(F.lit(" ("), F.col("now"), F.lit(")")), F.lit(""))))
    return made.select(F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def segments(chars: DataFrame, *line: str, gap: float = GAP) -> DataFrame:
    """(line..., segment, text, l, r): a line's characters (pos, ch, l, r) parted where one lies more than ``gap`` from all before it.

    A fold over each line in the order of its characters, in the JVM; spaces belong to no segment's ends.
    """
    row = F.struct("pos", "ch", F.col("l").cast("double").alias("l"), F.col("r").cast("double").alias("r"))
    grouped = chars.groupBy(*line).agg(F.array_sort(F.collect_list(row)).alias("chars"))
    empty = F.array().cast("array<struct<text:string,l:double,r:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = last.isNull() | (x["l"] - last["r"] > gap) | (last["l"] - x["r"] > gap)
        grown = F.struct(F.concat(last["text"], x["ch"]).alias("text"), F.least(last["l"], x["l"]).alias("l"), F.greatest(last["r"], x["r"]).alias("r"))
        fresh = F.struct(x["ch"].alias("text"), x["l"].alias("l"), x["r"].alias("r"))
        blank = F.trim(x["ch"]) == ""
        spaced = F.struct(F.concat(last["text"], x["ch"]).alias("text"), last["l"].alias("l"), last["r"].alias("r"))
        init = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(blank & last.isNull(), acc).when(blank, F.concat(init, F.array(spaced))).when(apart, F.concat(acc, F.array(fresh))).otherwise(F.concat(init, F.array(grown)))

    made = grouped.select(*line, F.posexplode(F.aggregate("chars", empty, step)).alias("i", "x"))
    return made.select(*line, (F.col("i") + 1).alias("segment"), F.trim("x.text").alias("text"), "x.l", "x.r")


def hour(ts: Column) -> Column:
    return F.date_format(F.date_trunc("HOUR", ts), "yyyy-MM-dd'T'HH:00'Z'")


# Questions about time, as compared.
ABOUT_TIME = [
    r"اي\s*اسبوع(?!ي)", r"الاسبوع\s+(ال)?كم", r"(هذا|ذا)\s+الاسبوع|هالاسبوع", r"الاسبوع\s+(الحالي|الجاي|القادم|الماضي)",
    r"كم\s+(يوم|ايام|اسبوع|اسابيع|شهر)\s+(باقي|بقي|متبقي|يبقي|علي|عن|لين|حتي|قبل)", r"(باقي|بقي|متبقي)\s+(علي|عن|لين|حتي)",
    r"تاريخ\s+اليوم|اليوم\s+(كم|وش|ايش)|(وش|ايش|كم)\s+(ال)?تاريخ",
]
ABOUT_TIME_EN = r"\b(which|what) week\b|\bthis week\b|\bcurrent week\b|\btoday\b|\bdate is it\b|\bhow (many|long)\b.*\b(left|until|till|remaining)\b"


def asks_about_time(c: Column) -> Column:
    """Whether a question asks for a week, today's date or the time until something."""
    from ..functions.normalize import for_comparison

    own = for_comparison(c)
    return own.rlike("|".join(f"(?:{p})" for p in ABOUT_TIME)) | F.lower(own).rlike(ABOUT_TIME_EN)


# ------------------------------------------------------------------ cards


def card_of(segments: DataFrame, anchors: DataFrame, *page: str) -> DataFrame:
    """(page..., segment, anchor): the card each segment belongs to: the anchor in reach whose middle is nearest, the first on ties.

    segments and anchors have page columns, pos, l, t, r, b; a segment out of every anchor's reach has none.  The join is by page.
    """
    s = segments.select(*page, F.col("pos").alias("segment"), F.col("t").alias("st"), F.col("b").alias("sb"), ((F.col("l") + F.col("r")) / 2).alias("sm"))
    a = anchors.select(*page, F.col("pos").alias("anchor"), F.col("t").alias("at"), F.col("b").alias("ab"), ((F.col("l") + F.col("r")) / 2).alias("am"))
    away = F.abs(F.col("sm") - F.col("am"))
    near = s.join(a, list(page)).where((F.col("st") <= F.col("ab") + BELOW) & (F.col("at") - F.col("sb") <= ABOVE) & (away <= ASIDE))
    best = near.groupBy(*page, "segment").agg(F.min_by("anchor", F.struct(away.alias("away"), "anchor")).alias("anchor"))
    return s.select(*page, "segment").join(best, [*page, "segment"], "left")


def bands(anchors: DataFrame, *page: str, height: float = BAND) -> DataFrame:
    """Adds band (from 1) and place: anchors from the top, a band holding all within ``height`` of its first; right to left within.

    A fold over each page's anchors, in the JVM.
    """
    row = F.struct(F.col("t").alias("t"), "pos", ((F.col("l") + F.col("r")) / 2).alias("mid"))
    grouped = anchors.groupBy(*page).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).alias("band"), F.lit(None).cast("double").alias("top"), F.array().cast("array<struct<band:int,pos:bigint,mid:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["top"].isNull() | (x["t"] - acc["top"] > height)
        band = F.when(fresh, acc["band"] + 1).otherwise(acc["band"])
        return F.struct(band.alias("band"), F.when(fresh, x["t"]).otherwise(acc["top"]).alias("top"), F.concat(acc["out"], F.array(F.struct(band.alias("band"), x["pos"].cast("bigint").alias("pos"), x["mid"].alias("mid")))).alias("out"))

    made = grouped.select(*page, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x")).select(*page, "x.*")
    return made.withColumn("place", F.row_number().over(Window.partitionBy(*page, "band").orderBy(F.desc("mid"), "pos")))


def stray_days(dates: DataFrame, days: DataFrame) -> DataFrame:
    """Dates of a calendar table that its published calendar doesn't have."""
    return dates.join(days.select("day").distinct(), "day", "left_anti")


def calendar_report(rows: DataFrame) -> DataFrame:
    """(row_id, problem) of calendar rows: malformed or impossible dates, spans that differ, wrong weekdays, blank cells."""
    g, h = date_cell(F.col("date_gregorian")), date_cell(F.col("date_hijri"))
    own = rows.select("row_id", "title_ar", "day_en", "date_hijri", g.alias("g"), h.alias("h"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("g.problem").isNotNull(), F.concat(F.lit("gregorian "), F.col("g.problem"))),
            F.when(F.col("date_hijri").isNotNull() & F.col("h.problem").isNotNull(), F.concat(F.lit("hijri "), F.col("h.problem"))),
            F.when(F.col("date_hijri").isNotNull() & span_disagreement(F.col("g"), F.col("h")), "spans differ"),
            weekday_disagreement(F.col("g"), F.col("day_en")),
            F.when(F.length(F.trim(F.coalesce("title_ar", F.lit("")))) == 0, "no title"),
        )
    )
    return own.select("row_id", F.explode(problems).alias("problem")).distinct()


def against_published(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(row_id, problem) of printed Gregorian dates against a published calendar's events.

    rows: row_id, date_gregorian; spans: first, last of each event.  A printed day must lie in some event, and a printed range must
    be one event's first and last day, in either order.  Malformed dates and such as don't exist are left to ``calendar_report``.
    """
    own = rows.select("row_id", date_cell(F.col("date_gregorian")).alias("c")).where("c.problem is null")
    ends = F.array_sort(F.array_compact(F.array(gregorian(F.col("c.first")), gregorian(F.col("c.last")))))
    own = own.select("row_id", ends.alias("ends"), F.col("c.last").isNotNull().alias("range"))
    # an event of a few days gives each of them; calendars are small, and the join is by the day
    days = spans.select(F.explode(F.sequence("first", "last")).alias("day")).distinct()
    absent = own.select("row_id", F.explode("ends").alias("day")).join(days, "day", "left_anti").select("row_id", F.concat(F.lit("not published: "), F.col("day").cast("string")).alias("problem"))
    pairs = spans.select(F.col("first").alias("_a"), F.col("last").alias("_b")).distinct()
    ranged = own.where("range and size(ends) = 2").select("row_id", F.element_at("ends", 1).alias("_a"), F.element_at("ends", 2).alias("_b"))
    unmatched = ranged.join(pairs, ["_a", "_b"], "left_anti").select("row_id", F.lit("not one event's first and last day").alias("problem"))
    return absent.unionByName(unmatched).distinct()


def placed_days(days: DataFrame, spans: DataFrame) -> DataFrame:
    """(day, name, week) of days (day) in semesters (name, start, end): the one that a day falls in and its week; nulls outside.

    Semesters are a handful a year and don't overlap: their days are laid out, so the join is by the day.
    """
    laid = spans.select("name", "start", "end", F.explode(F.sequence("start", F.date_sub("end", 1))).alias("day"))
    return days.join(laid, "day", "left").select("day", "name", week(F.col("day"), F.col("start"), F.col("end")).alias("week"))
