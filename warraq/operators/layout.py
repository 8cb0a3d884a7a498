"""Order and cleaning of a page's layout blocks."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPEATS = 5
SLOTS = {"Page-header", "Page-footer"}


def fraction_box(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:  # noqa: E741
    """A pixel box as fractions of the page, within 0 and 1, to four places."""
    part = lambda x, whole: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / whole)), 4)
    return F.struct(part(l, width).alias("l"), part(t, height).alias("t"), part(r, width).alias("r"), part(b, height).alias("b"))


def in_points(box: Column, width: Column, height: Column) -> Column:
    """A box of fractions in points of the page, to two places."""
    return F.struct(F.bround(box["l"] * width, 2).alias("l"), F.bround(box["t"] * height, 2).alias("t"), F.bround(box["r"] * width, 2).alias("r"), F.bround(box["b"] * height, 2).alias("b"))


def area(box: Column) -> Column:
    return (box["r"] - box["l"]) * (box["b"] - box["t"])


def printed_scale(width: Column, height: Column) -> Column:
    """How much larger a page prints: one whose long edge is under two inches prints as A4."""
    edge = F.greatest(width, height)
    return F.when(edge < 144, 841.89 / edge).otherwise(1.0)


def model_size(width: Column, height: Column, limit: int = 11_289_600, least: int = 3136, step: int = 28) -> Column:
    """struct(width, height): the size that a vision model sees of an image: sides in steps, within a limit and a least number of pixels."""
    steps = lambda c: F.greatest(F.lit(step), c.cast("int") * step)
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    shrunk = lambda w, h: size(steps(F.floor(w / F.sqrt(w * h / limit) / step)), steps(F.floor(h / F.sqrt(w * h / limit) / step)))
    w, h = width.cast("double"), height.cast("double")
    near = size(steps(F.bround(w / step)), steps(F.bround(h / step)))
    pixels = lambda x: x["width"].cast("long") * x["height"]
    grow = F.sqrt(F.lit(float(least)) / (w * h))
    grown = size(F.ceil(w * grow / step) * step, F.ceil(h * grow / step) * step)
    grown = F.when(pixels(grown) > limit, shrunk(grown["width"].cast("double"), grown["height"].cast("double"))).otherwise(grown)
    return F.when(pixels(near) > limit, shrunk(w, h)).when(pixels(near) < least, grown).otherwise(near)


def deduplicated(blocks: DataFrame, *page: str) -> DataFrame:
    """Blocks without repeats: the first of each box, and of each (category, text) that stands there ``REPEATS`` times or more.

    blocks: page columns, pos, category, text, box.
    """
    same_box = F.row_number().over(Window.partitionBy(*page, "box").orderBy("pos"))
    said = Window.partitionBy(*page, "category", "text")
    first = blocks.withColumn("_box", F.when(F.col("box").isNull(), 1).otherwise(same_box)).where("_box = 1").drop("_box")
    return first.withColumn("_n", F.count("*").over(said)).withColumn("_i", F.row_number().over(said.orderBy("pos"))).where((F.col("_n") < REPEATS) | (F.col("_i") == 1)).drop("_n", "_i")


def line_rows(boxes: list[tuple[float, float, float, float]]) -> list[list[int]]:
    """Boxes (l, t, r, b) as printed rows from the top, each from right to left; indices of the boxes.

    A box joins the last row if its middle lies within the height of that row's tallest box and the other way round.
    """
    left, top, right, bottom = np.array(boxes, float).reshape(-1, 4).T
    middle, height = (top + bottom) / 2, bottom - top
    within = lambda a, b: top[b] <= middle[a] <= bottom[b]
    rows: list[list[int]] = []
    for i in map(int, np.argsort(middle, kind="stable")):
        tallest = rows[-1][int(np.argmax(height[rows[-1]]))] if rows else i
        if rows and within(i, tallest) and within(tallest, i):
            rows[-1].append(i)
        else:
            rows.append([i])
    return [sorted(r, key=lambda k: -right[k]) for r in rows]


#: Letters that tell a page's script.
_ARABIC, _LATIN = re.compile("[\u0621-\u064a]"), re.compile("[A-Za-z]")


def _mostly_arabic(texts: list[str]) -> bool:
    whole = "".join(texts)
    return len(_ARABIC.findall(whole)) > len(_LATIN.findall(whole))


def _cut(boxes: np.ndarray) -> tuple[int, bool] | None:
    """Where boxes, in the order they were read, are best parted in two, and whether the first part lies left of the second.

    Of all places where everything before lies wholly above everything after, or, with heights that overlap, wholly beside
    it, the one with the widest gap; rows before columns, then the first.
    """
    low, high = np.minimum.accumulate(boxes[:, :2]), np.maximum.accumulate(boxes[:, 2:])
    next_low, next_high = np.minimum.accumulate(boxes[::-1, :2])[::-1], np.maximum.accumulate(boxes[::-1, 2:])[::-1]
    (l, t), (r, b) = low[:-1].T, high[:-1].T  # noqa: E741
    (nl, nt), (nr, nb) = next_low[1:].T, next_high[1:].T
    beside = (t < nb) & (nt < b)
    gaps = np.stack([nt - b, np.where(beside, nl - r, -1.0), np.where(beside, l - nr, -1.0)], axis=1)
    if not (gaps >= 0).any():
        return None
    widest = gaps.max()
    rows = np.flatnonzero(gaps[:, 0] == widest)
    if len(rows):
        return int(rows[0]) + 1, False
    at, side = np.argwhere(gaps == widest)[0]
    return int(at) + 1, bool(side == 1)


def reading_order(blocks: list[dict]) -> list[int]:
    """The order to read a layout engine's blocks in; indices of the blocks.

    blocks: dicts of category, text, box (dict l t r b or None), in the engine's order.  That order is parted again and again
    where it moves on to another part of the page; two parts with text that were read left first are swapped.  Heads and
    feet keep their places.  A page that isn't mostly Arabic, or on which another block has no box, stays as it is.
    """
    free = [i for i, b in enumerate(blocks) if b["category"] not in SLOTS]
    if any(blocks[i]["box"] is None for i in free) or not _mostly_arabic([b["text"] or "" for b in blocks]):
        return list(range(len(blocks)))
    boxes = {i: [float(blocks[i]["box"][k]) for k in "ltrb"] for i in free}

    def arranged(part: list[int]) -> list[int]:
        cut = _cut(np.array([boxes[i] for i in part])) if len(part) > 1 else None
        if cut is None:
            return part
        at, left_first = cut
        halves = [part[:at], part[at:]]
        if left_first and all(any(blocks[i]["text"] for i in half) for half in halves):
            halves.reverse()
        return [i for half in halves for i in arranged(half)]

    order = iter(arranged(free))
    return [i if b["category"] in SLOTS else next(order) for i, b in enumerate(blocks)]


def _block_order(blocks: pd.Series) -> pd.Series:

    def one(bs):
        if bs is None:
            return None
        return reading_order([{"category": b["category"], "text": b["text"], "box": b["box"]} for b in bs])

    return blocks.map(one)


def block_order(blocks: Column | str) -> Column:
    """``reading_order`` over a column of arrays of blocks; null in, null out."""
    return F.pandas_udf(_block_order, "array<int>")(blocks)


def layout_blocks(answer: str | None) -> tuple[list[dict] | None, str]:
    """The blocks of an engine's layout answer and how they were read: json, recovered, or text (no blocks).

    A broken list is read block by block as far as whole objects go.
    """
    if not answer or "[" not in answer and "{" not in answer:
        return None, "text"
    body = re.sub(r"^```\w*\s*|\s*```$", "", answer.strip())
    try:
        made = json.loads(body)
        return [b for b in (made if isinstance(made, list) else [made]) if isinstance(b, dict)], "json"
    except ValueError:
        decoder, found, at = json.JSONDecoder(), [], body.find("{")
        while at >= 0:
            try:
                block, end = decoder.raw_decode(body, at)
                found.append(block)
            except ValueError:
                end = at + 1
            at = body.find("{", end)
        found = [b for b in found if isinstance(b, dict) and "category" in b]
        return (found, "recovered") if found else (None, "text")


def _parsed_layout(answer: pd.Series) -> pd.DataFrame:

    rows = []
    for a in answer:
        blocks, how = layout_blocks(a)
        rows.append((how, None if blocks is None else [{"category": str(b.get("category", "")), "text": str(b.get("text", ""))} for b in blocks]))
    return pd.DataFrame(rows, columns=["how", "blocks"])


def parsed_layout(answer: Column | str) -> Column:
    """``layout_blocks`` over a column."""
    return F.pandas_udf(_parsed_layout, "struct<how:string,blocks:array<struct<category:string,text:string>>>")(answer)


def insert_added(texts: Column, categories: Column, areas: Column, added: Column) -> Column:
    """Added paragraphs put after the largest picture, else before the feet at the end; all are arrays."""
    pictures = F.filter(F.sequence(F.lit(1), F.greatest(F.size(categories), F.lit(1))), lambda i: F.try_element_at(categories, i) == "Picture")
    largest = F.element_at(F.array_sort(F.transform(pictures, lambda i: F.struct((-F.element_at(areas, i)).alias("a"), i.alias("i")))), 1)["i"]
    feet = F.aggregate(F.reverse(categories), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, c: F.struct(F.when(acc["on"] & (c == "Page-footer"), acc["n"] + 1).otherwise(acc["n"]).alias("n"), (acc["on"] & (c == "Page-footer")).alias("on")), lambda acc: acc["n"])
    at = F.when(F.size(pictures) > 0, largest).otherwise(F.size(categories) - feet)
    return F.concat(F.slice(texts, F.lit(1), at), added, F.slice(texts, at + 1, F.size(texts)))
