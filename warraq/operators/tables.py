"""HTML tables to grids, columns and sentences."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Cell:
    text: str
    header: bool
    rows: int
    columns: int


@dataclass
class Row:
    cells: list[Cell] = field(default_factory=list)
    in_head: bool = False

    @property
    def header(self) -> bool:
        return self.in_head or bool(self.cells) and all(c.header for c in self.cells)


class _Reader(HTMLParser):
    """Events to rows; cells and rows left open are closed by what follows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[Row] = []
        self.head = False
        self.cell: Cell | None = None
        self.parts: list[str] = []

    @staticmethod
    def _span(attrs: dict, name: str) -> int:
        value = attrs.get(name) or ""
        return max(1, int(value)) if value.isdigit() else 1

    def _close(self) -> None:
        if self.cell is not None:
            self.cell.text = " ".join("".join(self.parts).split())
            self.cell, self.parts = None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("thead", "tbody", "tfoot"):
            self._close()
            self.head = tag == "thead"
        elif tag == "tr":
            self._close()
            self.rows.append(Row(in_head=self.head))
        elif tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append(Row(in_head=self.head))
            a = dict(attrs)
            self.cell = Cell("", tag == "th", self._span(a, "rowspan"), self._span(a, "colspan"))
            self.rows[-1].cells.append(self.cell)
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()
        elif tag == "thead":
            self.head = False

    def handle_data(self, data):
        if self.cell is not None:
            self.parts.append(data)

    def close(self):
        super().close()
        self._close()


def rows_of(html: str) -> list[Row]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return [r for r in reader.rows if r.cells]


def grid(rows: list[Row]) -> list[tuple[bool, list[str]]]:
    """(is header, texts): merged cells repeat downwards; across, a header names each column and a value stands in the first."""
    out: list[tuple[bool, list[str]]] = []
    open_: dict[int, tuple[int, str]] = {}  # column -> rows still to fill, text
    for row in rows:
        line: dict[int, str] = {}
        for column in [c for c, (left, _) in open_.items() if left]:
            left, text = open_[column]
            line[column] = text
            open_[column] = (left - 1, text)
        column = 0
        for cell in row.cells:
            while column in line:
                column += 1
            for k in range(cell.columns):
                text = cell.text if k == 0 or row.header else ""
                line[column + k] = text
                open_[column + k] = (cell.rows - 1, text)
            column += cell.columns
        out.append((row.header, [line.get(i, "") for i in range(max(line) + 1)]))
    width = max((len(t) for _, t in out), default=0)
    return [(h, t + [""] * (width - len(t))) for h, t in out]


def columns_of(lines: list[tuple[bool, list[str]]]) -> list[str]:
    """A column's name: its distinct header texts, top to bottom."""
    heads = [t for h, t in lines if h]
    width = len(lines[0][1]) if lines else 0
    return [" ".join(dict.fromkeys(t[i] for t in heads if t[i])) for i in range(width)]


def sentences_of(html: str, caption: str = "") -> list[str]:
    """Each row of values as a sentence; empty cells and rows are left out."""
    lines = grid(rows_of(html))
    names = columns_of(lines)
    out = []
    for header, texts in lines:
        if header:
            continue
        said = "، ".join(f"{n}: {t}" if n else t for n, t in zip(names, texts) if t)
        if said:
            out.append(f"{caption}: {said}" if caption else said)
    return out


def _table_sentences(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else sentences_of(h))


def table_sentences(html: Column | str) -> Column:
    """``sentences_of`` over a column; null in, null out."""
    return F.pandas_udf(_table_sentences, "array<string>")(html)


def _table_grid(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else [{"header": bool(a), "cells": t} for a, t in grid(rows_of(h))])


def table_grid(html: Column | str) -> Column:
    """``grid`` over a column; null in, null out."""
    return F.pandas_udf(_table_grid, "array<struct<header:boolean,cells:array<string>>>")(html)


def _table_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else "\n".join(" ".join(c.text for c in r.cells if c.text) for r in rows_of(h)))


def table_text(html: Column | str) -> Column:
    """The rows of a table as plain lines, cells parted by spaces."""
    return F.pandas_udf(_table_text, "string")(html)
