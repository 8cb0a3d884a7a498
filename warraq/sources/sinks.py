"""Writers: whole or not at all, by Spark's committers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in folders by a column if one is named; replaces what was there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def one_document(df: DataFrame, path: str, doc: str = "doc_id") -> None:
    """JSON lines of one document's records; more than one document raises an error."""
    if len(df.select(doc).distinct().take(2)) > 1:
        raise ValueError("records of more than one document")
    json_lines(df, path)


def csv_table(df: DataFrame, path: str) -> None:
    """CSV with a header and line feeds; nulls are empty."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("nullValue", "").csv(path)


def server_event(name: Column, data: Column) -> Column:
    """A server-sent event of a name and a struct."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table (a report: at most ``most`` rows)."""
    rows = df.limit(most).collect()
    lines = [df.columns, ["---"] * len(df.columns), *([("-" if v is None else str(v)) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def text_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table of aligned columns (a report: at most ``most`` rows)."""
    cells = [df.columns, *([("-" if v is None else str(v)) for v in r] for r in df.limit(most).collect())]
    widths = [max(map(len, c)) for c in zip(*cells)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip() for row in cells)


def labelling_sheet(items: DataFrame, folder: str) -> tuple[str, str, str]:
    """(page, labels, key): a page to read drawn answers from, an empty table for the labels, and the key that tells whose they are.

    items (item, run, arm, qid, question, answer), a sheet that one reads by hand, so a few hundred; the page names no run.
    """
    import html
    import os

    rows = items.orderBy("item").collect()
    os.makedirs(folder, exist_ok=True)
    paths = tuple(os.path.join(folder, n) for n in ("sheet.html", "labels.csv", "key.jsonl"))
    body = "".join(f"<section><h2>{r.item}</h2><p>{html.escape(r.question)}</p><blockquote>{html.escape(r.answer or '')}</blockquote></section>\n" for r in rows)
    texts = (
        f'<!doctype html><meta charset="utf-8"><title>Answers to label</title>\n{body}',
        "item,label,note\n" + "".join(f"{r.item},,\n" for r in rows),
        "".join(json.dumps({"item": r.item, "run": r.run, "arm": r.arm, "qid": r.qid}, ensure_ascii=False) + "\n" for r in rows),
    )
    for path, text in zip(paths, texts):
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return paths
