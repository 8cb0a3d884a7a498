"""Reading engines as sources: a page's image in, its text and layout out.

An engine is built in the task from a recipe that is sent there, and reads the
pages of its partition one after the other; a page that it fails on comes out as
a row with the error.  ``Scripted`` answers from a table, for tests and replays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = pa.struct([("category", pa.string()), ("text", pa.string()), ("html", pa.string())])
READ = "key string, engine string, text string, blocks array<struct<category:string,text:string,html:string>>, warnings string, truncated boolean, error string"


class Engine(Protocol):
    """One engine with everything fixed that can change what it reads."""

    def tag(self) -> str:
        """A short name of this configuration; readings are stored under it."""

    def describe(self) -> str:
        """Versions, models and settings, for reports."""

    def recognize(self, png: bytes) -> dict[str, Any]:
        """A page's reading: text, and where there are any blocks, warnings and truncated."""


class TextEngine(Engine, Protocol):
    """An engine that reads layout and can also read a page for its text alone."""

    def text_tag(self) -> str: ...

    def read_text(self, png: bytes) -> dict[str, Any]: ...


class Scripted:
    """Answers by the image's hash; an image that it doesn't know raises an error."""

    def __init__(self, answers: dict[str, dict[str, Any]], name: str = "scripted"):
        self.answers, self.name = answers, name

    def tag(self) -> str:
        return self.name

    def describe(self) -> str:
        return f"{self.name}: {len(self.answers)} answers"

    def recognize(self, png: bytes) -> dict[str, Any]:
        return self.answers[hashlib.sha256(png).hexdigest()]

    def text_tag(self) -> str:
        return f"{self.name}-text"

    def read_text(self, png: bytes) -> dict[str, Any]:
        return {"text": self.recognize(png)["text"]}


def read(images: DataFrame, build: Callable[[], Engine], text_only: bool = False) -> DataFrame:
    """The readings (see ``READ``) of images (key, png) by an engine that ``build`` makes, once a task."""
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.list_(BLOCK), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for b in batches:
            engine = engine or build()
            tag, ask = (engine.text_tag(), engine.read_text) if text_only else (engine.tag(), engine.recognize)
            rows = []
            for key, png in zip(b.column("key").to_pylist(), b.column("png").to_pylist()):
                try:
                    r = ask(png)
                    blocks = None if r.get("blocks") is None else [{k: x.get(k) for k in ("category", "text", "html")} for x in r["blocks"]]
                    rows.append((key, tag, r.get("text"), blocks, r.get("warnings"), bool(r.get("truncated")), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((key, tag, None, None, None, False, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return images.select("key", "png").mapInArrow(run, READ)


#: A line by which it is told whether a parser keeps the order of right-to-left words.
PROBE = "العربية لغة تكتب من اليمين"


def check_order(parse: Callable[[bytes], Iterator[tuple[int, str, str | None]]], make: Callable[[str], bytes], probe: str = PROBE) -> None:
    """An error if a parser reads a line that ``make`` sets in another order of words; to be asked once, before the first page."""
    got = " ".join(" ".join(t or "" for _, t, _ in parse(make(probe))).split())
    if got != probe:
        raise ValueError(f"the parser reads {probe!r} as {got!r}: it would put the words of every line out of order")
