"""Contracts of what a user may bring along: engines that read pages, steps, scorers and gates; and the registry of engines.

An engine is any object with ``available``, ``read_page`` and, if it likes, ``close``. It is built once for each Python worker that
needs it, reads the pages of Arrow batches as they come and never raises out of a task: an error is a column.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Engine(Protocol):
    def available(self) -> tuple[bool, str]:
        """Whether it can run here, and why not."""

    def read_page(self, page: Any) -> tuple[str, float]:
        """Text of a page and its confidence of 100; an empty text is a blank page."""


#: A step makes readings of pages; a scorer gives a number from 0 to 1 for a text, 0 for a blank one; a gate a reason.
Step = Callable[[DataFrame], DataFrame]
Scorer = Callable[[Column], Column]
Gate = Callable[..., Column]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[..., Engine]
    priority: int = 50
    platforms: tuple[str, ...] = ()  # none: everywhere
    description: str = ""
    only_witness: bool = False


@dataclass
class Registry:
    """Engines by name; the cheapest has the lowest priority."""

    entries: dict[str, Entry] = field(default_factory=dict)
    built: dict[tuple, Engine] = field(default_factory=dict)

    def register(self, name: str, build: Callable[..., Engine], **about) -> None:
        self.entries[name] = Entry(name, build, **about)

    def get(self, name: str, **options) -> Engine:
        """One engine for a name and its options, however often it is asked for."""
        if name not in self.entries:
            raise KeyError(f"no engine {name}; there are {', '.join(sorted(self.entries)) or 'none'}")
        key = (name, *sorted((k, repr(v)) for k, v in options.items()))
        if key not in self.built:
            self.built[key] = self.entries[name].build(**options)
        return self.built[key]

    def order(self, platform: str = sys.platform, excluded: dict[str, str] | None = None) -> list[str]:
        """Names of the engines that can run on ``platform``, by priority and name. ``excluded``: an engine and the one in whose
        presence it is left out. Witnesses are no engines of the cascade."""
        found = [e for e in self.entries.values() if not e.only_witness and (not e.platforms or platform in e.platforms) and self.get(e.name).available()[0]]
        names = [e.name for e in sorted(found, key=lambda e: (e.priority, e.name))]
        return [n for n in names if (excluded or {}).get(n) not in names]

    def report(self, platform: str = sys.platform) -> list[tuple[str, int, bool, str]]:
        """(name, priority, whether it runs here, why not) of every engine."""
        rows = []
        for e in sorted(self.entries.values(), key=lambda e: (e.priority, e.name)):
            fits = not e.platforms or platform in e.platforms
            can, why = self.get(e.name).available() if fits else (False, f"not on {platform}")
            rows.append((e.name, e.priority, can, "" if can else why))
        return rows


class TextLayer:
    """The engine that every installation has: what is already text is read as it is."""

    def available(self) -> tuple[bool, str]:
        return True, ""

    def read_page(self, page: str | None) -> tuple[str, float]:
        if page is None:
            raise ValueError("the page has no layer of text")
        return page.strip(), 100.0


REGISTRY = Registry()
REGISTRY.register("text_layer", TextLayer, priority=0, description="text that is already there")


def read_pages(pages: DataFrame, build: Callable[[], Engine], step: str, content: str = "content") -> DataFrame:
    """Pages (doc_id, step, page_no, text, confidence, error) as the engine of ``build`` reads the column ``content``.

    Filter ``pages`` first: every one is read. A page that fails has its error, cut to 160 characters, and a text of null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for frame in frames:
            out = []
            for content_ in frame["_content"]:
                try:
                    engine = engine or build()
                    text, confidence = engine.read_page(content_)
                    out.append((text, float(confidence), None))
                except Exception as error:  # noqa: BLE001 - one bad page never ends the job
                    out.append((None, None, str(error)[:160]))
            read = pd.DataFrame(out, columns=["text", "confidence", "error"], index=frame.index).astype({"text": object, "error": object, "confidence": float})
            yield pd.concat([frame[["doc_id", "page_no"]], read], axis=1)

    rows = pages.select("doc_id", "page_no", F.col(content).alias("_content"))
    read = rows.mapInPandas(run, "doc_id long, page_no int, text string, confidence double, error string")
    return read.withColumn("step", F.lit(step))


def read_batches(batches: DataFrame, build: Callable[[], Callable[[list], list[str]]], content: str = "contents") -> DataFrame:
    """Batches (doc_id, batch_no, page_nos) with ``responses`` and ``error``: what a remote reader says to the list in ``content``.

    ``build`` makes the client, once for each worker; without one nothing leaves the cluster. An answer that has not one text for
    each page is a failure of the batch, as is an exception; the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for frame in frames:
            out = []
            for pages, sent in zip(frame["page_nos"], frame["_contents"]):
                try:
                    client = client or build()
                    answers = list(client(list(sent)))
                    if len(answers) != len(pages):
                        raise ValueError(f"{len(answers)} answers to {len(pages)} pages")
                    out.append((answers, None))
                except Exception as error:  # noqa: BLE001
                    out.append((None, str(error)[:160]))
            yield pd.concat([frame[["doc_id", "batch_no", "page_nos"]], pd.DataFrame(out, columns=["responses", "error"], index=frame.index, dtype=object)], axis=1)

    rows = batches.select("doc_id", "batch_no", "page_nos", F.col(content).alias("_contents"))
    return rows.mapInPandas(run, "doc_id long, batch_no int, page_nos array<int>, responses array<string>, error string")
