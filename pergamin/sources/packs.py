"""Pattern packs: TOML files whose entries override those of the catalogue, one by one, on the driver.

What is read from the catalogue when a plan is built can be overridden: see ENTRIES. Packs stand on one another, the stronger on
top: the catalogue, the pack of a language, that of the environment, that of the caller.
"""

from __future__ import annotations

import contextlib
import os
import re
import tomllib
from collections.abc import Iterator, Mapping
from pathlib import Path

from pergamin.functions import catalogue

# The kinds an entry can be of; it must be of exactly one.
KINDS = ("pattern", "patterns", "words", "strings", "text", "map")


def load(path: str | Path) -> dict[str, dict]:
    """Entries by their dotted name, of one file or of all files of a folder in order of name, later ones on top."""
    path = Path(path)
    found: dict[str, dict] = {}
    for file in sorted(path.glob("*.toml")) if path.is_dir() else [path]:
        with file.open("rb") as f:
            found |= dict(_entries(tomllib.load(f), ""))
    return found


def _entries(table: Mapping, prefix: str):
    for name, value in table.items():
        if not isinstance(value, Mapping):
            raise ValueError(f"{prefix}{name} is no entry")
        if any(k in value and (k == "map" or not isinstance(value[k], Mapping)) for k in KINDS):
            yield f"{prefix}{name}", check(f"{prefix}{name}", dict(value))
        else:
            yield from _entries(value, f"{prefix}{name}.")


def check(name: str, entry: dict) -> dict:
    kinds = [k for k in KINDS if k in entry]
    if len(kinds) != 1:
        raise ValueError(f"{name} must be of one kind, not {kinds}")
    for regex in [entry["pattern"]] if "pattern" in entry else entry.get("patterns", []):
        try:
            re.compile(regex)
        except re.error as error:
            raise ValueError(f"{name}: {error}") from error
    if "words" in entry and isinstance(entry["words"], str):
        entry["words"] = entry["words"].split()
    return entry


def overlaid(*packs: Mapping[str, dict]) -> dict[str, dict]:
    """Packs from the weakest to the strongest, entry by entry."""
    out: dict[str, dict] = {}
    for pack in packs:
        out |= pack
    return out


#: Entries that can be overridden: their name, their kind and the name in the catalogue.
ENTRIES = {
    "metrics.stopwords": ("words", "STOPWORDS"), "metrics.domain": ("patterns", "DOMAIN"), "stamp.patterns": ("patterns", "STAMP"), "markers.unread": ("pattern", "UNREAD"),
    "screening.identity_marks": ("strings", "IDENTITY_MARKS"), "screening.vehicle_marks": ("strings", "VEHICLE_MARKS"), "lines.job_title": ("pattern", "JOB_TITLE"), "lines.stamp_keywords": ("pattern", "STAMP_KEYWORDS"),
    "lines.short_words": ("words", "SHORT_WORDS"), "routing.amount": ("pattern", "AMOUNT_MARK"), "routing.seal": ("pattern", "SEAL"), "prose.page_number_only": ("pattern", "PAGE_NUMBER_ONLY"),
}
#: Names the folder or file of a pack, from outside the program.
ENVIRONMENT = "PERGAMIN_PATTERNS"


def names(pack: Mapping[str, dict] = ENTRIES) -> list[str]:
    return sorted(set(pack))


def base() -> dict[str, dict]:
    """The entries of the catalogue as a pack."""
    return {name: {kind: getattr(catalogue, attribute)} for name, (kind, attribute) in ENTRIES.items()}


def resolved(own: str | Path | None = None, language: str | Path | None = None) -> dict[str, dict]:
    """The pack that holds: of the caller, else of the environment, over that of the language, over the catalogue."""
    outside = own or os.environ.get(ENVIRONMENT)
    return overlaid(base(), load(language) if language else {}, load(outside) if outside else {})


@contextlib.contextmanager
def used(pack: Mapping[str, dict]) -> Iterator[None]:
    """Plans built within use the entries of ``pack``; those before and behind do not. An entry of a name or kind that nothing reads is
    an error: it would do nothing."""
    for name, entry in pack.items():
        if name not in ENTRIES or ENTRIES[name][0] not in entry:
            raise ValueError(f"nothing reads {name} as {', '.join(entry)}; there are {', '.join(names())}")
    before = base()
    try:
        for name, entry in pack.items():
            kind, attribute = ENTRIES[name]
            setattr(catalogue, attribute, entry[kind])
        yield
    finally:
        for name, entry in before.items():
            setattr(catalogue, ENTRIES[name][1], next(iter(entry.values())))
