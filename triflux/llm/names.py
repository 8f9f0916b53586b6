"""Names for columns that are added to a table of unknown columns."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, with as many underscores before it as no taken name has, whatever its case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
