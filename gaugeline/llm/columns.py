"""Column names of inputs and results side by side."""

from __future__ import annotations

from collections.abc import Iterable


def beside(columns: Iterable[str], new: Iterable[str]) -> list[str]:
    """The columns that results do not replace; names are compared as Spark does, without case."""
    taken = {n.lower() for n in new}
    return [c for c in columns if c.lower() not in taken]


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, or the first longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
