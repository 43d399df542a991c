"""The closed vocabulary of per-player fields and their reducers; unknown names are errors."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column

# Code -> kind of stream, in output order.
FIELDS = {
    "h": "number", "a": "number", "at": "text", "li": "number", "sh": "number", "nl": "number", "rk": "number", "cl": "number",
    "rl": "interval", "lg": "interval", "gl": "interval", "ssg": "interval", "sng": "interval", "q": "interval", "pe": "interval", "r": "interval",
    "pos": "position", "sp": "mark", "d": "mark",
}
REDUCERS = ("first", "last", "mean", "min", "max", "dominant", "held-any", "majority", "any")
NUMERIC = {"mean", "min", "max"}


def check_fields(codes: list[str] | None) -> list[str]:
    """The wanted fields in output order; none means all."""
    unknown = [c for c in codes or [] if c not in FIELDS]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return [c for c in FIELDS if not codes or c in codes]


class Reducer(NamedTuple):
    """A reducer of a user's own."""

    apply: Callable[[Column], Column]
    grouped: bool  #: a grouped-aggregate function of the values, in no order; else an expression over their array, in order of time
    empty: object  #: what it gives where there are no samples


_own: dict[str, Reducer] = {}


def register_reducer(name: str, apply: Callable[[Column], Column], grouped: bool = False, empty: object = None) -> None:
    """Makes ``name`` a reducer of bucket tables.

    ``apply`` gives an expression over the array of a cell's samples, in order of time (built-in functions stay in the JVM; a
    pandas UDF over arrays works too).  With ``grouped`` it is an aggregate of the values, such as a grouped-aggregate pandas
    UDF.  The built-in names can't be taken.
    """
    if not name or name in REDUCERS:
        raise ValueError(f"reserved reducer name: {name!r}")
    _own[name] = Reducer(apply, grouped, empty)


def own_reducer(name: str) -> Reducer | None:
    return _own.get(name)


def known_reducer(name: str) -> str:
    """``name``, if there is such a reducer; unknown names are errors."""
    if name not in REDUCERS and name not in _own:
        raise ValueError(f"unknown reducer: {name}")
    return name


def default_reducer(kind: str) -> str:
    """``any`` for marks, ``first`` for all else."""
    return "any" if kind == "mark" else "first"


def reducer_for(code: str, overrides: dict[str, str] | None = None) -> str:
    """An override, or the default of the field's kind; an empty override means ``last``."""
    name = (overrides or {}).get(code)
    return default_reducer(FIELDS[code]) if name is None else known_reducer(name or "last")
