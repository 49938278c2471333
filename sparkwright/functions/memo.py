"""Expressions made once.  A contract's rules and checks are a few thousand calls
from Python into the JVM; what they give depends on names and contract alone, not
on a table, so it is kept for the next plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")
#: Results kept for each function; past it the memory starts anew.
KEPT = 64


def remembered(f: Callable[..., T]) -> Callable[..., T]:
    """``f``, called once for equal arguments (by their text) in one JVM."""
    known: dict[tuple, T] = {}

    @wraps(f)
    def get(*args: object) -> T:
        key = (id(SparkContext._gateway), *map(repr, args))
        if key not in known:
            if len(known) >= KEPT:
                known.clear()
            known[key] = f(*args)
        return known[key]

    return get
