"""Small helpers for building native array expressions."""
from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression built for given plain arguments.

    A nested array expression takes a second of driver time to build and holds no data, so the plans of
    one driver share it.
    """
    kept: dict = {}

    @wraps(build)
    def wrapper(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return wrapper


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst may inline a projected column into every place that reads it, also into lambdas that run
    once per element.  Binding it as a lambda variable evaluates it exactly once per row.
    """
    return F.transform(F.array(value), body)[0]


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def indexes(arr: Column) -> Column:
    """0..n-1, and an empty array when ``arr`` is empty."""
    n = F.size(arr)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def last_n(arr: Column, n: int) -> Column:
    size = F.size(arr)
    return F.slice(arr, F.greatest(size - n, F.lit(0)) + 1, F.lit(n))


def first_n(arr: Column, n: int) -> Column:
    return F.slice(arr, F.lit(1), F.lit(n))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """n neighbouring tokens joined by ``sep``."""

    def build(toks: Column) -> Column:
        starts = F.filter(indexes(toks), lambda i: i <= F.size(toks) - n)
        return F.transform(starts, lambda i: F.array_join(F.slice(toks, i + 1, F.lit(n)), sep))

    return let(tokens, build)
