"""Ordered string lists and vectors as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions import text as T


def ordered_unique(values: Column, max_count: int) -> Column:
    """Collapse white space, drop blanks, keep first occurrences, keep the first ``max_count``."""
    cleaned = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.collapse), lambda x: x != "")
    return F.slice(F.array_distinct(cleaned), 1, max_count)


def too_long(values: Column, limit: int) -> Column:
    return F.exists(values, lambda x: F.length(T.collapse(x)) > limit)


def without(values: Column, banned: Column) -> Column:
    """Items of a distinct list that are not banned, in order. Not a filter, whose function would work
    ``banned`` out again for every item."""
    return F.array_except(values, banned)


def join(values: Column, sep: str = "|") -> Column:
    return F.array_join(values, sep)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def all_finite(a: Column) -> Column:
    return F.forall(
        a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column], run: int = 32) -> Column:
    """The state after each element, in time linear in the elements.

    ``step`` takes the state before and the element. An array that grows by one element is copied each time, so states are
    gathered in short runs, runs in runs of runs, and those in one array.
    """

    def walked(states: Column, part: Column) -> Column:
        return F.aggregate(part, states, lambda done, x: F.array_append(done, step(F.element_at(done, -1), x)))

    def runs(of: Column, size: int, seed: Column, inner: Callable[[Column, Column], Column]) -> Column:
        """Nested arrays of states whose first element is only the seed."""
        places = F.sequence(F.lit(0), F.greatest(F.size(of) - 1, F.lit(0)), F.lit(size))
        return F.aggregate(
            places, F.array(seed), lambda done, at: F.array_append(done, inner(F.element_at(done, -1), F.slice(of, at + 1, F.lit(size))))
        )

    def short(before: Column, part: Column) -> Column:
        return walked(F.array(F.element_at(before, -1)), part)

    def long(before: Column, part: Column) -> Column:
        # The last run of the runs before leads on.
        return let(part, lambda own: runs(own, run, F.element_at(before, -1), short))

    def rest(x: Column) -> Column:
        return F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))

    # Every run opens with the state before it; the first of the runs at both levels is a seed.
    nested = let(values, lambda own: rest(runs(own, run * run, F.array(F.array(start)), long)))
    return F.flatten(F.transform(F.flatten(F.transform(nested, rest)), rest))
