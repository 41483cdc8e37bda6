"""Column expressions over step-order strings such as `IMP→BAL→LNR→OUT`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = "→"
STEP_CODES = ("IMP", "OUT", "LNR", "BAL")
EMPTY_ORDER = "NONE"


def _col(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def steps(order: Column | str) -> Column:
    return F.split(_col(order), ARROW)


def position(order: Column | str, code: str) -> Column:
    """1-based position of a step, 0 if the order lacks it."""
    return F.array_position(steps(order), code)


def n_steps(order: Column | str) -> Column:
    return F.when(_col(order) == EMPTY_ORDER, 0).otherwise(F.size(steps(order)))


def before(order: Column | str, first: str, second: str) -> Column:
    """Whether `first` comes before `second`; NULL if the order lacks either."""
    at, other = position(order, first), position(order, second)
    return F.when((at > 0) & (other > 0), at < other)


def swap(order: Column | str, a: str, b: str) -> Column:
    """The same order with two steps exchanged."""
    exchanged = F.transform(
        steps(order), lambda s: F.when(s == a, F.lit(b)).when(s == b, F.lit(a)).otherwise(s)
    )
    return F.array_join(exchanged, ARROW)


def without(order: Column | str, code: str) -> Column:
    """The order less a step; NONE if that was all."""
    left = F.array_remove(steps(order), code)
    return F.when(F.size(left) == 0, F.lit(EMPTY_ORDER)).otherwise(F.array_join(left, ARROW))
