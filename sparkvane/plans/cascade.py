"""Ordered rules as data.

A cascade is a list of (condition, values) pairs; the first condition that holds gives the
values. It folds into one CASE expression of structs, so Catalyst evaluates the conditions
in order and stops at the first hit, and the order stays visible and testable.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[Column, Mapping[str, object]]


def _struct(values: Mapping[str, object]) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def first_match(rules: Sequence[Rule], otherwise: Mapping[str, object]) -> Column:
    """Struct of the first rule that holds, else of ``otherwise``. A null condition does not hold."""
    out = _struct(otherwise)
    for condition, values in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), _struct(values)).otherwise(out)
    return out


def first_reason(checks: Sequence[tuple[Column, Column | str]]) -> Column:
    """The text of the first check that fails (its condition holds); empty if all pass."""
    reasons = [F.when(F.coalesce(c, F.lit(False)), r if isinstance(r, Column) else F.lit(r)) for c, r in checks]
    return F.coalesce(*reasons, F.lit(""))


def all_reasons(checks: Sequence[tuple[Column, Column | str]]) -> Column:
    """Array of the texts of all checks whose condition holds, in order."""
    reasons = [F.when(F.coalesce(c, F.lit(False)), r if isinstance(r, Column) else F.lit(r)) for c, r in checks]
    return F.filter(F.array(*reasons), lambda x: x.isNotNull())


def holds(signals: Mapping[str, Column], wanted: str) -> Column:
    """Whether all signals of a list like ``"a b -c"`` are as it says: there, or (with a minus) not there."""
    out = F.lit(True)
    for name in wanted.split():
        there = F.coalesce(signals[name.removeprefix("-")], F.lit(False))
        out = out & (~there if name.startswith("-") else there)
    return out


def first_row(signals: Mapping[str, Column], table: Sequence[tuple], names: str) -> Column:
    """Struct (fields ``names``) of the first row (wanted signals, *values) of a rule table that holds; the
    last row wants nothing."""
    fields = names.split()
    *rows, last = [(holds(signals, row[0]), dict(zip(fields, row[1:], strict=True))) for row in table]
    return first_match(rows, last[1])


def bound(values: Mapping[str, Column], then: Callable[[dict[str, Column]], Column]) -> Column:
    """``then`` of the values, each of which is computed once however often it is used: a rule table asks
    for its signals many times, and a plan that repeats their expressions grows with every table."""
    return F.transform(F.array(_struct(values)), lambda v: then({k: v[k] for k in values}))[0]
