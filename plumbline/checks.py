"""Checks of configuration values, put together from small rules; all raise on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import isfinite
from typing import Any

#: A rule says what a value should be, or nothing if it is.
Rule = Callable[[Any], "str | None"]


def whole(least: int) -> Rule:
    return lambda v: None if type(v) is int and v >= least else f"an integer of at least {least}"


def number(low: float, high: float, *, low_open: bool = False, high_open: bool = False) -> Rule:
    def rule(v: Any) -> str | None:
        fits = isinstance(v, (int, float)) and not isinstance(v, bool) and isfinite(v)
        fits = fits and (low < v if low_open else low <= v) and (v < high if high_open else v <= high)
        return None if fits else f"a number in {'(' if low_open else '['}{low}, {high}{')' if high_open else ']'}"

    return rule


def flag(v: Any) -> str | None:
    return None if v is True or v is False else "a boolean"


def named(v: Any) -> str | None:
    return None if isinstance(v, str) and v.strip() else "nonblank text"


def optional(rule: Rule) -> Rule:
    def rule_or_none(v: Any) -> str | None:
        want = None if v is None else rule(v)
        return want and f"{want} or None"

    return rule_or_none


def each(rule: Rule, *, distinct: bool = False) -> Rule:
    """Every item of a collection that isn't text itself."""

    def rule_of_all(v: Any) -> str | None:
        if isinstance(v, (str, bytes)) or not isinstance(v, Iterable):
            return "a collection"
        items = list(v)
        if distinct and len(set(items)) < len(items):
            return "a collection of distinct items"
        return next((f"a collection, each {want}" for want in map(rule, items) if want), None)

    return rule_of_all


def check(values: Any, **rules: Rule) -> None:
    """Raise ValueError for the first of an object's attributes (or a mapping's values) that breaks its rule."""
    for name, rule in rules.items():
        want = rule(values[name] if isinstance(values, dict) else getattr(values, name))
        if want:
            raise ValueError(f"{name} must be {want}")
