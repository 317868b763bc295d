"""Request parameters to column predicates."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import tokens

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


class BadRequest(ValueError):
    """A parameter without meaning."""


def every(parts: list[Column]) -> Column:
    """All of the parts; none is no filter."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def pairs(text: str, account: str = "act.account", name: str = "act.name") -> Column:
    """``code:action`` pairs separated by commas, any of which may match; ``*`` stands for anything."""
    found = []
    for item in text.split(","):
        code, colon, action = item.strip().partition(":")
        if not colon:
            raise BadRequest(f"no colon in filter {item!r}")
        found.append(every([F.col(c) == v for c, v in ((account, code), (name, action)) if v != "*"]))
    return reduce(lambda a, b: a | b, found)


def boundary(value: str, lower: bool, number: str = "block_num", moment: str = "`@timestamp`") -> Column:
    """An inclusive bound: a block number if the value is an integer, a time otherwise."""
    at, bound = (F.col(number), F.lit(int(value))) if value.isdigit() else (F.col(moment), F.lit(value))
    return at >= bound if lower else at <= bound


def limit_of(value: int | None, most: int = MAX_LIMIT) -> int:
    return min(DEFAULT_LIMIT if value is None else value, most)


def skip_set(items: list[str]) -> list[tuple[str, str]]:
    """``contract::action`` items as pairs; others are reported and ignored."""
    found = []
    for item in items:
        contract, colons, action = item.partition("::")
        if colons and contract and action:
            found.append((contract, action))
        else:
            logging.getLogger(__name__).warning("skip_actions: %r ignored", item)
    return found


def is_skipped(items: list[str], account: str = "act.account", name: str = "act.name") -> Column:
    return reduce(lambda a, b: a | b, [(F.col(account) == c) & (F.col(name) == a) for c, a in skip_set(items)], F.lit(False))


def has_any_token(text: Column, wanted: str) -> Column:
    """Full-text match: one token in common is enough."""
    return F.arrays_overlap(tokens(text), tokens(F.lit(wanted)))


def any_starts_with(items: Column, prefix: str) -> Column:
    return F.exists(items, lambda x: x.startswith(prefix))
