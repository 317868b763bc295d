"""Names, symbols, assets and times, both ways."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from typing import NamedTuple

NAME_CHARS = ".12345abcdefghijklmnopqrstuvwxyz"
#: The first slot, in milliseconds since 1970; slots take half a second.
SLOT_EPOCH_MS, SLOT_MS = 946684800000, 500
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
INT64 = 1 << 63


@lru_cache(100_000)
def name_text(value: int) -> str:
    """Twelve characters of five bits from the top, and one of four."""
    chars = [NAME_CHARS[value >> shift & 31] for shift in range(59, 3, -5)] + [NAME_CHARS[value & 15]]
    return "".join(chars).rstrip(".")


def name_value(text: str) -> int | None:
    """The number of a name; None if it isn't one."""
    places = [NAME_CHARS.find(c) for c in text]
    if len(text) > 13 or -1 in places or (len(text) == 13 and places[12] > 15):
        return None
    value = 0
    for k, place in enumerate(places):
        value |= place if k == 12 else place << (59 - 5 * k)
    return value


def symbol_code_text(value: int) -> str | None:
    """Letters from the low byte on; None if a byte is not ASCII."""
    raw = value.to_bytes(8, "little").split(b"\0", 1)[0]
    return raw.decode("ascii") if raw.isascii() else None


def symbol_code_value(text: str) -> int | None:
    return int.from_bytes(text.encode(), "little") if re.fullmatch("[A-Z]{1,7}", text) else None


def symbol_text(value: int) -> str | None:
    code = symbol_code_text(value >> 8)
    return None if code is None else f"{value & 0xFF},{code}"


@lru_cache(10_000)
def symbol_value(text: str) -> int | None:
    precision, comma, code = text.partition(",")
    number = symbol_code_value(code) if comma and precision.isdigit() and int(precision) < 256 else None
    return None if number is None else number << 8 | int(precision)


class Asset(NamedTuple):
    """Units and symbol: 10000 units of 4,EOS are 1.0000 EOS."""

    amount: int
    symbol: int

    @property
    def precision(self) -> int:
        return self.symbol & 0xFF

    @property
    def code(self) -> str | None:
        return symbol_code_text(self.symbol >> 8)

    def number(self) -> float:
        return self.amount / 10.0**self.precision

    def text(self) -> str:
        """A precision whose power of ten is beyond 64 bits shows units as they are."""
        if not 0 < self.precision < 19:
            return f"{self.amount} {self.code}"
        digits = str(abs(self.amount)).rjust(self.precision + 1, "0")
        return f"{'-' if self.amount < 0 else ''}{digits[: -self.precision]}.{digits[-self.precision :]} {self.code}"


def parse_asset(text: str) -> Asset | None:
    """The asset that a text like ``1.0000 EOS`` stands for."""
    number, blank, code = text.partition(" ")
    found = re.fullmatch(r"([+-]?[0-9]+)(?:\.([+-]?[0-9]+)?)?", number)
    value = symbol_code_value(code)
    if not blank or not found or value is None:
        return None
    whole, part = int(found[1]), found[2] or ""
    amount = abs(whole) * 10 ** len(part) + int(part or 0)
    if len(part) > 18 or abs(whole) >= INT64 or abs(amount) >= INT64:
        return None
    return Asset(-amount if found[1][0] == "-" else amount, value << 8 | len(part))


def time_text(micros: int) -> str:
    """Milliseconds without zone; what the calendar can't show is the epoch."""
    try:
        moment = EPOCH + timedelta(microseconds=micros)
    except OverflowError:
        moment = EPOCH
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}"


def slot_ms(slot: int) -> int:
    return SLOT_EPOCH_MS + slot * SLOT_MS
