"""Public keys and signatures: binary to text with a checksum."""

from __future__ import annotations

import hashlib

from .cursor import Cursor, DecodeError

# Fixed values of the formats: kinds by tag, and the sizes of their parts.
KINDS = ("K1", "R1", "WA", "MLDSA44", "MLDSA65", "MLDSA87")
POINT, COMPACT = 33, 65
KEY_SIZES = {0: POINT, 1: POINT, 3: 1312, 4: 1952, 5: 2592}
SIGNATURE_SIZES = {0: COMPACT, 1: COMPACT, 3: 1312 + 2420, 4: 1952 + 3309, 5: 2592 + 4627}
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58(data: bytes) -> str:
    number, out = int.from_bytes(data, "big"), []
    # nine digits at a time, as dividing small numbers is cheaper
    while number:
        number, part = divmod(number, 58**9)
        for _ in range(9 if number else 0):
            part, k = divmod(part, 58)
            out.append(BASE58[k])
        while part:
            part, k = divmod(part, 58)
            out.append(BASE58[k])
    zeros = len(data) - len(data.lstrip(b"\0"))
    return BASE58[0] * zeros + "".join(reversed(out))


def from_base58(text: str) -> bytes | None:
    number = 0
    for c in text:
        k = BASE58.find(c)
        if k < 0:
            return None
        number = number * 58 + k
    zeros = len(text) - len(text.lstrip(BASE58[0]))
    return b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")


def checksum(data: bytes) -> bytes:
    return hashlib.new("ripemd160", data).digest()[:4]


def _text(prefix: str, kind: str, payload: bytes) -> str:
    return f"{prefix}_{kind}_{base58(payload + checksum(payload + kind.encode()))}"


def _taken(c: Cursor, sizes: dict[int, int], tail) -> tuple[str, bytes]:
    tag = c.unsigned(1)
    if tag >= len(KINDS):
        raise DecodeError(f"unknown key kind {tag}")
    start = c.at
    if tag in sizes:
        c.take(sizes[tag])
    else:
        tail(c)
    return KINDS[tag], c.data[start : c.at]


def _read(c: Cursor, prefix: str, sizes: dict[int, int], tail) -> str:
    return _text(prefix, *_taken(c, sizes, tail))


def public_key(c: Cursor) -> str:
    return _read(c, "PUB", KEY_SIZES, lambda c: (c.take(POINT + 1), c.block()))


def _signature_tail(c: Cursor) -> None:
    c.take(COMPACT), c.block(), c.block()


def signature(c: Cursor) -> str:
    return _read(c, "SIG", SIGNATURE_SIZES, _signature_tail)


def passed_signature(c: Cursor) -> None:
    """Goes past a signature without making its text; what is no signature is an error all the same."""
    _taken(c, SIGNATURE_SIZES, _signature_tail)


def normal_key(text: str) -> str:
    """Legacy keys (two to four letters and base 58 with a checksum of the bare key) in the present form; others as they are."""
    if not text.startswith("PUB_"):
        for size in (4, 3, 2):
            letters, data = text[:size], from_base58(text[size:])
            if letters.isascii() and letters.isalpha() and data and len(data) == POINT + 4 and checksum(data[:POINT]) == data[POINT:]:
                return _text("PUB", "K1", data[:POINT])
    return text
