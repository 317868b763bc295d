"""The way back: binary data from values, by the same schemas that decode it (see ``schema`` and ``wire``)."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from .cursor import varuint32
from .scalars import name_value, symbol_value
from .schema import PACKED, SECTIONS, Schema
from .wire import WIRE


def integer(size: int) -> Callable[[int], bytes]:
    return lambda value: value.to_bytes(size, "little", signed=value < 0)


@lru_cache(100_000)
def name(text: str) -> bytes:
    return integer(8)(name_value(text))


def block(data: bytes | str) -> bytes:
    """Bytes, or a text's, after their length."""
    raw = data.encode() if isinstance(data, str) else data
    return varuint32(len(raw)) + raw


def asset(units: int, symbol: str) -> bytes:
    return integer(8)(units) + integer(8)(symbol_value(symbol))


#: Writers of built-in types. Keys and signatures are given as the bytes they have, times and slots as numbers.
WRITERS: dict[str, Callable[[Any], bytes]] = {
    "bool": lambda v: bytes([v]),
    **{f"{sign}int{n}": integer(n // 8) for sign in ("", "u") for n in (8, 16, 32, 64, 128)},
    "varuint32": varuint32,
    "varint32": lambda v: varuint32(v << 1 if v >= 0 else ~(v << 1)),
    "float32": lambda v: struct.pack("<f", v),
    "float64": lambda v: struct.pack("<d", v),
    "time_point": integer(8),
    "time_point_sec": integer(4),
    "block_timestamp_type": integer(4),
    "name": name,
    "string": block,
    "bytes": block,
    "raw": block,
    **{f"checksum{n}": bytes.fromhex for n in (160, 256, 512)},
    "public_key": bytes,
    "signature": bytes,
    "symbol": lambda v: integer(8)(symbol_value(v)),
    "asset": lambda v: asset(*v),
}


def writer(schema: Schema, kind: str) -> Callable[[Any], bytes]:
    """The writer of a type, made once a schema."""
    if kind not in schema.writers:
        schema.writers[kind] = _made(schema, kind)
    return schema.writers[kind]


def _made(schema: Schema, kind: str) -> Callable[[Any], bytes]:
    # inner writers are looked up when they are used: types may refer to themselves
    if kind.endswith("$"):
        return lambda v: b"" if v is None else writer(schema, kind[:-1])(v)
    if kind.endswith("?"):
        return lambda v: b"\0" if v is None else b"\1" + writer(schema, kind[:-1])(v)
    if kind.endswith("[]"):
        return lambda v: varuint32(len(v)) + b"".join(map(writer(schema, kind[:-2]), v))
    if kind in schema.structs:
        base, fields = schema.structs[kind]
        compiled: list[tuple[str, Callable[[Any], bytes]]] = []

        def struct_of(value: dict) -> bytes:
            if len(compiled) < len(fields):
                compiled[:] = [(field, writer(schema, of)) for field, of in fields]
            parts = [write(value.get(field)) for field, write in compiled]
            return b"".join([writer(schema, base)(value), *parts] if base else parts)

        return struct_of
    if kind in schema.variants:
        numbers = {form: varuint32(k) for k, form in reversed(list(enumerate(schema.variants[kind])))}
        return lambda v: numbers[v[0]] + writer(schema, v[0])(v[1])
    if kind in schema.aliases:
        return lambda v: writer(schema, schema.aliases[kind])(v)
    return WRITERS[kind]


def encode(schema: Schema, kind: str, value: Any) -> bytes:
    """A value of a type of ``schema`` in its binary form; decoding it gives the value's readable form."""
    return writer(schema, kind)(value)


def wire(kind: str, value: Any) -> bytes:
    """A value of one of the feed's own types."""
    return encode(WIRE, kind, value)


def packed_schema(spec: dict) -> bytes:
    """A schema in the packed form of a chain's account rows; sections that it lacks are empty."""
    filled = {"version": ""} | {k: spec.get(k) or [] for k in (*SECTIONS[1:], "clauses", "messages", "extensions")} | ({"version": spec["version"]} if "version" in spec else {})
    return encode(PACKED, "schema_def", filled)
