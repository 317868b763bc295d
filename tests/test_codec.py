import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.codec import keys, scalars, schema, wire
from ledgerlake.codec.cursor import Cursor, DecodeError, varuint32
from ledgerlake import samples as blobs
from ledgerlake.codec import pack


@pytest.mark.parametrize("text,value", [("eosio", 6138663577826885632), ("eosio.token", 6138663591592764928), ("transfer", 14829575313431724032), ("", 0)])
def test_names(text, value):
    assert scalars.name_value(text) == value and scalars.name_text(value) == text


@pytest.mark.parametrize("text", ["EOSIO", "a" * 14, "z" * 13, "a b", "é"])
def test_no_names(text):
    assert scalars.name_value(text) is None


@given(st.integers(0, 2**64 - 1))
def test_any_number_is_a_name(value):
    assert scalars.name_value(scalars.name_text(value)) == value


@given(st.integers(0, 2**32 - 1))
def test_varuint32(value):
    assert Cursor(varuint32(value)).varuint32() == value


def test_varint32():
    assert [Cursor(varuint32(x)).varint32() for x in range(4)] == [0, -1, 1, -2]
    for bad in (b"", b"\xff" * 5 + b"\x01", b"\xff\xff\xff\xff\x7f"):
        with pytest.raises(DecodeError):
            Cursor(bad).varuint32()


def test_assets():
    eos = scalars.symbol_value("4,EOS")
    assert eos == 1397703940 and scalars.symbol_text(eos) == "4,EOS"
    assert [scalars.Asset(*x).text() for x in ((10000, eos), (-5, eos), (42, scalars.symbol_value("0,SYS")))] == ["1.0000 EOS", "-0.0005 EOS", "42 SYS"]
    assert scalars.Asset(42, scalars.symbol_code_value("BAD") << 8 | 250).text() == "42 BAD"
    assert scalars.parse_asset("1.0000 EOS") == (10000, eos) and scalars.parse_asset("-0.5 WAX").amount == -5
    assert [scalars.parse_asset(x) for x in ("garbage", "1.0 lowercase", "1." + "0" * 19 + " X")] == [None] * 3


@given(st.integers(-(2**63) + 1, 2**63 - 1), st.integers(0, 18))
def test_assets_round_trip(amount, precision):
    symbol = scalars.symbol_code_value("ABC") << 8 | precision
    assert scalars.parse_asset(scalars.Asset(amount, symbol).text()) == (amount, symbol)


def test_times():
    assert scalars.time_text(scalars.slot_ms(1000) * 1000) == "2000-01-01T00:08:20.000"
    assert scalars.time_text(1_500_000) == "1970-01-01T00:00:01.500" and scalars.time_text(2**63 - 1) == "1970-01-01T00:00:00.000"


def test_keys():
    zero = "PUB_K1_11111111111111111111111111111111149Mr2R"
    assert keys.public_key(Cursor(bytes(34))) == zero
    assert keys.normal_key("EOS1111111111111111111111111111111114T1Anm") == zero == keys.normal_key(zero)
    assert keys.normal_key("EOS1111111111111111111111111111111114T1Anx").startswith("EOS")
    sizes = {1: 33, 3: 1312, 4: 1952, 5: 2592}
    assert [keys.public_key(Cursor(bytes([t]) + bytes(n))).split("_")[1] for t, n in sizes.items()] == ["R1", "MLDSA44", "MLDSA65", "MLDSA87"]
    assert keys.signature(Cursor(b"\2" + bytes(65) + pack.block(b"xy") + pack.block("{}"))).startswith("SIG_WA_")
    for bad in (b"\6" + bytes(40), b"\0" + bytes(32)):
        with pytest.raises(DecodeError):
            keys.public_key(Cursor(bad))


@given(st.binary(max_size=60))
def test_base58(data):
    assert keys.from_base58(keys.base58(data)) == data


def test_decoder():
    s = schema.Schema(blobs.TOKEN_ABI)
    assert s.decode_named("actions", "transfer", blobs.transfer("ada", "ben", 10000, "rent") + b"rest") == {"from": "ada", "to": "ben", "quantity": "1.0000 ORE", "memo": "rent"}
    assert s.decode_named("tables", "accounts", blobs.asset(712500)) == {"balance": "71.2500 ORE"}
    for section, name, data in (("actions", "none", b""), ("actions", "transfer", b"\0")):
        with pytest.raises(DecodeError):
            s.decode_named(section, name, data)


def test_type_forms():
    fields = [("list", "uint32[]"), ("maybe", "string?"), ("choice", "either$")]
    spec = {"types": [{"new_type_name": "account_name", "type": "name"}], "variants": [{"name": "either", "types": ["uint8", "account_name"]}]}
    spec["structs"] = [{"name": "base", "base": "", "fields": [{"name": "id", "type": "uint64"}]}, {"name": "holder", "base": "base", "fields": [{"name": n, "type": t} for n, t in fields]}]
    s = schema.Schema(spec)
    head = blobs.u(8, 2**64 - 1) + pack.encode(s, "uint32[]", [1, 2])
    assert s.decode("holder", head + b"\0") == {"id": 2**64 - 1, "list": [1, 2], "maybe": None, "choice": None}
    assert s.decode("holder", head + b"\1" + pack.block("x") + b"\1" + pack.name("ben")) == {"id": 2**64 - 1, "list": [1, 2], "maybe": "x", "choice": ["account_name", "ben"]}
    for kind, data in (("nothing", b""), ("either", b"\2")):
        with pytest.raises(DecodeError):
            s.decode(kind, data)
    assert s.decode("int128", b"\xff" * 16) == "-1" and s.decode("float64", struct.pack("<d", float("inf"))) is None
    loop = schema.Schema({"types": [{"new_type_name": "a", "type": "a"}]})
    with pytest.raises(DecodeError):
        loop.decode("a", b"")


def test_packed_schema():
    found = schema.unpacked_schema(blobs.packed_abi(blobs.TOKEN_ABI))
    assert found == blobs.TOKEN_ABI and json.loads(schema.to_json(found)) == found
    assert schema.unpacked_schema(b"\xff") is None


def test_wire():
    trx = blobs.transaction([blobs.action_trace(1, 0, "ben", "coin.vault", "transfer", b"x", 5150), blobs.action_trace(2, 1, "ben", "a", "b", b"", None, version=0)])
    kind, r = wire.result(blobs.frame(42, blobs.signed_block(1000, receipts=2), [trx], [blobs.delta("contract_row", [(True, blobs.contract_row("c", "s", "t", 5, b"v"))])]))
    assert kind == "blocks" and r["this_block"] == {"block_num": 42, "block_id": "4c" * 32} and r["prev_block"]["block_num"] == 41
    (trace,) = wire.traces(r["traces"])
    assert trace["id"] == "5e" * 32 and len(wire.signatures(trace)) == 1 and trace["action_traces"][0][1]["receipt"][1]["global_sequence"] == 5150
    (d,) = wire.deltas(r["deltas"])
    assert wire.row("contract_row", d["rows"][0]["data"]) == {"code": "c", "scope": "s", "table": "t", "primary_key": 5, "payer": "s", "value": b"v"}
    h = wire.header(r["block"])
    assert (h["trx_count"], h["cpu_usage_us"], h["net_usage_words"], h["producer"]) == (2, 820, 46, "millstone")
    assert wire.row("permission", b"\1") is None and wire.status_name(3) == "delayed" and wire.status_name(9) == "unknown"
    with pytest.raises(DecodeError):
        wire.result(b"\2")
    assert wire.blocks_request(1, 2, 3).hex() == "01" + "01000000" + "02000000" + "03000000" + "00" + "00010101"
    assert wire.ack_request(1).hex() == "0201000000" and wire.status_request() == b"\0"
    status = varuint32(0) + blobs.position(100, "aa") + blobs.position(90, "bb") + b"".join(blobs.u(4, x) for x in (0, 101, 0, 101))
    assert wire.result(status)[1]["chain_id"] is None and wire.result(status + bytes(32))[1]["chain_id"] == "00" * 32


@settings(max_examples=30)
@given(st.binary(max_size=200))
def test_garbage_is_an_error(data):
    for read in (wire.traces, wire.deltas, wire.header):
        try:
            read(data)
        except DecodeError:
            pass
