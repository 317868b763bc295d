import json

import pytest

from ledgerlake.operators import ingest, state
from ledgerlake import samples as blobs
from ledgerlake.codec import pack


def feed(spark, frames):
    return ingest.raw_from_frames(spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(frames)], "arrival_ordinal long, frame binary"))


def whole_block(num=42, slot=1000):
    moves = [blobs.action_trace(k + 1, 0, r, "coin.vault", "transfer", blobs.transfer("ada", "ben", 10000, "rent"), 5150 + k) for k, r in enumerate(("coin.vault", "ada", "ben"))]
    failed = blobs.transaction([blobs.action_trace(1, 0, "x", "x", "y", b"", 900, "cc")], "ff", status=1)
    rows = [
        blobs.delta("account", [(True, blobs.account_row("other", blobs.packed_abi(blobs.TOKEN_ABI))), (True, b"\7")]),
        blobs.delta("permission", [(True, blobs.permission_row("ben", "active", accounts=[("cleo", "active")]))]),
        blobs.delta("contract_row", [(True, b"\7"), (True, blobs.contract_row("coin.vault", "ada", "accounts", 5, blobs.asset(712500))), (False, blobs.contract_row("unknown", "z", "t", 2**64 - 1, b"\1\2"))]),
        blobs.delta("ignored", [(True, b"")]),
    ]
    return blobs.frame(num, blobs.signed_block(slot), [blobs.transaction(moves), failed], rows)


@pytest.fixture(scope="module")
def tables(spark):
    fallback = spark.createDataFrame([("coin.vault", json.dumps(blobs.TOKEN_ABI))], "account string, abi string")
    return {k: [r.asDict(True) for r in v.collect()] for k, v in ingest.block_tables(feed(spark, [whole_block()]), fallback).items()}


def test_action(tables):
    (a,) = tables["action"]
    assert (a["global_sequence"], a["block_num"], a["@timestamp"], a["producer"]) == (5150, 42, "2000-01-01T00:08:20.000", "millstone")
    assert a["notified"] == ["coin.vault", "ada", "ben"] and [r["global_sequence"] for r in a["receipts"]] == [5150, 5151, 5152]
    assert json.loads(a["act"]["data"]) == {"from": "ada", "to": "ben", "quantity": "1.0000 ORE", "memo": "rent"} and a["act"]["hex_data"] is None
    assert a["@transfer"] == {"from": "ada", "to": "ben", "amount": 1.0, "symbol": "ORE", "memo": "rent"} and a["@newaccount"] is None
    assert a["signatures"][0].startswith("SIG_K1_") and a["trx_id"] == "5e" * 32 and a["act"]["authorization"] == [{"actor": "ada", "permission": "active"}]


def test_block_and_state(tables):
    (b,) = tables["block"]
    assert (b["block_num"], b["trx_count"], b["cpu_usage_us"], b["net_usage_words"], b["schedule_version"]) == (42, 1, 410, 23, 3)
    first, second = sorted(tables["delta"], key=lambda r: r["ordinal"])
    assert (first["ordinal"], json.loads(first["data"]), first["value_hex"]) == (0, {"balance": "71.2500 ORE"}, None)
    assert (second["ordinal"], second["data"], second["value_hex"], second["primary_key"], second["present"]) == (1, None, "0102", str(2**64 - 1), False)
    (t,) = tables["token"]
    assert (t["scope"], t["symbol"], t["precision"], t["amount"], t["_op"]) == ("ada", "ORE", 4, 71.25, "index")
    (p,) = tables["perm"]
    assert (p["owner"], p["name"], p["accounts"], len(p["keys"]), p["last_updated"]) == ("ben", "active", ["cleo@active"], 1, "1970-01-02T00:00:00.250")
    (x,) = tables["abi"]
    assert (x["account"], x["actions"], x["tables"]) == ("other", ["transfer"], ["accounts"])


def test_schema_in_force(spark):
    """A schema set by an action counts for later actions; empty bytes remove it, also against the fallback."""
    move = lambda seq, d: blobs.action_trace(1, 0, "tok", "tok", "transfer", blobs.transfer("a", "b", 1, ""), seq, d)
    code = lambda seq, d, abi: blobs.action_trace(1, 0, "eosio", "eosio", "setabi", pack.name("tok") + pack.block(abi), seq, d)
    packed = blobs.packed_abi(blobs.TOKEN_ABI)
    one = blobs.transaction([move(1, "01"), code(2, "02", packed), move(3, "03"), code(4, "04", b""), move(5, "05")])
    two = blobs.frame(2, None, [blobs.transaction([move(6, "06")])], [blobs.delta("account", [(True, blobs.account_row("tok", packed)), (False, blobs.account_row("tok", b""))])])
    three = blobs.frame(3, b"bad header", [blobs.transaction([move(7, "07")])], [])
    found = ingest.block_tables(feed(spark, [blobs.frame(1, None, [one], []), two, three]))["action"].collect()
    decoded = {int(r.global_sequence): r.act.data is not None for r in found if r.act.name == "transfer"}
    assert decoded == {1: False, 3: True, 5: False, 6: False, 7: True} and {r["@timestamp"] for r in found} == {None}


def test_skip_and_primary(spark):
    traces = [blobs.action_trace(1, 0, "ben", "c", "act", b"", 1), blobs.action_trace(2, 0, "c", "c", "act", b"", 2), blobs.action_trace(3, 0, "c", "c", "noisy", b"", 3, "ab"), blobs.action_trace(4, 0, "c", "c", "plain", b"", None, "4d")]
    raw = feed(spark, [blobs.frame(1, blobs.signed_block(1), [blobs.transaction(traces, signed=False)], [])])
    (r,) = ingest.collapse(ingest.traces(raw), ["c::noisy"]).collect()
    assert (int(r.global_sequence), r.notified) == (2, ["ben", "c"])


def test_collapse_in_place(spark):
    """Grouping where blocks are decoded gives what the aggregation over traces gives."""
    raw = feed(spark, [whole_block(40 + k, 1000 + k) for k in range(3)])
    made, found = ingest.collapsed(raw), ingest.collapse(ingest.traces(raw))
    assert made.count() == 3 and sorted(map(repr, made.collect())) == sorted(map(repr, found.select(made.columns).collect()))


def test_latest_over_arrivals(spark):
    row = lambda present, amount: blobs.delta("contract_row", [(present, blobs.contract_row("tok", "al", "accounts", 1, blobs.asset(amount)))])
    code = blobs.delta("account", [(True, blobs.account_row("tok", blobs.packed_abi(blobs.TOKEN_ABI)))])
    frames = [blobs.frame(5, None, [], [code, row(True, 10000)]), blobs.frame(6, None, [], [row(True, 20000)]), blobs.frame(5, None, [], [row(True, 30000)])]
    changes = ingest.block_tables(feed(spark, frames))["token"]
    assert [r.amount for r in state.latest(changes, ingest.KEYS["token"]).collect()] == [3.0]
    gone = ingest.block_tables(feed(spark, [*frames, blobs.frame(7, None, [], [row(False, 30000)])]))["token"]
    assert state.latest(gone, ingest.KEYS["token"]).count() == 0


def test_partitioning_does_not_matter(spark):
    raw = feed(spark, [whole_block(40 + k, 1000 + k) for k in range(6)])
    digest = lambda df: sorted(map(repr, df.drop("_version").collect()))
    one, many = ingest.block_tables(raw.coalesce(1)), ingest.block_tables(raw.repartition(5))
    for kind in one:
        assert digest(one[kind]) == digest(many[kind]), kind
