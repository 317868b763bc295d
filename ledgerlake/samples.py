"""Small made-up feeds for queries, benchmarks and tests: values of our own, encoded by the schemas."""

from __future__ import annotations

from .codec import pack
from .codec.pack import encode, integer, packed_schema, wire
from .codec.schema import Schema

COIN = "4,ORE"
_fields = lambda **kinds: [{"name": k.rstrip("_"), "type": v} for k, v in kinds.items()]
#: A token contract, with the actions and tables by which tokens are known.
TOKEN_ABI = {
    "version": "ledgerlake/1.0", "types": [], "variants": [],
    "structs": [{"name": "transfer", "base": "", "fields": _fields(from_="name", to="name", quantity="asset", memo="string")}, {"name": "account", "base": "", "fields": _fields(balance="asset")}],
    "actions": [{"name": "transfer", "type": "transfer", "ricardian_contract": ""}],
    "tables": [{"name": "accounts", "index_type": "i64", "key_names": [], "key_types": [], "type": "account"}],
}
TOKEN = Schema(TOKEN_ABI)
PUBLIC_KEY = bytes([0, 3, *range(32)])
SIGNATURE = bytes([0, 31, *range(64)])
CPU_US, NET_WORDS, SCHEDULE = 410, 23, 3


def u(size: int, value: int) -> bytes:
    return integer(size)(value)


def asset(units: int, symbol: str = COIN) -> bytes:
    return pack.asset(units, symbol)


def transfer(sender: str, to: str, units: int, memo: str) -> bytes:
    return encode(TOKEN, "transfer", {"from": sender, "to": to, "quantity": (units, COIN), "memo": memo})


def packed_abi(spec: dict) -> bytes:
    return packed_schema(spec)


def action_trace(ordinal: int, creator: int, receiver: str, account: str, act: str, data: bytes, sequence: int | None, digest: str = "3c", version: int = 1) -> list:
    receipt = sequence if sequence is None else ["receipt_v0", {"receiver": receiver, "act_digest": digest * 32, "global_sequence": sequence, "recv_sequence": sequence // 2, "auth_sequence": [{"account": "ada", "sequence": sequence // 3}], "code_sequence": 4, "abi_sequence": 6}]
    call = {"account": account, "name": act, "authorization": [{"actor": "ada", "permission": "active"}], "data": data}
    return [f"action_v{version}", {"action_ordinal": ordinal, "creator_action_ordinal": creator, "receipt": receipt, "receiver": receiver, "act": call, "context_free": False, "elapsed": 17, "console": "", "ram_deltas": [], "return_value": b""}]


def transaction(actions: list, trx_id: str = "5e", status: int = 0, signed: bool = True) -> list:
    part = {"expiration": 60, "ref_block_num": 11, "ref_block_prefix": 13, "max_net_usage_words": 0, "max_cpu_usage_ms": 0, "delay_sec": 0, "extensions": [], "signatures": [SIGNATURE], "context_free_data": []}
    return ["trace_v0", {"id": trx_id * 32, "status": status, "cpu_usage_us": CPU_US, "net_usage_words": NET_WORDS, "elapsed": 900, "net_usage": 8 * NET_WORDS, "scheduled": False, "action_traces": actions, "partial": ["partial_v0", part] if signed else None}]


def signed_block(slot: int, producer: str = "millstone", receipts: int = 1, cpu_us: int = CPU_US, net_words: int = NET_WORDS) -> bytes:
    done = {"status": 0, "cpu_usage_us": cpu_us, "net_usage_words": net_words, "trx": ["checksum256", "5e" * 32]}
    roots = {"previous": "1d" * 32, "transaction_mroot": "2d" * 32, "action_mroot": "3d" * 32}
    return wire("signed_block", roots | {"slot": slot, "producer": producer, "confirmed": 0, "schedule_version": SCHEDULE, "extensions": [], "producer_signature": SIGNATURE, "receipts": [done] * receipts})


def delta(kind: str, rows: list[tuple[bool, bytes]]) -> list:
    return ["delta_v0", {"name": kind, "rows": [{"present": present, "data": data} for present, data in rows]}]


def contract_row(code: str, scope: str, table: str, key: int, value: bytes) -> bytes:
    return wire("contract_row", ["contract_row_v0", {"code": code, "scope": scope, "table": table, "primary_key": key, "payer": scope, "value": value}])


def account_row(account: str, abi: bytes) -> bytes:
    return wire("account", ["account_v0", {"name": account, "creation_date": 7, "abi": abi}])


def permission_row(owner: str, permission: str, keys: int = 1, accounts: list[tuple[str, str]] | None = None) -> bytes:
    weights = {"keys": [{"key": PUBLIC_KEY, "weight": 1}] * keys, "accounts": [{"actor": x, "permission": p, "weight": 1} for x, p in accounts or []], "waits": []}
    return wire("permission", ["permission_v0", weights | {"owner": owner, "name": permission, "parent": "owner", "last_updated": 86_400_250_000, "threshold": 1}])


def place(num: int, byte: str) -> dict:
    return {"block_num": num, "block_id": byte * 32}


def position(num: int, byte: str) -> bytes:
    return wire("position", place(num, byte))


def frame(num: int, signed: bytes | None, traces: list, deltas: list) -> bytes:
    """A feed's answer with one block, nine below the head."""
    blobs = {"block": signed, "traces": wire("transaction_trace[]", traces), "deltas": wire("table_delta[]", deltas)}
    return wire("result", ["blocks_v0", blobs | {"head": place(num + 9, "4a"), "lib": place(num - 1, "4b"), "this_block": place(num, "4c"), "prev_block": place(num - 1, "4d")}])


