"""Blocks to tables.

A raw block is a row (arrival_ordinal, block_num, block_id, lib_num, block, traces,
deltas; the last three binary). ``block_tables`` turns a frame of them into the seven
tables:

1. the three blobs are decoded in Arrow batches, each block by itself, to flat rows;
2. traces collapse to actions per (block, transaction, digest), in the same batches;
3. schema changes, from system actions and account rows, form a timeline per account, and
   each action and table row is decoded by the schema in force at its position, in one
   sorted merge of both (``decoding.decode_in_force``), only for rows that survived the filters.

Positions order everything in a block as the feed does: transactions by index, groups of
traces by first appearance, then deltas; a schema set by an action counts for its own data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import scalars, wire
from ..codec.cursor import Cursor, DecodeError
from ..functions import columns, decoding
from ..plans.filters import is_skipped
from . import state

SYSTEM_ACCOUNT = "eosio"
RAW = "arrival_ordinal long, block_num long, block_id string, prev_id string, head_num long, lib_num long, block binary, traces binary, deltas binary"
#: Positions within a block: transactions first, then deltas.
TRACE_PHASE, DELTA_PHASE = 0, 1

HEADER = "timestamp string, producer string, prev_id string, schedule_version long, trx_count long, cpu_usage_us long, net_usage_words long"
TRACE = """trx_idx long, trace_idx long, trx_id string, status int, cpu_usage_us long, net_usage_words long, signatures array<string>,
  receiver string, account string, name string, authorization array<struct<actor: string, permission: string>>, data binary,
  act_digest string, global_sequence decimal(20,0), recv_sequence decimal(20,0), auth_sequence array<struct<account: string, sequence: decimal(20,0)>>, code_sequence long, abi_sequence long,
  action_ordinal long, creator_action_ordinal long"""
ACTION = """trx_idx long, act_digest string, first_idx long, trx_id string, cpu_usage_us long, net_usage_words long, signatures array<string>,
  account string, name string, authorization array<struct<actor: string, permission: string>>, data binary, global_sequence decimal(20,0), code_sequence long, abi_sequence long,
  action_ordinal long, creator_action_ordinal long, notified array<string>,
  receipts array<struct<receiver: string, global_sequence: decimal(20,0), recv_sequence: decimal(20,0), auth_sequence: array<struct<account: string, sequence: decimal(20,0)>>>>"""
DELTA = """delta_idx long, row_idx long, kind string, present boolean, data binary, ordinal long,
  contract struct<code: string, scope: string, table: string, primary_key: string, payer: string, value: binary>"""
#: Blobs whose rows are Python objects at a time.
STEP = 128
KEEP = ["arrival_ordinal", "block_num", "block_id"]


def _rows_of(column: str, rows_of, ddl: str):
    """The decoded rows of a blob, as an array; none of a null."""

    @F.arrow_udf(f"array<struct<{ddl_fields(ddl)}>>")
    def run(blobs: pa.Array) -> pa.Array:
        # few blobs at a time: many rows held as objects keep Python's garbage collector busy
        parts = [blobs.slice(k, STEP).to_pylist() for k in range(0, len(blobs), STEP)]
        made = [pa.array([rows_of(x) if x is not None else [] for x in part], type=target) for part in parts]
        return pa.concat_arrays(made) if made else pa.array([], type=target)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, StructType

    target = to_arrow_type(ArrayType(StructType.fromDDL(ddl)))
    return run(F.col(column))


def _exploded(raw: DataFrame, column: str, rows_of, ddl: str) -> DataFrame:
    """Each raw block with an array of decoded rows, exploded."""
    return raw.where(F.col("block_num").isNotNull()).select(*KEEP, F.explode(_rows_of(column, rows_of, ddl)).alias("r")).select(*KEEP, "r.*")


def ddl_fields(ddl: str) -> str:
    """Top-level fields of a column list in the form of a struct's."""
    out, depth, name = [], 0, True
    for part in ddl.replace("\n", " ").split():
        out.append(part + (":" if name else ""))
        depth += part.count("<") - part.count(">") + part.count("(") - part.count(")")
        name = depth == 0 and part.endswith(",")
    return " ".join(out)


def _trace_rows(blob: bytes) -> list[dict]:
    from decimal import Decimal

    rows = []
    for t, trx in enumerate(wire.traces(blob)):
        signed = wire.signatures(trx)
        for k, (_, a) in enumerate(trx["action_traces"]):
            receipt = a["receipt"][1] if a["receipt"] else {}
            act = a["act"]
            big = lambda x: None if x is None else Decimal(x)
            rows.append(
                {
                    "trx_idx": t, "trace_idx": k, "trx_id": trx["id"], "status": trx["status"], "cpu_usage_us": trx["cpu_usage_us"], "net_usage_words": trx["net_usage_words"], "signatures": signed,
                    "receiver": a["receiver"], "account": act["account"], "name": act["name"], "authorization": act["authorization"], "data": act["data"],
                    "act_digest": receipt.get("act_digest"), "global_sequence": big(receipt.get("global_sequence")), "recv_sequence": big(receipt.get("recv_sequence")),
                    "auth_sequence": [{"account": s["account"], "sequence": Decimal(s["sequence"])} for s in receipt.get("auth_sequence", [])], "code_sequence": receipt.get("code_sequence"), "abi_sequence": receipt.get("abi_sequence"),
                    "action_ordinal": a["action_ordinal"], "creator_action_ordinal": a["creator_action_ordinal"],
                }
            )
    return rows


def traces(raw: DataFrame) -> DataFrame:
    """One row per action trace of every transaction; a blob that does not decode is an error."""
    return _exploded(raw, "traces", _trace_rows, TRACE)


#: Fields of a receipt, and of a trace that its group's action does not have.
RECEIPT_FIELDS = ("receiver", "global_sequence", "recv_sequence", "auth_sequence")
OF_TRACE = {"receiver", "recv_sequence", "auth_sequence", "status", "trace_idx"}


def _action_rows(blob: bytes) -> list[dict]:
    members: dict[tuple[int, str], list[dict]] = {}
    for r in _trace_rows(blob):
        if r["status"] == 0 and r["act_digest"] is not None:
            members.setdefault((r["trx_idx"], r["act_digest"]), []).append(r)
    rows = []
    for found in members.values():
        primary = next((r for r in found if r["receiver"] == r["account"]), found[0])
        row = {k: v for k, v in primary.items() if k not in OF_TRACE}
        rows.append(row | {"first_idx": found[0]["trace_idx"], "notified": [r["receiver"] for r in found], "receipts": [{k: r[k] for k in RECEIPT_FIELDS} for r in found]})
    return rows


def collapsed(raw: DataFrame, skip_actions: list[str] | None = None) -> DataFrame:
    """The actions of ``collapse(traces(raw))``, grouped where a block is decoded, as a block holds all traces of its transactions: no shuffle."""
    return _exploded(raw, "traces", _action_rows, ACTION).where(~is_skipped(skip_actions or [], "account", "name"))


def _delta_rows(blob: bytes) -> list[dict]:
    rows, decoded = [], 0
    for d, changed in enumerate(wire.deltas(blob)):
        kind = changed["name"]
        for k, r in enumerate(changed["rows"]):
            row = {"delta_idx": d, "row_idx": k, "kind": kind, "present": r["present"]}
            found = wire.row("contract_row", r["data"]) if kind == "contract_row" else None
            if found:
                found["primary_key"] = str(found["primary_key"])
                row |= {"contract": found, "ordinal": decoded}
                decoded += 1
            else:
                row["data"] = r["data"]
            rows.append(row)
    return rows


def deltas(raw: DataFrame) -> DataFrame:
    """One row per changed row of every state table; a blob that does not decode is an error.

    A contract's row comes as its fields in ``contract``, instead of bytes in ``data``,
    with its ordinal: the count, in its block, of such rows that decoded before.
    """
    return _exploded(raw, "deltas", _delta_rows, DELTA)


def _header_row(blob: bytes) -> list[dict]:
    try:
        h = wire.header(blob)
    except DecodeError:
        return [None]
    names = ("producer", "schedule_version", "trx_count", "cpu_usage_us", "net_usage_words")
    return [{"timestamp": scalars.time_text(scalars.slot_ms(h["slot"]) * 1000), "prev_id": h["previous"], **{k: h[k] for k in names}}]


def headers(raw: DataFrame) -> DataFrame:
    """One row per block with a header; null header columns where it does not decode."""
    return _exploded(raw, "block", _header_row, HEADER)


def collapse(found: DataFrame, skip_actions: list[str] | None = None) -> DataFrame:
    """Traces of one digest in a transaction as one action, the primary's, with all receivers and receipts in order.

    Only executed transactions and traces with receipt count. The primary is the first
    trace whose receiver is the action's own account, else the first. ``skip_actions``
    (``contract::action``) drop actions after grouping, by their primary.
    """
    kept = found.where((F.col("status") == 0) & F.col("act_digest").isNotNull())
    members = F.array_sort(F.collect_list(F.struct("trace_idx", "receiver", "global_sequence", "recv_sequence", "auth_sequence")))
    whole = F.struct(*[c for c in kept.columns if c not in ("arrival_ordinal", "trx_idx", "act_digest")])
    primary = F.min_by(whole, F.struct((F.col("receiver") != F.col("account")).alias("other"), F.col("trace_idx")))
    grouped = kept.groupBy("arrival_ordinal", "trx_idx", "act_digest").agg(F.min("trace_idx").alias("first_idx"), primary.alias("p"), members.alias("m"))
    receipts = F.transform("m", lambda x: F.struct(x["receiver"].alias("receiver"), x["global_sequence"].alias("global_sequence"), x["recv_sequence"].alias("recv_sequence"), x["auth_sequence"].alias("auth_sequence")))
    actions = grouped.select("arrival_ordinal", "trx_idx", "act_digest", "first_idx", "p.*", F.col("m.receiver").alias("notified"), receipts.alias("receipts"))
    return actions.where(~is_skipped(skip_actions or [], "account", "name"))


def _position(phase: int, a: str, b: str):
    """A sortable place in the feed."""
    return F.struct(F.col("arrival_ordinal").alias("block"), F.lit(phase).alias("phase"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))


def schema_timeline(actions: DataFrame, changed: DataFrame) -> DataFrame:
    """(account, position, abi): every change of a schema, null where it was removed or does not parse.

    An account row without schema, deleted or not parsing is no change; a system action
    with empty bytes is.
    """
    parsed = pa.struct([("account", pa.string()), ("packed", pa.binary())])

    @F.arrow_udf("account string, packed binary")
    def set_code(found: pa.Array) -> pa.Array:
        out = []
        for data in found.to_pylist():
            c = Cursor(data)
            try:
                out.append({"account": scalars.name_text(c.unsigned(8)), "packed": c.block()})
            except DecodeError:
                out.append(None)
        return pa.array(out, type=parsed)

    system = actions.where((F.col("account") == SYSTEM_ACCOUNT) & (F.col("name") == "setabi"))
    system = system.select(set_code("data").alias("s"), _position(TRACE_PHASE, "trx_idx", "first_idx").alias("position")).where("s IS NOT NULL")
    system = system.select("s.account", "position", decoding.unpack_schema(F.col("s.packed")).alias("abi"))
    rows = account_rows(changed).select("account", "position", "abi")
    return system.unionByName(rows)


def account_rows(changed: DataFrame) -> DataFrame:
    """Account rows that carry a schema."""
    kind = pa.struct([("account", pa.string()), ("packed", pa.binary())])

    @F.arrow_udf("account string, packed binary")
    def parsed(found: pa.Array) -> pa.Array:
        rows = (wire.row("account", d) for d in found.to_pylist())
        return pa.array([{"account": r["name"], "packed": r["abi"]} if r and r["abi"] else None for r in rows], type=kind)

    of = [f"`{c}`" for c in changed.columns if c in ("@timestamp", "arrival_ordinal", "block_num", "delta_idx", "row_idx")]
    found = changed.where("kind = 'account' AND present").select(*of, _position(DELTA_PHASE, "delta_idx", "row_idx").alias("position"), parsed("data").alias("r")).where("r IS NOT NULL")
    return found.select(*of, "position", "r.account", decoding.unpack_schema(F.col("r.packed")).alias("abi")).where("abi IS NOT NULL")


def permission_rows(changed: DataFrame) -> DataFrame:
    kind = pa.struct([("owner", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("last_updated", pa.string()), ("threshold", pa.int64()), ("keys", pa.list_(pa.string())), ("accounts", pa.list_(pa.string()))])

    @F.arrow_udf("owner string, name string, parent string, last_updated string, threshold long, keys array<string>, accounts array<string>")
    def parsed(found: pa.Array) -> pa.Array:
        out = []
        for d in found.to_pylist():
            r = wire.row("permission", d)
            out.append(r and {k: r[k] for k in ("owner", "name", "parent", "last_updated", "threshold")} | {"keys": [k["key"] for k in r["keys"]], "accounts": [f"{a['actor']}@{a['permission']}" for a in r["accounts"]]})
        return pa.array(out, type=kind)

    found = changed.where("kind = 'permission'").select("arrival_ordinal", "block_num", "delta_idx", "row_idx", "present", parsed("data").alias("r")).where("r IS NOT NULL")
    return found.select("arrival_ordinal", "block_num", "delta_idx", "row_idx", "r.*", F.when(F.col("present"), F.lit("index")).otherwise(F.lit("delete")).alias("_op"))


def contract_rows(changed: DataFrame) -> DataFrame:
    """Changed rows of contracts that decoded, with their ordinal."""
    kept = [c for c in changed.columns if c not in ("kind", "data", "contract")]
    return changed.where("contract IS NOT NULL").select(*kept, _position(DELTA_PHASE, "delta_idx", "row_idx").alias("position"), "contract.*")


def typed_extracts(actions: DataFrame, data: str = "data_json", name: str = "name") -> DataFrame:
    """``@transfer`` and ``@newaccount`` from the decoded data of actions so named, on any contract."""
    fields = "from string, to string, quantity string, memo string, newact string, name string, creator string"
    # steps of their own, as the text is parsed once and the asset as well
    found = actions.withColumn("_d", F.when(F.col(name).isin("transfer", "newaccount"), F.from_json(data, fields)))
    found = found.withColumn("_q", F.when(F.col(name) == "transfer", columns.parse_asset(F.col("_d.quantity"))))
    transfer = F.struct("_d.from", "_d.to", columns.asset_number(F.col("_q.amount"), F.col("_q.precision")).alias("amount"), F.col("_q.code").alias("symbol"), "_d.memo")
    created = F.coalesce("_d.newact", "_d.name")
    account = F.struct(created.alias("newact"), "_d.creator")
    out = found.withColumn("@transfer", F.when((F.col(name) == "transfer") & F.col("_d.from").isNotNull() & F.col("_d.to").isNotNull(), transfer))
    return out.withColumn("@newaccount", F.when((F.col(name) == "newaccount") & created.isNotNull(), account)).drop("_d", "_q")


def balances(rows: DataFrame, data: str = "data_json") -> DataFrame:
    """Token changes from rows of tables named accounts whose balance is an asset."""
    asset = columns.parse_asset(F.get_json_object(data, "$.balance"))
    found = rows.where("table = 'accounts'").withColumn("_a", asset).where("_a IS NOT NULL")
    number = columns.asset_number(F.col("_a.amount"), F.col("_a.precision"))
    return found.select("arrival_ordinal", "delta_idx", "row_idx", "block_num", "code", "scope", F.col("_a.code").alias("symbol"), F.col("_a.precision").alias("precision"), number.alias("amount"), F.when(F.col("present"), F.lit("index")).otherwise(F.lit("delete")).alias("_op"))


def decoded(raw: DataFrame) -> DataFrame:
    """Raw blocks with their three blobs as arrays of rows ``header``, ``actions`` and ``changes``, in one pass; what is not used later is not decoded."""
    of = [_rows_of("block", _header_row, HEADER).alias("header"), _rows_of("traces", _action_rows, ACTION).alias("actions"), _rows_of("deltas", _delta_rows, DELTA).alias("changes")]
    return raw.where(F.col("block_num").isNotNull()).select(*KEEP, *of)


def block_tables(raw: DataFrame, fallback: DataFrame | None = None, skip_actions: list[str] | None = None, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The tables action, block, delta, abi, perm and token of a frame of raw blocks.

    perm and token are change logs with ``_op`` and ``_version``; ``state.latest`` makes
    the current tables of them. ``hold`` is applied to the decoded frames, which all
    tables share: a writer of several tables passes ``DataFrame.persist``. ``fallback`` (account, abi) has schemas for contracts
    without any in the feed so far.
    """
    return tables_of(hold(decoded(raw)), fallback, skip_actions, hold)


def tables_of(blocks: DataFrame, fallback: DataFrame | None = None, skip_actions: list[str] | None = None, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The tables of ``block_tables``, of decoded blocks. A table reads these several times: who keeps them decodes once."""
    def listed_rows(rows: str, *more: str) -> DataFrame:
        of_block = {"@timestamp": F.get("header", F.lit(0))["timestamp"], "producer": F.get("header", F.lit(0))["producer"]}
        return blocks.select(*KEEP, *[of_block[m].alias(m) for m in more], F.explode(rows).alias("r")).select(*KEEP, *[f"`{m}`" for m in more], "r.*")

    header = listed_rows("header")
    actions, changed = listed_rows("actions", "@timestamp", "producer").where(~is_skipped(skip_actions or [], "account", "name")), listed_rows("changes", "@timestamp")
    timeline = schema_timeline(actions, changed)
    probes = actions.withColumn("position", _position(TRACE_PHASE, "trx_idx", "first_idx"))
    found = decoding.decode_in_force(probes, timeline, "actions", "account", "position", F.col("position.block"), "name", "data", fallback)
    action = typed_extracts(found.withColumn("data_json", F.when(F.length("data") == 0, F.lit("{}")).otherwise(F.col("data_json"))))
    act = F.struct("account", "name", "authorization", F.col("data_json").alias("data"), F.when(F.col("data_json").isNull(), columns.hex_text(F.col("data"))).alias("hex_data"))
    signed = F.when((F.col("creator_action_ordinal") == 0) & (F.size("signatures") > 0), F.col("signatures"))
    rows = contract_rows(changed).withColumnRenamed("code", "account")
    rows = hold(decoding.decode_in_force(rows, timeline, "tables", "account", "position", F.col("position.block"), "table", "value", fallback).withColumnRenamed("account", "code"))
    place = lambda: state.version(F.col("arrival_ordinal"), state.row_sequence(F.col("delta_idx"), F.col("row_idx")))
    listed = lambda section: F.from_json(F.get_json_object("abi", f"$.{section}"), "array<struct<name: string>>")["name"]
    return {
        "action": action.select("@timestamp", "global_sequence", "block_num", "block_id", "trx_id", "producer", act.alias("act"), "notified", "receipts", "action_ordinal", "creator_action_ordinal", "cpu_usage_us", "net_usage_words", "code_sequence", "abi_sequence", "act_digest", signed.alias("signatures"), "@transfer", "@newaccount"),
        "block": header.where("producer IS NOT NULL").select(F.col("timestamp").alias("@timestamp"), "block_num", "block_id", "prev_id", "producer", "schedule_version", "trx_count", "cpu_usage_us", "net_usage_words", "arrival_ordinal"),
        "delta": rows.select("@timestamp", "block_num", "block_id", "ordinal", "code", "scope", "table", "primary_key", "payer", "present", F.col("data_json").alias("data"), F.when(F.col("data_json").isNull(), columns.hex_text(F.col("value"))).alias("value_hex"), "arrival_ordinal"),
        "abi": account_rows(changed).select("@timestamp", "block_num", "account", "abi", listed("actions").alias("actions"), listed("tables").alias("tables"), "arrival_ordinal"),
        "perm": permission_rows(changed).withColumn("_version", place()).drop("arrival_ordinal", "delta_idx", "row_idx"),
        "token": balances(rows).withColumn("_version", place()).drop("arrival_ordinal", "delta_idx", "row_idx"),
    }


KEYS = {"perm": ["owner", "name"], "token": ["code", "scope", "symbol"], "block": ["block_num"], "action": ["global_sequence"], "delta": ["block_num", "ordinal"], "abi": ["block_num", "account"]}


def raw_from_frames(frames: DataFrame) -> DataFrame:
    """Raw blocks from a feed's binary frames (arrival_ordinal, frame); other results than blocks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for k, frame in zip(batch.column("arrival_ordinal").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                kind, r = wire.result(frame)
                if kind == "blocks":
                    this, prev = r["this_block"] or {}, r["prev_block"] or {}
                    rows.append({"arrival_ordinal": k, "block_num": this.get("block_num"), "block_id": this.get("block_id"), "prev_id": prev.get("block_id"), "head_num": r["head"]["block_num"], "lib_num": r["lib"]["block_num"], "block": r["block"], "traces": r["traces"], "deltas": r["deltas"]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(RAW))
    return frames.select("arrival_ordinal", "frame").mapInArrow(run, RAW)


