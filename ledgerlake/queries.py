"""Every operator as a query over the test tables, with its DuckDB twin.

Queries call the library's operators; the twins are written by hand in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as a
from . import samples
from .codec import pack, schema
from .functions import columns as c
from .functions import decoding
from .operators import ingest, sinks, state
from .session import on_workers
from .plans import filters, history
from .plans import state as accounts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, views: bool = True):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {a.VIEWS} {sql}" if views else sql
        return f

    return add


def _plain(found: DataFrame) -> DataFrame:
    """Actions with scalar columns only."""
    return found.select("global_sequence", "block_num", "trx_id", F.col("@timestamp").alias("ts_text"), F.col("act.account").alias("account"), F.col("act.name").alias("name"), F.col("act.data").alias("data"), F.array_join("notified", ",").alias("notified"))


PLAIN = "global_sequence, block_num, trx_id, ts_text, account, name, data, array_to_string(notified, ',') AS notified"


@query(f"SELECT {PLAIN} FROM action WHERE list_contains(notified, 'u7') ORDER BY global_sequence DESC LIMIT 100")
def q1_actions_by_account(spark, d):
    return _plain(history.get_actions(a.actions(spark, d), account="u7"))


@query(f"SELECT {PLAIN} FROM action WHERE list_contains(notified, 'u7') ORDER BY global_sequence DESC LIMIT 100")
def q1_actions_by_posting(spark, d):
    found = a.actions(spark, d)
    return _plain(history.get_actions(found, account="u7", postings=state.postings(found)))


@query(f"SELECT {PLAIN} FROM action WHERE (account = 'shop' AND name = 'transfer') OR (name = 'newaccount') ORDER BY global_sequence LIMIT 200 OFFSET 30")
def q1_actions_filter_pairs(spark, d):
    return _plain(history.get_actions(a.actions(spark, d), sort="asc", skip=30, limit=200, filter="shop:transfer,*:newaccount"))


@query(f"SELECT {PLAIN} FROM action WHERE ts_text >= '2024-01-10T00:00:00.000' AND ts_text <= '2024-01-20T12:00:00.000' ORDER BY global_sequence DESC LIMIT 1000")
def q1_actions_time_range(spark, d):
    return _plain(history.get_actions(a.actions(spark, d), limit=5000, after="2024-01-10T00:00:00.000", before="2024-01-20T12:00:00.000"))


@query(f"SELECT {PLAIN} FROM action WHERE block_num >= 1516000000 AND block_num <= 1517000000 ORDER BY global_sequence DESC LIMIT 100")
def q1_actions_block_range(spark, d):
    return _plain(history.get_actions(a.actions(spark, d), after="1516000000", before="1517000000"))


@query(f"SELECT {PLAIN} FROM action WHERE name = 'transfer' AND actor = 'u11' AND amount IS NOT NULL AND memo SIMILAR TO '.*(^|[^a-z0-9])(3|5)' ORDER BY global_sequence DESC LIMIT 100")
def q1_actions_transfer_fields(spark, d):
    return _plain(history.get_actions(a.actions(spark, d), transfer={"from": "u11", "to": "bank", "symbol": "USD", "memo": "3, 5!"}))


@query("SELECT block_num AS block, block_num <= 1516500000 AS irreversible, ts_text AS timestamp, trx_id AS transaction_id, actor || '@active' AS actors, array_to_string(notified, ',') AS notified, account AS contract, name AS action, data FROM action WHERE list_contains(notified, 'bank') ORDER BY global_sequence DESC LIMIT 100")
def q1_actions_simple(spark, d):
    return history.simple(history.get_actions(a.actions(spark, d), account="bank"), 1516500000)


@query("SELECT least(count(*), 10000) AS value, CASE WHEN count(*) > 10000 THEN 'gte' ELSE 'eq' END AS relation FROM action WHERE account = 'shop'")
def q1_total_capped(spark, d):
    return history.total(a.actions(spark, d), history.action_filter(filter="shop:*"))


@query("SELECT count(*) AS value, 'eq' AS relation FROM action WHERE list_contains(notified, 'bank')")
def q1_total_exact(spark, d):
    return history.total(a.actions(spark, d), history.action_filter(account="bank"), track=True)


@query(f"SELECT {PLAIN} FROM action WHERE trx_id = md5('t50') ORDER BY global_sequence LIMIT 1000")
def q2_transaction(spark, d):
    import hashlib

    return _plain(history.get_transaction(a.actions(spark, d), hashlib.md5(b"t50").hexdigest().upper()))


@query("SELECT ts_text, block_num, ordinal, code, scope, payer, present, \"table\" FROM delta WHERE code = 'auth' AND NOT present ORDER BY block_num DESC, ordinal DESC LIMIT 300 OFFSET 10")
def q3_deltas(spark, d):
    found = history.get_deltas(a.deltas(spark, d), skip=10, limit=300, code="auth", present=False)
    return found.select(F.col("@timestamp").alias("ts_text"), "block_num", "ordinal", "code", "scope", "payer", "present", "table")


@query("SELECT ts_text, block_num, ordinal, scope, \"table\" FROM delta WHERE \"table\" = 'click' AND payer = 'u3' AND block_num >= 1516000000 ORDER BY block_num, ordinal LIMIT 100")
def q3_deltas_ascending(spark, d):
    found = history.get_deltas(a.deltas(spark, d), sort="asc", after="1516000000", table="click", payer="u3")
    return found.select(F.col("@timestamp").alias("ts_text"), "block_num", "ordinal", "scope", "table")


@query("SELECT account, block_num, abi FROM abi WHERE account = 'k7' AND block_num <= 760000000 ORDER BY block_num DESC, version DESC LIMIT 1")
def q4_abi_snapshot(spark, d):
    newest = a.abis(spark, d).groupBy("account", "block_num").agg(F.max_by("abi", "version").alias("abi"))
    return history.get_abi_snapshot(newest, "k7", 760000000).select("account", "block_num", "abi")


@query("SELECT json_extract_string(data, '$.newact') AS name, trx_id, ts_text AS timestamp FROM action WHERE name = 'newaccount' AND creator = 'u3' ORDER BY global_sequence DESC LIMIT 100")
def q5_created_accounts(spark, d):
    return history.get_created_accounts(a.actions(spark, d), "u3")


@query("SELECT actor AS account, creator, block_num, trx_id, ts_text AS timestamp FROM action WHERE name = 'newaccount' AND actor = 'u13' ORDER BY global_sequence LIMIT 1")
def q6_creator(spark, d):
    return history.get_creator(a.actions(spark, d), "u13")


@query("SELECT owner, name, block_num FROM perm WHERE list_contains(keys, 'KEY7') ORDER BY owner, name LIMIT 1000")
def q7_key_accounts(spark, d):
    return accounts.get_key_accounts(a.perms(spark, d), " KEY7 ").select("owner", "name", "block_num")


@query("SELECT DISTINCT owner FROM (SELECT owner FROM perm WHERE list_contains(keys, 'KEY7') ORDER BY owner, name LIMIT 1000)")
def q13_v1_key_accounts(spark, d):
    return accounts.owners(accounts.get_key_accounts(a.perms(spark, d), "KEY7"))


@query("SELECT symbol, \"precision\", amount, code AS contract FROM token_now WHERE NOT gone AND scope = 'c42' ORDER BY amount DESC LIMIT 1000")
def q8_tokens(spark, d):
    return accounts.get_tokens(a.current_tokens(spark, d), "c42")


@query("SELECT count(*) AS value, 'eq' AS relation FROM action WHERE list_contains(notified, 'u9')")
def q9_account_total(spark, d):
    return accounts.get_account(a.actions(spark, d), a.current_tokens(spark, d), a.perms(spark, d), "u9")["total_actions"]


@query(f"SELECT {PLAIN} FROM action WHERE list_contains(notified, 'u9') ORDER BY global_sequence DESC LIMIT 20")
def q9_account_actions(spark, d):
    return _plain(accounts.get_account(a.actions(spark, d), a.current_tokens(spark, d), a.perms(spark, d), "u9")["actions"])


@query("SELECT CAST(1520000000 AS BIGINT) AS head, CAST(1519999900 AS BIGINT) AS lib, max(block_num) AS last_indexed_block, greatest(1520000000 - max(block_num), 0) AS lag, CASE WHEN 1520000000 - max(block_num) < 20 THEN 'OK' ELSE 'Warning' END AS status FROM action")
def q10_health(spark, d):
    chain = spark.sql("SELECT 1520000000L AS head, 1519999900L AS lib")
    return accounts.get_health(a.actions(spark, d), chain)


V1 = "global_sequence AS global_action_seq, block_num, ts_text AS block_time, trx_id, account, name, notified[1] AS receipt_receiver"


@query(f"SELECT *, row_number() OVER (ORDER BY global_action_seq) - 1 AS account_action_seq FROM (SELECT {V1} FROM action WHERE list_contains(notified, 'bank') ORDER BY global_sequence DESC LIMIT 20)")
def q11_v1_tail(spark, d):
    return history.v1_get_actions(a.actions(spark, d), "bank")


@query(f"SELECT *, row_number() OVER (ORDER BY global_action_seq) + 14 AS account_action_seq FROM (SELECT {V1} FROM action WHERE list_contains(notified, 'bank') ORDER BY global_sequence LIMIT 40 OFFSET 15)")
def q11_v1_from_position(spark, d):
    return history.v1_get_actions(a.actions(spark, d), "bank", 15, 40)


@query("SELECT trx_id AS id, block_num, ts_text AS block_time, global_sequence, account, name, global_sequence * 4 AS receipt_sequence FROM action WHERE trx_id = md5('t77') ORDER BY global_sequence")
def q12_v1_transaction(spark, d):
    import hashlib

    return history.v1_get_transaction(a.actions(spark, d), hashlib.md5(b"t77").hexdigest())


@query("SELECT DISTINCT owner FROM (SELECT owner FROM perm WHERE len(list_filter(accounts, lambda x: starts_with(x, 'r5@'))) > 0 ORDER BY owner, name LIMIT 1000)")
def q14_v1_controlled_accounts(spark, d):
    return accounts.get_controlled_accounts(a.perms(spark, d), "r5")


# aggregations


@query("SELECT max(block_num) AS max_block FROM action")
def agg1_max_block(spark, d):
    return a.actions(spark, d).agg(F.max("block_num").alias("max_block"))


@query("SELECT * FROM block")
def agg2_block_rollup(spark, d):
    return a.blocks(spark, d)


def _traces(spark: SparkSession, d: str) -> DataFrame:
    """Line items as action traces: the order is the transaction, the return flag the digest, the supplier the receiver."""
    li = a.read(spark, d, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("arrival_ordinal"), F.lit(0).alias("trx_idx"), order.alias("trace_idx"), F.lit(0).alias("status"), F.col("l_returnflag").alias("act_digest"),
        F.col("l_suppkey").cast("string").alias("receiver"), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey").cast("string")).otherwise(F.lit("none")).alias("account"), F.concat(F.lit("a"), F.col("l_linenumber") % 3).alias("name"),
        F.col("l_partkey").alias("global_sequence"), F.col("l_partkey").alias("recv_sequence"), F.lit(None).cast("string").alias("auth_sequence"),
    )


TRACES = "SELECT *, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem"
COLLAPSED = f"""SELECT l_orderkey AS trx, l_returnflag AS digest, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS notified,
  arg_min(l_suppkey, row(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, k)) AS receiver, arg_min(l_partkey, row(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, k)) AS sequence,
  arg_min('a' || (l_linenumber % 3), row(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, k)) AS name, arg_min(CASE WHEN l_linestatus = 'O' THEN CAST(l_suppkey AS VARCHAR) ELSE 'none' END, row(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, k)) AS account
  FROM ({TRACES}) GROUP BY 1, 2"""


def _collapsed(found: DataFrame) -> DataFrame:
    return found.select(F.col("arrival_ordinal").alias("trx"), F.col("act_digest").alias("digest"), F.array_join("notified", ",").alias("notified"), F.col("receiver").cast("long").alias("receiver"), F.col("global_sequence").alias("sequence"), "name", "account")


@query(COLLAPSED, views=False)
def agg3_collapse(spark, d):
    return _collapsed(ingest.collapse(_traces(spark, d)))


@query(f"SELECT * FROM ({COLLAPSED}) WHERE NOT (account = 'none' AND name = 'a1')", views=False)
def t6_skip_actions(spark, d):
    return _collapsed(ingest.collapse(_traces(spark, d), ["none::a1", "malformed"]))


@query("SELECT count(DISTINCT notified_one) AS n_accounts, count(*) AS n_postings FROM (SELECT DISTINCT global_sequence, unnest(notified) AS notified_one FROM action)")
def join7_postings(spark, d):
    return state.postings(a.actions(spark, d)).agg(F.count_distinct("account").alias("n_accounts"), F.count(F.lit(1)).alias("n_postings"))


# state


@query("SELECT code, scope, symbol, \"precision\", amount, version FROM token_now WHERE NOT gone")
def snk2_latest(spark, d):
    return a.current_tokens(spark, d).select("code", "scope", "symbol", "precision", "amount", F.col("_version").alias("version"))


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'", views=False)
def snk2_latest_events(spark, d):
    e = a.read(spark, d, "events").withColumn("_op", F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("index")))
    return state.latest(e.select("user_id", "event_type", "value", "event_id", "_op"), ["user_id"], "event_id").drop("_op")


AS_OF = "SELECT p.event_id, s.event_id AS signup FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON p.user_id = s.user_id AND p.ts >= s.ts"


@query(AS_OF, views=False)
def join1_as_of(spark, d):
    e = a.read(spark, d, "events")
    versions = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup"))
    return state.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), versions, "user_id", "ts", "signup", into="found").select("event_id", F.col("found").alias("signup"))


@query("SELECT event_id, (SELECT max(s.event_id) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.event_id <= p.event_id) AS signup FROM events p WHERE event_type = 'purchase'", views=False)
def join1_as_of_window(spark, d):
    e = a.read(spark, d, "events")
    found = state.as_of_by_window(e, "user_id", ["event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "signup")
    return found.where("event_type = 'purchase'").select("event_id", "signup")


@query("SELECT p.event_id, coalesce(s.event_id, -p.user_id) AS signup FROM (SELECT * FROM events WHERE event_type = 'click') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) s ON p.user_id = s.user_id AND p.ts >= s.ts", views=False)
def join2_as_of_fallback(spark, d):
    e = a.read(spark, d, "events")
    versions = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup"))
    fallback = e.select("user_id", (-F.col("user_id")).alias("signup")).distinct()
    return state.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), versions, "user_id", "ts", "signup", fallback).select("event_id", F.col("found").alias("signup"))


@query("SELECT e.event_id, b.block_num, b.trx_count FROM events e JOIN block b ON b.block_num = CAST(floor(CAST(floor((epoch_us(ts) / 1000 - 946684800000) / 500) AS BIGINT) / 7200) AS BIGINT) WHERE e.event_type = 'signup'")
def join3_header(spark, d):
    e = a.read(spark, d, "events").where("event_type = 'signup'").withColumn("block_num", F.floor(c.slot_of("ts") / 7200).cast("long"))
    return e.join(a.blocks(spark, d), "block_num").select("event_id", "block_num", "trx_count")


@query("SELECT global_sequence, account, name FROM action WHERE NOT (account = 'shop' AND name IN ('click', 'view'))")
def join6_skip(spark, d):
    skipped = spark.sql("SELECT * FROM VALUES ('shop', 'click'), ('shop', 'view') AS v(account, name)")
    found = a.actions(spark, d).select("global_sequence", "act.account", "act.name")
    return state.anti_lookup(found, skipped, ["account", "name"])


@query("SELECT 'explicit' AS how, CAST(8 AS BIGINT) AS start_block UNION ALL SELECT 'checkpoint', 16 UNION ALL SELECT 'blocks', max(block_num) + 1 FROM block UNION ALL SELECT 'actions', max(block_num) + 1 FROM action UNION ALL SELECT 'empty', 1")
def snk7_resume(spark, d):
    none, at_15 = spark.sql("SELECT CAST(NULL AS bigint) AS block_num WHERE false"), spark.sql("SELECT 15L AS block_num")
    blocks, actions = a.blocks(spark, d), a.actions(spark, d)
    cases = {"explicit": (8, at_15, blocks, actions), "checkpoint": (None, at_15, blocks, actions), "blocks": (None, none, blocks, actions), "actions": (None, none, none, actions), "empty": (None, none, none, none)}
    found = [state.resume_block(*args).select(F.lit(how).alias("how"), "start_block") for how, args in cases.items()]
    return reduce(DataFrame.unionByName, found)


ORDER_SLOT = a.SLOT.format("o_orderdate")


@query(f"SELECT * FROM (SELECT o_orderkey, {ORDER_SLOT} AS block_num, lag({ORDER_SLOT}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE block_num <= previous", views=False)
def st5_forks(spark, d):
    arrivals = a.read(spark, d, "orders").select("o_orderkey", "o_custkey", c.slot_of("o_orderdate").alias("block_num"))
    return state.forks(arrivals, "o_orderkey", stream="o_custkey").select("o_orderkey", "block_num", "previous")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ordinal FROM lineitem WHERE l_returnflag <> 'R'", views=False)
def t13_delta_ordinal(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = a.read(spark, d, "lineitem").where("l_returnflag <> 'R'")
    return li.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "ordinal")


@query("SELECT event_id, (user_id << 28) | ((event_id % 60) << 22) | event_id AS version FROM events", views=False)
def t16_doc_version(spark, d):
    # ids of any size in one layout of bits: what is beyond a row's bits belongs to the delta's, and what is beyond those to the place
    e, rows, sequences = F.col("event_id"), state.ROW_BITS, state.SEQUENCE_BITS
    delta = (e % 60).bitwiseOR(F.shiftright(e, rows)).bitwiseAND((1 << sequences - rows) - 1)
    place = F.col("user_id").bitwiseOR(F.shiftright(e, sequences))
    return a.read(spark, d, "events").select("event_id", state.version(place, state.row_sequence(delta, e.bitwiseAND((1 << rows) - 1))).alias("version"))


@query("SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL", views=False)
def f21_json_path(spark, d):
    return a.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k IS NOT NULL")


# text


@query("SELECT conv_id, turn FROM conversations WHERE list_has_any(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ['to', 'in'])", views=False)
def p5_match(spark, d):
    return a.read(spark, d, "conversations").where(filters.has_any_token(F.col("text"), "To, IN")).select("conv_id", "turn")


# scalar functions


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return a.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 123456789012).alias("v"))


PLACES = " || ".join(f"substr('.12345abcdefghijklmnopqrstuvwxyz', CAST((v >> {s}) & {m} AS INTEGER) + 1, 1)" for s, m in [*((s, 31) for s in range(59, 3, -5)), (0, 15)])


@query(f"SELECT o_orderkey, rtrim({PLACES}, '.') AS name FROM (SELECT o_orderkey, o_orderkey * 123456789012 AS v FROM orders)", views=False)
def f1_name_text(spark, d):
    return _numbers(spark, d).select("o_orderkey", c.name_text(F.col("v")).alias("name"))


@query("SELECT o_orderkey, o_orderkey * 123456789012 AS v, CAST(NULL AS BIGINT) AS invalid FROM orders", views=False)
def f2_name_value(spark, d):
    return _numbers(spark, d).select("o_orderkey", c.name_value(c.name_text(F.col("v"))).alias("v"), c.name_value(F.concat(F.lit("UP"), F.col("v").cast("string"))).alias("invalid"))


@query("SELECT n_nationkey, upper(substr(regexp_replace(n_name, '[^A-Za-z]', '', 'g'), 1, 7)) AS code FROM nation", views=False)
def f3_symbol_code(spark, d):
    code = F.upper(F.substring(F.regexp_replace("n_name", "[^A-Za-z]", ""), 1, 7))
    return a.read(spark, d, "nation").select("n_nationkey", c.symbol_code_text(c.symbol_code_value(code)).alias("code"))


UNITS = "CAST(round(c_acctbal * 100) AS BIGINT)"
RENDERED = "CASE WHEN {u} < 0 THEN '-' ELSE '' END || CAST(abs({u}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({u}) % 100 AS VARCHAR), 2, '0') || ' USD'".format(u=UNITS)


@query(f"SELECT c_custkey, {RENDERED} AS asset, CAST({UNITS} AS VARCHAR) || ' USD' AS whole FROM customer", views=False)
def f5_asset_text(spark, d):
    units = F.round(F.col("c_acctbal") * 100).cast("long")
    return a.read(spark, d, "customer").select("c_custkey", c.asset_text(units, F.lit(2), F.lit("USD")).alias("asset"), c.asset_text(units, F.lit(0), F.lit("USD")).alias("whole"))


@query(f"SELECT c_custkey, {UNITS} AS amount, 2 AS \"precision\", 'USD' AS code, {UNITS} / 100.0::DOUBLE AS number FROM customer", views=False)
def f7_asset_parse(spark, d):
    units = F.round(F.col("c_acctbal") * 100).cast("long")
    found = a.read(spark, d, "customer").select("c_custkey", c.parse_asset(c.asset_text(units, F.lit(2), F.lit("USD"))).alias("p"))
    return found.select("c_custkey", "p.amount", "p.precision", "p.code", c.asset_number(F.col("p.amount"), F.col("p.precision")).alias("number"))


@query(f"SELECT event_id, {a.SLOT.format('ts')} AS slot, strftime(epoch_ms(946684800000 + 500 * {a.SLOT.format('ts')}), '%Y-%m-%dT%H:%M:%S.%g') AS at FROM events", views=False)
def f10_slot_time(spark, d):
    slot = c.slot_of("ts")
    return a.read(spark, d, "events").select("event_id", slot.alias("slot"), c.slot_text(slot).alias("at"))


@query("SELECT event_id, lower(hex(encode(event_type))) AS hex, CASE user_id % 6 WHEN 0 THEN 'executed' WHEN 1 THEN 'soft_fail' WHEN 2 THEN 'hard_fail' WHEN 3 THEN 'delayed' WHEN 4 THEN 'expired' ELSE 'unknown' END AS status FROM events", views=False)
def f15_hex_and_status(spark, d):
    return a.read(spark, d, "events").select("event_id", c.hex_text(F.col("event_type").cast("binary")).alias("hex"), c.status_text(F.col("user_id") % 6).alias("status"))




# decoding, from the tables' rows packed as the chain packs them

ORDER_ABI = {
    "version": "", "types": [{"new_type_name": "key_type", "type": "uint64"}], "variants": [],
    "structs": [{"name": "keyed", "base": "", "fields": [{"name": "key", "type": "key_type"}]}, {"name": "order", "base": "keyed", "fields": [{"name": n, "type": t} for n, t in (("cust", "uint32"), ("status", "string"), ("total", "asset"), ("at", "time_point_sec"), ("tags", "name[]"), ("note", "string?"), ("more", "uint8$"))]}],
    "actions": [{"name": "place", "type": "order", "ricardian_contract": ""}], "tables": [{"name": "orders", "type": "order"}],
}


def _packed_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = schema.Schema(ORDER_ABI)

    @F.arrow_udf("binary")
    def pack_order(key: pa.Array, cust: pa.Array, status: pa.Array, units: pa.Array, at: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (key, cust, status, units, at)), strict=True)
        return pa.array([pack.encode(orders, "order", {"key": k, "cust": c, "status": s, "total": (u, "2,USD"), "at": t, "tags": ["tag", f"o{k % 5 + 1}"], "note": s if k % 2 else None}) for k, c, s, u, t in rows], type=pa.binary())

    o = a.read(spark, d, "orders")
    units, at = F.round(F.col("o_totalprice") * 100).cast("long"), (c.micros("o_orderdate") / 1000000).cast("long")
    return o.select("o_orderkey", pack_order("o_orderkey", "o_custkey", "o_orderstatus", units, at).alias("data"))


DECODED = """SELECT o_orderkey, o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status, CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' USD' AS total,
  strftime(date_trunc('second', o_orderdate), '%Y-%m-%dT%H:%M:%S.%g') AS at, '["tag","o' || (o_orderkey % 5 + 1) || '"]' AS tags, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS note FROM orders"""


def _fields(found: DataFrame, json: str) -> DataFrame:
    at = lambda name: F.get_json_object(json, f"$.{name}")
    return found.select("o_orderkey", at("key").cast("long").alias("key"), at("cust").cast("long").alias("cust"), at("status").alias("status"), at("total").alias("total"), at("at").alias("at"), at("tags").alias("tags"), at("note").alias("note"))


@query(DECODED, views=False)
def d3_decode_action(spark, d):
    on_workers(spark)
    found = _packed_orders(spark, d)
    return _fields(found.withColumn("j", decoding.decode_action(F.lit(schema.to_json(ORDER_ABI)), F.lit("place"), F.col("data"))), "j")


@query(DECODED, views=False)
def d4_decode_row(spark, d):
    on_workers(spark)
    found = _packed_orders(spark, d)
    return _fields(found.withColumn("j", decoding.decode_row(F.lit(schema.to_json(ORDER_ABI)), F.lit("orders"), F.col("data"))), "j")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN lower(hex(encode('x' || o_orderkey))) END AS hex_data, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS cust FROM orders", views=False)
def d13_decode_or_hex(spark, d):
    """Data that decodes gives its fields; what does not, every third row here, comes back as hexadecimal text."""
    on_workers(spark)
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "o_orderkey").cast("binary"))
    found = _packed_orders(spark, d).withColumn("data", F.coalesce(odd, "data"))
    found = found.withColumn("json", decoding.decode_action(F.lit(schema.to_json(ORDER_ABI)), F.lit("place"), F.col("data")))
    return found.select("o_orderkey", F.when(F.col("json").isNull(), c.hex_text(F.col("data"))).alias("hex_data"), F.get_json_object("json", "$.cust").cast("long").alias("cust"))


def _customer_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A block per customer: its balance row, a transfer with two notifications, a permission; every third repeats a scope."""
    def frames(batches):
        abi = samples.packed_abi(samples.TOKEN_ABI)
        for batch in batches:
            made = []
            for key, units in zip(batch.column("k").to_pylist(), batch.column("units").to_pylist(), strict=True):
                scope = "c" + "".join("abcdefghij"[int(x)] for x in str(key % 100))
                act = [samples.action_trace(n + 1, 0, r, "tok", "transfer", samples.transfer(scope, "bank", units, "m"), key * 4 + n, "0d") for n, r in enumerate(("tok", scope, "bank"))]
                rows = [samples.delta("account", [(True, samples.account_row("tok", abi))]), samples.delta("contract_row", [(units >= 0, samples.contract_row("tok", scope, "accounts", key, samples.asset(units)))])]
                rows.append(samples.delta("permission", [(True, samples.permission_row(scope, "active", accounts=[("bank", "active")]))]))
                made.append(samples.frame(key, samples.signed_block(key, "maker" + "abcde"[key % 5], key % 3, 100 + key % 400, 1 + key % 50), [samples.transaction(act, f"{key % 256:02x}")], rows))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(made, pa.binary())], names=["arrival_ordinal", "frame"])

    keyed = a.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") * 100).cast("long").alias("units"))
    # a small file would be one task's, and packing is work of the processor
    keyed = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ingest.raw_from_frames(keyed.mapInArrow(frames, "arrival_ordinal long, frame binary"))


_held: list[DataFrame] = []


def _decoded_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The decoded blocks of customers, kept until the next query that asks for them: a table reads them several times."""
    while _held:
        old = _held.pop()
        if old.sparkSession.sparkContext._jsc is not None:
            old.unpersist()
    # on disk: rows of nested objects would fill an executor's heap, and its collector's time
    _held.append(ingest.decoded(_customer_blocks(spark, d)).persist(StorageLevel.DISK_ONLY))
    return _held[0]


SCOPE = "'c' || translate(CAST(c_custkey % 100 AS VARCHAR), '0123456789', 'abcdefghij')"


@query(f"SELECT c_custkey AS block_num, CAST(c_custkey * 4 AS BIGINT) AS global_sequence, 'tok,' || {SCOPE} || ',bank' AS notified, {SCOPE} AS sender, CAST(round(c_acctbal * 100) AS BIGINT) / 10000.0::DOUBLE AS amount, strftime(epoch_ms(946684800000 + 500 * c_custkey), '%Y-%m-%dT%H:%M:%S.%g') AS ts_text, 1 AS signatures FROM customer", views=False)
def t7_ingest_actions(spark, d):
    """Frames to actions: decoded, collapsed, with the schema in force, and typed."""
    on_workers(spark)
    code = spark.createDataFrame([("tok", schema.to_json(samples.TOKEN_ABI))], "account string, abi string")
    found = ingest.tables_of(_decoded_blocks(spark, d), code)["action"]
    return found.select("block_num", F.col("global_sequence").cast("long").alias("global_sequence"), F.array_join("notified", ",").alias("notified"), F.col("`@transfer`.from").alias("sender"), F.col("`@transfer`.amount").alias("amount"), F.col("@timestamp").alias("ts_text"), F.size("signatures").alias("signatures"))


@query(f"SELECT scope, block_num, amount FROM (SELECT {SCOPE} AS scope, c_custkey AS block_num, CAST(round(c_acctbal * 100) AS BIGINT) / 10000.0::DOUBLE AS amount, row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey DESC) AS r FROM customer) WHERE r = 1 AND amount >= 0", views=False)
def t14_ingest_tokens(spark, d):
    """Frames to current balances: the latest row of each scope, deleted ones gone."""
    on_workers(spark)
    return state.latest(ingest.tables_of(_decoded_blocks(spark, d))["token"], ingest.KEYS["token"]).select("scope", "block_num", "amount")


@query(f"SELECT {SCOPE} AS owner, max(c_custkey) AS block_num, 'bank@active' AS accounts FROM customer GROUP BY 1", views=False)
def t12_ingest_permissions(spark, d):
    on_workers(spark)
    return state.latest(ingest.block_tables(_customer_blocks(spark, d))["perm"], ingest.KEYS["perm"]).select("owner", "block_num", F.array_join("accounts", ",").alias("accounts"))


@query("SELECT c_custkey AS block_num, 'maker' || substr('abcde', CAST(c_custkey % 5 AS INTEGER) + 1, 1) AS producer, c_custkey % 3 AS trx_count, (c_custkey % 3) * (100 + c_custkey % 400) AS cpu_usage_us, (c_custkey % 3) * (1 + c_custkey % 50) AS net_usage_words FROM customer", views=False)
def t2_ingest_blocks(spark, d):
    on_workers(spark)
    return ingest.block_tables(_customer_blocks(spark, d))["block"].select("block_num", "producer", "trx_count", "cpu_usage_us", "net_usage_words")


@query(f"SELECT c_custkey AS block_num, 0 AS ordinal, {SCOPE} AS scope, CAST(c_custkey AS VARCHAR) AS primary_key, c_acctbal >= 0 AS present FROM customer", views=False)
def t13_ingest_deltas(spark, d):
    on_workers(spark)
    return ingest.tables_of(_decoded_blocks(spark, d))["delta"].select("block_num", F.col("ordinal").cast("int").alias("ordinal"), "scope", "primary_key", "present")


@query(f"""SELECT '{{"index":{{"_index":"x-token","_id":"' || code || '-' || scope || '-USD","version":' || version || ',"version_type":"external"}}}}' AS head FROM token WHERE NOT gone
UNION ALL SELECT '{{"delete":{{"_index":"x-token","_id":"' || code || '-' || scope || '-USD","version":' || version || ',"version_type":"external"}}}}' FROM token WHERE gone""")
def snk1_bulk_lines(spark, d):
    lines = sinks.bulk_lines(a.tokens(spark, d), "token", "x-token")
    return lines.select(F.split("lines", "\n")[0].alias("head"))
