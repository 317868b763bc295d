"""The logical tables of the chain over the star-schema test tables, for Spark and for DuckDB.

Every read operator is written against the logical tables; these views only rename and
derive columns, so that the operators can be held against SQL at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns
from .operators import state

#: Contracts by event type, in both dialects.
CONTRACT = "CASE WHEN event_type IN ('signup', 'error') THEN 'auth' ELSE 'shop' END"
NAME = "CASE event_type WHEN 'purchase' THEN 'transfer' WHEN 'signup' THEN 'newaccount' ELSE event_type END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action per event: the user and the contract are notified, purchases are transfers, signups new accounts."""
    e = read(spark, sf_dir, "events")
    user = F.concat(F.lit("u"), F.col("user_id"))
    contract, name = F.expr(CONTRACT), F.expr(NAME)
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    trx = F.md5(F.concat(F.lit("t"), F.floor(F.col("event_id") / 4).cast("string")).cast("binary"))
    data = F.concat(F.lit('{"newact":"u'), F.col("user_id"), F.lit('","creator":"u'), (F.col("user_id") % 10).cast("string"), F.lit('"}'))
    act = F.struct(contract.alias("account"), name.alias("name"), F.array(F.struct(user.alias("actor"), F.lit("active").alias("permission"))).alias("authorization"), F.when(name == "newaccount", data).otherwise(F.col("props")).alias("data"))
    transfer = F.when(name == "transfer", F.struct(user.alias("from"), F.lit("bank").alias("to"), F.col("value").alias("amount"), F.lit("USD").alias("symbol"), F.concat(F.lit("order of item "), (F.col("event_id") % 7).cast("string")).alias("memo")))
    created = F.when(name == "newaccount", F.struct(user.alias("newact"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("creator")))
    notified = F.when(name == "transfer", F.array(contract, user, F.lit("bank"))).otherwise(F.array(contract, user))
    receipts = F.transform(notified, lambda r, i: F.struct(r.alias("receiver"), (F.col("event_id") * 4 + i).alias("global_sequence")))
    return e.select(at.alias("@timestamp"), F.col("event_id").alias("global_sequence"), columns.slot_of("ts").alias("block_num"), trx.alias("trx_id"), act.alias("act"), notified.alias("notified"), receipts.alias("receipts"), transfer.alias("@transfer"), created.alias("@newaccount"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row change per event; errors are deletes."""
    e = read(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("@timestamp"), columns.slot_of("ts").alias("block_num"), F.col("event_id").alias("ordinal"), F.expr(CONTRACT).alias("code"), F.concat(F.lit("u"), "user_id").alias("scope"), F.col("event_type").alias("table"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("payer"), (F.col("event_type") != "error").alias("present"), "value")


def perms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permission per nation and segment, with keys and controlling accounts of its customers."""
    c = read(spark, sf_dir, "customer")
    key, account = F.concat(F.lit("KEY"), F.col("c_custkey") % 50), F.concat(F.lit("r"), F.col("c_custkey") % 40, F.lit("@"), F.lower(F.substring("c_mktsegment", 1, 4)))
    return c.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("owner"), F.lower("c_mktsegment").alias("name")).agg(F.sort_array(F.collect_set(key)).alias("keys"), F.sort_array(F.collect_set(account)).alias("accounts"), F.max("c_custkey").alias("block_num"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance changes: a hundred scopes, a contract per segment, versions by customer; negative balances are deletes."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.lower("c_mktsegment").alias("code"), F.concat(F.lit("c"), F.col("c_custkey") % 100).alias("scope"), F.lit("USD").alias("symbol"), F.lit(2).alias("precision"), F.col("c_acctbal").alias("amount"), F.col("c_custkey").alias("_version"), F.when(F.col("c_acctbal") < 0, F.lit("delete")).otherwise(F.lit("index")).alias("_op"))


def current_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(tokens(spark, sf_dir), ["code", "scope", "symbol"])


def abis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema version per order: the contract is the customer, the text names status and priority."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("k"), "o_custkey").alias("account"), columns.slot_of("o_orderdate").alias("block_num"), F.col("o_orderkey").alias("version"), F.concat("o_orderstatus", F.lit(":"), "o_orderpriority").alias("abi"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block per hour of events."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.floor(columns.slot_of("ts") / 7200).cast("long").alias("block_num")).agg(F.count(F.lit(1)).alias("trx_count"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cpu_usage_us"), F.max("event_id").alias("last_event"))


#: The same views for DuckDB, as the head of a WITH clause.
SLOT = "CAST(floor((epoch_us({0}) / 1000 - 946684800000) / 500) AS BIGINT)"
VIEWS = f"""
action AS (SELECT *, CASE WHEN name = 'transfer' THEN [account, actor, 'bank'] ELSE [account, actor] END AS notified FROM (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts_text, event_id AS global_sequence, {SLOT.format("ts")} AS block_num,
    md5('t' || CAST(event_id // 4 AS VARCHAR)) AS trx_id, {CONTRACT} AS account, {NAME} AS name, 'u' || user_id AS actor,
    CASE WHEN event_type = 'signup' THEN '{{"newact":"u' || user_id || '","creator":"u' || (user_id % 10) || '"}}' ELSE props END AS data,
    value AS amount, 'order of item ' || (event_id % 7) AS memo, CASE WHEN event_type = 'signup' THEN 'u' || (user_id % 10) END AS creator FROM events)),
delta AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts_text, {SLOT.format("ts")} AS block_num, event_id AS ordinal, {CONTRACT} AS code, 'u' || user_id AS scope,
    event_type AS "table", 'u' || (user_id % 10) AS payer, event_type <> 'error' AS present, value FROM events),
perm AS (SELECT 'n' || c_nationkey AS owner, lower(c_mktsegment) AS name, list_sort(list_distinct(list('KEY' || (c_custkey % 50)))) AS keys,
    list_sort(list_distinct(list('r' || (c_custkey % 40) || '@' || lower(substr(c_mktsegment, 1, 4))))) AS accounts, max(c_custkey) AS block_num FROM customer GROUP BY 1, 2),
token AS (SELECT lower(c_mktsegment) AS code, 'c' || (c_custkey % 100) AS scope, 'USD' AS symbol, 2 AS "precision", c_acctbal AS amount, c_custkey AS version, c_acctbal < 0 AS gone FROM customer),
token_now AS (SELECT * FROM token QUALIFY row_number() OVER (PARTITION BY code, scope, symbol ORDER BY version DESC) = 1),
abi AS (SELECT 'k' || o_custkey AS account, {SLOT.format("o_orderdate")} AS block_num, o_orderkey AS version, o_orderstatus || ':' || o_orderpriority AS abi FROM orders),
block AS (SELECT CAST(floor({SLOT.format("ts")} / 7200) AS BIGINT) AS block_num, count(*) AS trx_count, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cpu_usage_us, max(event_id) AS last_event FROM events GROUP BY 1)
"""
