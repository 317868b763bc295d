"""History queries over the tables action, delta and abi."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

TRACK_LIMIT = 10_000
TRANSACTION_LIMIT = 1000
CREATED_LIMIT = 100
SIMPLE = ("block", "irreversible", "timestamp", "transaction_id", "actors", "notified", "contract", "action", "data")


def action_filter(account: str | None = None, filter: str | None = None, after: str | None = None, before: str | None = None, transfer: dict[str, str] | None = None) -> Column:
    """``transfer`` may hold from, to, symbol (equal) and memo (any token in common)."""
    parts: list[Column] = []
    if account is not None:
        parts.append(F.array_contains("notified", account))
    if filter:
        parts.append(filters.pairs(filter))
    for key, value in (transfer or {}).items():
        field = F.col(f"`@transfer`.{key}")
        parts.append(filters.has_any_token(field, value) if key == "memo" else field == value)
    if after is not None:
        parts.append(filters.boundary(after, True))
    if before is not None:
        parts.append(filters.boundary(before, False))
    return filters.every(parts)


def page(rows: DataFrame, order: list[Column], skip: int = 0, limit: int | None = None, most: int = filters.MAX_LIMIT) -> DataFrame:
    """A stretch of the sorted rows: a top-k that never sorts all of them."""
    return rows.orderBy(*order).offset(skip).limit(filters.limit_of(limit, most))


def get_actions(actions: DataFrame, sort: str = "desc", skip: int = 0, limit: int | None = None, postings: DataFrame | None = None, account: str | None = None, **wanted) -> DataFrame:
    """Filtered actions by global sequence. With a posting table an account is an equality on it and a semi-join."""
    if sort not in ("asc", "desc"):
        raise filters.BadRequest(f"sort {sort!r}")
    if postings is not None and account is not None:
        mine = postings.where(F.col("account") == account).select("global_sequence")
        found = actions.join(mine, "global_sequence", "left_semi").where(action_filter(**wanted))
    else:
        found = actions.where(action_filter(account, **wanted))
    key = F.col("global_sequence")
    return page(found, [key.asc() if sort == "asc" else key.desc()], skip, limit).withColumn("timestamp", F.col("`@timestamp`"))


def simple(found: DataFrame, lib: int) -> DataFrame:
    """Eight plain fields of each action."""
    return found.select(
        F.col("block_num").alias("block"),
        (F.col("block_num") <= lib).alias("irreversible"),
        "timestamp",
        F.col("trx_id").alias("transaction_id"),
        F.array_join(F.transform("act.authorization", lambda a: F.concat(a["actor"], F.lit("@"), a["permission"])), ",").alias("actors"),
        F.array_join("notified", ",").alias("notified"),
        F.col("act.account").alias("contract"),
        F.col("act.name").alias("action"),
        F.col("act.data").alias("data"),
    )


def total(rows: DataFrame, condition: Column, track: bool = False) -> DataFrame:
    """How many rows match: exactly, or up to the tracking limit."""
    found = rows.where(condition)
    counted = (found if track else found.limit(TRACK_LIMIT + 1)).agg(F.count(F.lit(1)).alias("n"))
    if track:
        return counted.select(F.col("n").alias("value"), F.lit("eq").alias("relation"))
    return counted.select(F.least("n", F.lit(TRACK_LIMIT)).cast("long").alias("value"), F.when(F.col("n") > TRACK_LIMIT, F.lit("gte")).otherwise(F.lit("eq")).alias("relation"))


def get_transaction(actions: DataFrame, trx_id: str) -> DataFrame:
    return actions.where(F.col("trx_id") == trx_id.lower()).orderBy("global_sequence").limit(TRANSACTION_LIMIT)


def get_deltas(deltas: DataFrame, sort: str = "desc", skip: int = 0, limit: int | None = None, after: str | None = None, before: str | None = None, **equal) -> DataFrame:
    """Row changes by block; code, scope, table, payer and present are equalities."""
    parts = [F.col(k) == v for k, v in equal.items()]
    parts += [filters.boundary(after, True)] if after is not None else []
    parts += [filters.boundary(before, False)] if before is not None else []
    way = (lambda c: c.asc()) if sort == "asc" else (lambda c: c.desc())
    return page(deltas.where(filters.every(parts)), [way(F.col("block_num")), way(F.col("ordinal"))], skip, limit)


def get_abi_snapshot(abis: DataFrame, contract: str, block: int | None = None) -> DataFrame:
    """The schema of a contract in force at a block; no row if there was none."""
    found = abis.where(F.col("account") == contract)
    return (found if block is None else found.where(F.col("block_num") <= block)).orderBy(F.col("block_num").desc()).limit(1)


def _new_accounts(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("act.name") == "newaccount").withColumn("name", F.coalesce("`@newaccount`.newact", F.get_json_object("act.data", "$.newact"), F.get_json_object("act.data", "$.name")))


def get_created_accounts(actions: DataFrame, creator: str) -> DataFrame:
    found = _new_accounts(actions).where(F.col("`@newaccount`.creator") == creator)
    return page(found, [F.col("global_sequence").desc()], 0, CREATED_LIMIT).select("name", "trx_id", F.col("`@timestamp`").alias("timestamp"))


def get_creator(actions: DataFrame, account: str) -> DataFrame:
    """Who created an account: its earliest newaccount, on any contract."""
    found = _new_accounts(actions).where(F.col("`@newaccount`.newact") == account)
    return page(found, [F.col("global_sequence").asc()], 0, 1).select(F.lit(account).alias("account"), F.col("`@newaccount`.creator").alias("creator"), "block_num", "trx_id", F.col("`@timestamp`").alias("timestamp"))


# the older routes

V1_MOST = 1000


def v1_get_actions(actions: DataFrame, account: str, pos: int = -1, offset: int = -20) -> DataFrame:
    """The last ``|offset|`` actions in ascending order if ``pos`` is negative, else ``offset`` from ``pos`` on.

    ``account_action_seq`` counts from ``pos``, or from 0 at a negative one.
    """
    mine = actions.where(F.array_contains("notified", account))
    if pos < 0:
        last = page(mine, [F.col("global_sequence").desc()], 0, min(abs(offset), V1_MOST))
        found, first = last, 0
    else:
        found, first = page(mine, [F.col("global_sequence").asc()], pos, max(1, min(offset, V1_MOST))), pos
    # at most V1_MOST rows: one task numbers them
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("global_sequence")) - 1 + first
    return found.select(F.col("global_sequence").alias("global_action_seq"), number.cast("long").alias("account_action_seq"), "block_num", F.col("`@timestamp`").alias("block_time"), "trx_id", F.col("act.account").alias("account"), F.col("act.name").alias("name"), F.col("receipts")[0]["receiver"].alias("receipt_receiver")).orderBy("global_action_seq")


def v1_get_transaction(actions: DataFrame, trx_id: str) -> DataFrame:
    """The traces of a transaction, each with its first receipt."""
    return get_transaction(actions, trx_id).select(F.col("trx_id").alias("id"), "block_num", F.col("`@timestamp`").alias("block_time"), "global_sequence", F.col("act.account").alias("account"), F.col("act.name").alias("name"), F.col("receipts")[0]["global_sequence"].alias("receipt_sequence"))
