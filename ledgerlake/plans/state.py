"""State queries over the latest rows of perm and token, and the chain's health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec.keys import normal_key
from . import filters, history

MOST, ACCOUNT_ACTIONS, ACCOUNT_PERMS = 1000, 20, 100
HEALTHY_LAG = 20


def get_key_accounts(perms: DataFrame, public_key: str) -> DataFrame:
    """Permissions that hold a key (in any form it may be written), by owner."""
    return perms.where(F.array_contains("keys", normal_key(public_key.strip()))).orderBy("owner", "name").limit(MOST)


def owners(found: DataFrame) -> DataFrame:
    """The distinct owners of the permissions found (after their cap)."""
    return found.select("owner").distinct().orderBy("owner")


def get_controlled_accounts(perms: DataFrame, account: str) -> DataFrame:
    found = perms.where(filters.any_starts_with(F.col("accounts"), f"{account}@"))
    return owners(found.orderBy("owner", "name").limit(MOST))


def get_tokens(tokens: DataFrame, account: str) -> DataFrame:
    mine = tokens.where(F.col("scope") == account).orderBy(F.col("amount").desc(), "code", "symbol").limit(MOST)
    return mine.select("symbol", "precision", "amount", F.col("code").alias("contract"))


def get_account(actions: DataFrame, tokens: DataFrame, perms: DataFrame, account: str) -> dict[str, DataFrame]:
    """Four frames that a client collects side by side: tokens, the last actions, their exact total, permissions."""
    mine = F.array_contains("notified", account)
    return {
        "tokens": get_tokens(tokens, account),
        "actions": history.page(actions.where(mine), [F.col("global_sequence").desc()], 0, ACCOUNT_ACTIONS),
        "total_actions": history.total(actions, mine, track=True),
        "permissions": perms.where(F.col("owner") == account).limit(ACCOUNT_PERMS),
    }


def get_health(blocks: DataFrame, chain_info: DataFrame) -> DataFrame:
    """The indexed height against the chain's head (one row: head, lib)."""
    last = blocks.agg(F.coalesce(F.max("block_num"), F.lit(0)).alias("last_indexed_block")).withColumn("k", F.lit(0))
    both = chain_info.withColumn("k", F.lit(0)).join(last, "k").drop("k")
    lag = F.greatest(F.col("head") - F.col("last_indexed_block"), F.lit(0))
    return both.withColumn("lag", lag).withColumn("status", F.when((F.col("head") > 0) & (lag < HEALTHY_LAG), F.lit("OK")).otherwise(F.lit("Warning")))


def describe() -> dict[str, str]:
    """What the service is, for the root route."""
    return {"name": "ledgerlake", "api": "history v1 and v2, state", "engine": "spark"}
