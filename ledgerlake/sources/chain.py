"""The chain's own HTTP interface: its head, and contracts' present schemas."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession

from ..codec.schema import SECTIONS, to_json

#: How long an answer, or a failure, is taken as the present one.
FRESH_S = 2.0


class ChainClient:
    """Two dialects: ``rest`` posts to a path each, ``rpc`` posts JSON-RPC to one address."""

    def __init__(self, url: str, dialect: str = "rest", timeout: float = 10.0):
        if dialect not in ("rest", "rpc"):
            raise ValueError(f"unknown dialect {dialect!r}")
        self.url, self.dialect, self.timeout = url.rstrip("/"), dialect, timeout
        self.known: tuple[float, dict | None] = (-FRESH_S, None)

    def call(self, method: str, params: dict) -> dict:
        rest = self.dialect == "rest"
        body = params if rest else {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
        request = urllib.request.Request(f"{self.url}/v1/chain/{method}" if rest else self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.load(answer)
        if rest:
            return found
        if found.get("error"):
            raise ConnectionError(str(found["error"]))
        return found["result"]

    def info(self) -> dict | None:
        """Head and last irreversible block; None if the chain does not answer. Either is kept for two seconds."""
        if time.monotonic() - self.known[0] >= FRESH_S:
            try:
                found = self.call("get_info", {})
                value = {"head": int(found["head_block_num"]), "lib": int(found["last_irreversible_block_num"])}
            except (OSError, ValueError, KeyError):
                value = None
            self.known = (time.monotonic(), value)
        return self.known[1]

    def abi(self, account: str) -> str | None:
        """A contract's present schema as JSON text; None without one."""
        try:
            found = self.call("get_abi", {"account_name": account}).get("abi")
        except OSError:
            return None
        return to_json({k: found.get(k) or ("" if k == "version" else []) for k in SECTIONS}) if found else None

    def info_frame(self, spark: SparkSession) -> DataFrame:
        """One row of head and lib, zeros if unknown."""
        found = self.info() or {"head": 0, "lib": 0}
        return spark.createDataFrame([(found["head"], found["lib"])], "head long, lib long")

    def fallback(self, spark: SparkSession, accounts: list[str]) -> DataFrame:
        """(account, abi) of the named contracts, as ``ingest.block_tables`` takes it."""
        return spark.createDataFrame([(a, x) for a in accounts if (x := self.abi(a)) is not None], "account string, abi string")
