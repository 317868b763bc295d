"""The query routes over HTTP, from the standard library.

GET /v2/history/{get_actions, get_transaction, get_deltas, get_abi_snapshot,
get_created_accounts, get_creator}, /v2/state/{get_key_accounts, get_tokens,
get_account}, /v2/health, /; POST /v1/history/{get_actions, get_transaction,
get_key_accounts, get_controlled_accounts}.
"""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from collections.abc import Callable
from urllib.parse import parse_qsl, urlsplit

import pyspark
from pyspark.sql import DataFrame

from .plans import filters, history, state


class NotFound(LookupError):
    """Nothing by that name or id."""


class Service:
    """Routes to plans; ``tables`` gives a logical table by name, ``chain`` one row of head and lib, or a function that makes it anew."""

    def __init__(self, tables, chain: DataFrame | Callable[[], DataFrame], max_limit: int = filters.MAX_LIMIT):
        self.tables, self.standing, self.max_limit = tables, chain, max_limit

    @property
    def chain(self) -> DataFrame:
        return self.standing() if callable(self.standing) else self.standing

    def lib(self) -> int:
        row = self.chain.first()
        return row.lib if row else 0

    @staticmethod
    def rows(found: DataFrame) -> list[dict]:
        """Results here are capped by their plans."""
        return [json.loads(x) for x in found.toJSON().collect()]

    def handle(self, path: str, args: dict[str, str]) -> dict:
        began = time.monotonic()
        route = {
            "/": lambda: state.describe(), "/v2/health": self.health,
            "/v2/history/get_actions": self.actions, "/v2/history/get_transaction": self.transaction, "/v2/history/get_deltas": self.deltas, "/v2/history/get_abi_snapshot": self.abi,
            "/v2/history/get_created_accounts": self.created, "/v2/history/get_creator": self.creator,
            "/v2/state/get_key_accounts": self.key_accounts, "/v2/state/get_tokens": self.tokens, "/v2/state/get_account": self.account,
            "/v1/history/get_actions": self.v1_actions, "/v1/history/get_transaction": self.v1_transaction, "/v1/history/get_key_accounts": self.v1_key_accounts, "/v1/history/get_controlled_accounts": self.v1_controlled,
        }.get(path)
        if route is None:
            raise NotFound(path)

        found = route(args) if path != "/" else route()
        return found | {"query_time_ms": round((time.monotonic() - began) * 1000, 3)}

    @staticmethod
    def needed(args: dict, name: str) -> str:
        if name not in args:
            raise filters.BadRequest(f"{name} is missing")
        return args[name]

    def actions(self, args: dict) -> dict:
        wanted = {k: args[k] for k in ("account", "filter", "after", "before") if k in args}
        transfer = {k.removeprefix("transfer."): v for k, v in args.items() if k.startswith("transfer.")}
        table = self.tables("action")
        found = history.get_actions(table, args.get("sort", "desc"), int(args.get("skip", 0)), min(filters.limit_of(int(args["limit"]) if "limit" in args else None), self.max_limit), transfer=transfer, **wanted)
        total = self.rows(history.total(table, history.action_filter(transfer=transfer, **wanted), args.get("track") == "true"))[0]
        lib, simple = self.lib(), args.get("simple") == "true"
        rows = self.rows(history.simple(found, lib) if simple else found)
        return {"cached": False, "lib": lib, "total": total, "simple_actions" if simple else "actions": rows}

    def transaction(self, args: dict) -> dict:
        rows = self.rows(history.get_transaction(self.tables("action"), self.needed(args, "id")))
        return {"executed": bool(rows), "trx_id": args["id"], "lib": self.lib(), "actions": rows}

    def deltas(self, args: dict) -> dict:
        equal = {k: args[k] for k in ("code", "scope", "table", "payer") if k in args} | ({"present": args["present"] == "true"} if "present" in args else {})
        found = history.get_deltas(self.tables("delta"), args.get("sort", "desc"), int(args.get("skip", 0)), int(args["limit"]) if "limit" in args else None, args.get("after"), args.get("before"), **equal)
        return {"deltas": self.rows(found)}

    def abi(self, args: dict) -> dict:
        rows = self.rows(history.get_abi_snapshot(self.tables("abi"), self.needed(args, "contract"), int(args["block"]) if "block" in args else None))
        return {"present": bool(rows)} | ({"block_num": rows[0]["block_num"], "abi": json.loads(rows[0]["abi"])} if rows else {})

    def created(self, args: dict) -> dict:
        return {"accounts": self.rows(history.get_created_accounts(self.tables("action"), self.needed(args, "account")))}

    def creator(self, args: dict) -> dict:
        rows = self.rows(history.get_creator(self.tables("action"), self.needed(args, "account")))
        if not rows:
            raise NotFound(args["account"])
        return rows[0]

    def key_accounts(self, args: dict) -> dict:
        rows = self.rows(state.get_key_accounts(self.tables("perm"), self.needed(args, "public_key")))
        return {"account_names": sorted({r["owner"] for r in rows}), "permissions": rows}

    def tokens(self, args: dict) -> dict:
        return {"account": self.needed(args, "account"), "tokens": self.rows(state.get_tokens(self.tables("token"), args["account"]))}

    def account(self, args: dict) -> dict:
        parts = state.get_account(self.tables("action"), self.tables("token"), self.tables("perm"), self.needed(args, "account"))
        found = {k: self.rows(v) for k, v in parts.items()}
        return {"account": args["account"], "lib": self.lib()} | found | {"total_actions": found["total_actions"][0]["value"]}

    def health(self, args: dict) -> dict:
        row = self.rows(state.get_health(self.tables("action"), self.chain))[0]
        return {"version": pyspark.__version__, "health": row}

    def v1_actions(self, args: dict) -> dict:
        found = history.v1_get_actions(self.tables("action"), self.needed(args, "account_name"), int(args.get("pos", -1)), int(args.get("offset", -20)))
        return {"last_irreversible_block": self.lib(), "actions": self.rows(found)}

    def v1_transaction(self, args: dict) -> dict:
        rows = self.rows(history.v1_get_transaction(self.tables("action"), self.needed(args, "id")))
        if not rows:
            raise NotFound(args["id"])
        return {"id": rows[0]["id"], "block_num": rows[0]["block_num"], "last_irreversible_block": self.lib(), "traces": rows}

    def v1_key_accounts(self, args: dict) -> dict:
        return {"account_names": self.key_accounts(args)["account_names"]}

    def v1_controlled(self, args: dict) -> dict:
        return {"controlled_accounts": [r["owner"] for r in self.rows(state.get_controlled_accounts(self.tables("perm"), self.needed(args, "controlling_account")))]}


def server(service: Service, host: str = "127.0.0.1", port: int = 7000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, args: dict) -> None:
            try:
                status, body = 200, service.handle(urlsplit(self.path).path, args)
            except NotFound as e:
                status, body = 404, {"error": f"not found: {e}"}
            except (filters.BadRequest, ValueError) as e:
                status, body = 400, {"error": str(e)}
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.answer(dict(parse_qsl(urlsplit(self.path).query)))

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                args = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                args = {}
            self.answer({k: str(v) for k, v in args.items()} if isinstance(args, dict) else {})

        def log_message(self, *args) -> None:
            """Quiet."""

    return ThreadingHTTPServer((host, port), Handler)


