"""Configuration from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Chain:
    name: str = "chain"
    system_account: str = "eosio"
    #: The node's HTTP interface, which knows head and last irreversible block; none if empty.
    http: str = ""
    dialect: str = "rest"


@dataclass(frozen=True)
class Indexer:
    start_block: int | None = None
    stop_block: int = 0
    fetch_block: bool = True
    fetch_traces: bool = True
    fetch_deltas: bool = True
    max_files_per_trigger: int = 100
    flush_interval_ms: int = 500
    skip_actions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Api:
    host: str = "127.0.0.1"
    port: int = 7000
    max_limit: int = 1000


@dataclass(frozen=True)
class Config:
    feed: str
    warehouse: str
    chain: Chain = field(default_factory=Chain)
    indexer: Indexer = field(default_factory=Indexer)
    api: Api = field(default_factory=Api)

    def table(self, kind: str) -> str:
        """The folder of one of the chain's tables."""
        return f"{self.warehouse.rstrip('/')}/{self.chain.name}/{kind}"


SECTIONS = {"chain": Chain, "indexer": Indexer, "api": Api}


def load(path: str) -> Config:
    """Unknown keys are errors: they are misspelt ones."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    for name, kind in SECTIONS.items():
        section = raw.get(name, {})
        unknown = set(section) - {x.name for x in fields(kind)}
        if unknown:
            raise ValueError(f"unknown keys in [{name}]: {sorted(unknown)}")
        raw[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in section.items()})
    config = Config(**raw)
    if config.indexer.max_files_per_trigger < 1 or config.indexer.flush_interval_ms < 1:
        raise ValueError("max_files_per_trigger and flush_interval_ms must be positive")
    return config
