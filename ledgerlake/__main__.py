"""``python -m ledgerlake``: record a feed, index it, answer queries over its tables, ask a feed for its status."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .serve import Service, server
from .sources import config as configuration
from .sources import websocket
from .sources.chain import ChainClient
from .streaming import runner
from .streaming.store import Store


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ledgerlake", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("index", "follow the recorded feed into the tables"), ("serve", "answer queries over HTTP")):
        command = commands.add_parser(name, help=what)
        command.add_argument("config")
        if name == "index":
            command.add_argument("--bounded", action="store_true", help="take what the feed has now, then end")
    status = commands.add_parser("status", help="print what a feed says of itself")
    status.add_argument("url")
    status.add_argument("--schema", action="store_true", help="the announced schema instead")
    record = commands.add_parser("record", help="write a feed's frames to files for the index command")
    record.add_argument("url")
    record.add_argument("folder")
    record.add_argument("--start", type=int, default=1)
    record.add_argument("--stop", type=int, default=0)
    options = parser.parse_args(args)
    if options.command == "status":
        client = websocket.FeedClient(options.url)
        print(client.announced.decode() if options.schema else json.dumps(client.status()))
    elif options.command == "record":
        print(websocket.record(options.url, options.folder, options.start, options.stop))
    else:
        tables(options)


def tables(options: argparse.Namespace) -> None:
    config = configuration.load(options.config)
    spark = SparkSession.builder.appName("ledgerlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if options.command == "index":
        spark.streams.addListener(runner.Throughput())
        runner.start(spark, config, bounded=options.bounded).awaitTermination()
    else:
        store = Store(spark, config.table("").rstrip("/"))
        client = ChainClient(config.chain.http, config.chain.dialect) if config.chain.http else None
        standing = lambda: standing_of(store, client.info() if client else None)
        server(Service(store.table, standing, config.api.max_limit), config.api.host, config.api.port).serve_forever()


def standing_of(store: Store, info: dict | None) -> DataFrame:
    """Head and last irreversible block by the chain; without it by what is stored, and then no block counts as irreversible."""
    if info:
        return store.spark.createDataFrame([(info["head"], info["lib"])], "head long, lib long")
    return store.progress().selectExpr("coalesce(max(block_num), 0) AS head", "0L AS lib")


if __name__ == "__main__":
    main()
