"""A Spark data source over recorded frames of the block feed: batch and streaming.

``spark.read.format("block_feed").load(folder)`` reads files of frames (each after its
length, four bytes, little-endian) as raw blocks. Options: ``startBlock`` (inclusive),
``stopBlock`` (inclusive, 0 for the head), ``fetchBlock``, ``fetchTraces``,
``fetchDeltas`` (false leaves a blob null), ``irreversibleOnly`` and, for streams,
``maxFilesPerTrigger`` (0 for all) and ``resumeFile``, the number of files that earlier
runs took, which the limit counts from. A file is a partition; names order the arrivals, so new files
must sort after those read. The arrival ordinal is the file's place times 2 ** 24 plus
the frame's place in it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..codec import wire
from ..operators.ingest import RAW

FRAME_BITS = 14


def write_frames(path: str, frames: list[bytes]) -> None:
    """Record frames; the file appears whole or not at all."""
    with open(f"{path}.part", "wb") as f:
        for frame in frames:
            f.write(len(frame).to_bytes(4, "little") + frame)
    os.replace(f"{path}.part", path)


def read_frames(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while len(head := f.read(4)) == 4:
            frame = f.read(int.from_bytes(head, "little"))
            if len(frame) < int.from_bytes(head, "little"):
                raise EOFError(f"{path} ends in a frame")
            yield frame


class FilePart(InputPartition):
    def __init__(self, place: int, path: str):
        super().__init__(place)
        self.place, self.path = place, path


class _Frames:
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.first, self.last = int(options.get("startBlock", 0)), int(options.get("stopBlock", 0))
        on = lambda key, default: options.get(key, default).lower() == "true"
        self.blobs = [on("fetchBlock", "true"), on("fetchTraces", "true"), on("fetchDeltas", "true")]
        self.irreversible = on("irreversibleOnly", "false")
        self.most, self.resume = int(options.get("maxFilesPerTrigger", 0)), int(options.get("resumeFile", 0))

    def files(self) -> list[tuple[int, str]]:
        """Number and name of each file: the number that names it, or its place if not all names are numbers."""
        names = sorted(x for x in os.listdir(self.folder) if not x.endswith(".part"))
        stems = [x.split(".")[0] for x in names]
        if all(x.isdigit() for x in stems):
            return sorted((int(stem), name) for stem, name in zip(stems, names, strict=True))
        return list(enumerate(names))

    def rows(self, part: FilePart) -> Iterator[tuple]:
        for k, frame in enumerate(read_frames(part.path)):
            if k >> FRAME_BITS:
                raise ValueError(f"{part.path} has more than {1 << FRAME_BITS} frames")
            kind, r = wire.result(frame)
            this, prev = r.get("this_block"), r.get("prev_block") or {}
            if kind != "blocks" or not this or this["block_num"] < self.first or (self.last and this["block_num"] > self.last) or (self.irreversible and this["block_num"] > r["lib"]["block_num"]):
                continue
            blobs = [r[name] if wanted else None for name, wanted in zip(("block", "traces", "deltas"), self.blobs, strict=True)]
            yield (part.place << FRAME_BITS | k, this["block_num"], this["block_id"], prev.get("block_id"), r["head"]["block_num"], r["lib"]["block_num"], *blobs)


class FeedReader(_Frames, DataSourceReader):
    def partitions(self) -> list[FilePart]:
        return [FilePart(k, os.path.join(self.folder, x)) for k, x in self.files()]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        return self.rows(partition)


class FeedStream(_Frames, DataSourceStreamReader):
    """Offsets are file numbers; a batch takes at most ``maxFilesPerTrigger`` files."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.at = self.resume

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        later = [k for k, _ in self.files() if k >= self.at]
        if later:
            self.at = (later[: self.most] if self.most else later)[-1] + 1
        return {"files": self.at}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        self.at = max(self.at, end["files"])
        return [FilePart(k, os.path.join(self.folder, x)) for k, x in self.files() if start["files"] <= k < end["files"]]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Files stay: recorded feeds are kept."""


class BlockFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_feed"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockFeed)


def feed_status(frame: bytes) -> dict:
    """What a status frame says of the feed: head, last irreversible block and the ranges it serves."""
    kind, status = wire.result(frame)
    if kind != "status":
        raise ValueError("not a status frame")
    return status
