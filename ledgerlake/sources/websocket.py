"""A small websocket client (RFC 6455) on the standard library, and the recorder of a block feed."""

from __future__ import annotations

import base64
import hashlib
import os
import socket
import ssl
from collections.abc import Iterator
from urllib.parse import urlsplit

from ..codec import wire
from .feed import write_frames

ACCEPT_KEY = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
CONTINUATION, TEXT, BINARY, CLOSE, PING, PONG = 0, 1, 2, 8, 9, 10


class WebSocket:
    """A client connection: whole messages in, masked frames out."""

    def __init__(self, url: str, timeout: float = 30.0):
        at = urlsplit(url)
        secure = at.scheme == "wss"
        self.socket = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), timeout)
        if secure:
            self.socket = ssl.create_default_context().wrap_socket(self.socket, server_hostname=at.hostname)
        key = base64.b64encode(os.urandom(16)).decode()
        head = [f"GET {at.path or '/'}{'?' + at.query if at.query else ''} HTTP/1.1", f"Host: {at.netloc}", "Upgrade: websocket", "Connection: Upgrade", f"Sec-WebSocket-Key: {key}", "Sec-WebSocket-Version: 13"]
        self.socket.sendall("\r\n".join([*head, "", ""]).encode())
        self.stream = self.socket.makefile("rb")
        status = self.stream.readline().split()
        fields = {}
        while (line := self.stream.readline().strip()) != b"":
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        expected = base64.b64encode(hashlib.sha1((key + ACCEPT_KEY).encode()).digest()).decode()
        if status[1:2] != [b"101"] or fields.get("sec-websocket-accept") != expected:
            raise ConnectionError(f"no websocket at {url}: {status}")

    def _exactly(self, size: int) -> bytes:
        data = self.stream.read(size)
        if len(data) < size:
            raise ConnectionError("the connection ended in a frame")
        return data

    def send(self, data: bytes, kind: int = BINARY) -> None:
        size, mask = len(data), os.urandom(4)
        head = bytes([0x80 | kind]) + (bytes([0x80 | size]) if size < 126 else b"\xfe" + size.to_bytes(2, "big") if size < 1 << 16 else b"\xff" + size.to_bytes(8, "big"))
        pad = (mask * (size // 4 + 1))[:size]
        self.socket.sendall(head + mask + (int.from_bytes(data, "big") ^ int.from_bytes(pad, "big")).to_bytes(size, "big"))

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """(kind, data) of each message until the server closes; pings are answered."""
        kind, parts = TEXT, []
        while True:
            first = self.stream.read(1)
            if not first:
                return
            code, size = first[0] & 15, self._exactly(1)[0] & 127
            size = int.from_bytes(self._exactly(2 if size == 126 else 8), "big") if size > 125 else size
            data = self._exactly(size)
            if code == CLOSE:
                return
            if code == PING:
                self.send(data, PONG)
            elif code != PONG:
                kind = code if code != CONTINUATION else kind
                parts.append(data)
                if first[0] & 0x80:
                    yield kind, b"".join(parts)
                    parts = []

    def close(self) -> None:
        self.socket.close()


class FeedClient:
    """The protocol of the feed: a text message with its own schema first, then requests and results."""

    def __init__(self, url: str):
        self.socket = WebSocket(url)
        self.incoming = self.socket.messages()
        kind, self.announced = next(self.incoming)
        if kind != TEXT:
            raise ConnectionError("the feed did not announce its schema")

    def status(self) -> dict:
        self.socket.send(wire.status_request())
        return wire.result(next(self.incoming)[1])[1]

    def blocks(self, start: int, stop: int = 0, in_flight: int = 100, **wanted: bool) -> Iterator[bytes]:
        """Result frames from ``start`` to ``stop`` (inclusive; 0 follows the head); half of the credit is given back at a time."""
        end = stop + 1 if stop else 0xFFFFFFFF
        self.socket.send(wire.blocks_request(start, end, in_flight, **wanted))
        taken = 0
        for _, frame in self.incoming:
            yield frame
            taken += 1
            if taken * 2 >= in_flight:
                self.socket.send(wire.ack_request(taken))
                taken = 0
            if stop and (wire.result(frame)[1].get("this_block") or {}).get("block_num", -1) >= stop:
                return


def record(url: str, folder: str, start: int, stop: int = 0, frames_a_file: int = 1000, **wanted: bool) -> int:
    """Write the feed's frames to files that the ``block_feed`` source reads, in the order of arrival; returns their number.

    New files sort after those there, so a recorder that starts again goes on.
    """
    place = max((int(x.split(".")[0]) for x in os.listdir(folder) if x.split(".")[0].isdigit()), default=-1) + 1
    held: list[bytes] = []
    written = 0
    for frame in FeedClient(url).blocks(start, stop, **wanted):
        held.append(frame)
        if len(held) >= frames_a_file:
            write_frames(f"{folder}/{place:012d}", held)
            written, place, held = written + len(held), place + 1, []
    if held:
        write_frames(f"{folder}/{place:012d}", held)
    return written + len(held)
