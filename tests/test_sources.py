import base64
import hashlib
import json
import socket
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from ledgerlake import samples as blobs
from ledgerlake.codec.cursor import Cursor, varuint32
from ledgerlake.sources import chain, feed, websocket


def plain(data, kind=2, last=True):
    size = bytes([len(data)]) if len(data) < 126 else b"\x7e" + len(data).to_bytes(2, "big")
    return bytes([(0x80 if last else 0) | kind]) + size + data


def serve_feed(frames, asked):
    """A feed that announces itself, answers a status request, then sends its frames and closes."""
    listener = socket.create_server(("127.0.0.1", 0))

    def message(stream):
        stream.read(1)
        size = stream.read(1)[0] & 127
        size = int.from_bytes(stream.read(2), "big") if size == 126 else size
        mask = stream.read(4)
        return bytes(b ^ mask[k % 4] for k, b in enumerate(stream.read(size)))

    def run():
        s, _ = listener.accept()
        stream = s.makefile("rb")
        key = ""
        while (line := stream.readline().strip()) != b"":
            if line.lower().startswith(b"sec-websocket-key:"):
                key = line.split(b":")[1].strip().decode()
        accept = base64.b64encode(hashlib.sha1((key + websocket.ACCEPT_KEY).encode()).digest()).decode()
        s.sendall(f"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode() + plain(b'{"version":"1"}', 1))
        asked.append(message(stream))
        if asked[-1] == b"\0":
            s.sendall(plain(varuint32(0) + blobs.position(100, "aa") + blobs.position(90, "bb") + bytes(16)))
            asked.append(message(stream))
        for k, f in enumerate(frames):
            s.sendall(plain(b"", 9) + plain(f[:50], 2, False) + plain(f[50:], 0) if k % 2 else plain(f))
        s.sendall(plain(b"", 8))
        while True:
            try:
                asked.append(message(stream))
            except (IndexError, OSError):
                return

    threading.Thread(target=run, daemon=True).start()
    return f"ws://127.0.0.1:{listener.getsockname()[1]}/"


def test_feed_client_and_recorder(tmp_path):
    frames, asked = [blobs.frame(40 + k, blobs.signed_block(k), [], []) for k in range(5)], []
    client = websocket.FeedClient(serve_feed(frames, asked))
    assert json.loads(client.announced) == {"version": "1"} and client.status()["head"]["block_num"] == 100
    assert list(client.blocks(40, 42, in_flight=2)) == frames[:3] and asked[1][1:9] == (40).to_bytes(4, "little") + (43).to_bytes(4, "little")
    assert websocket.record(serve_feed(frames, []), str(tmp_path), 40, frames_a_file=2) == 5
    assert [f for n in ("000000000000", "000000000001", "000000000002") for f in feed.read_frames(str(tmp_path / n))] == frames
    assert websocket.record(serve_feed(frames[:1], []), str(tmp_path), 45) == 1 and (tmp_path / "000000000003").exists()


def test_status_frame():
    with pytest.raises(ValueError):
        feed.feed_status(blobs.frame(1, None, [], []))
    with pytest.raises(ValueError):
        Cursor(b"").take(1)


@pytest.mark.parametrize("dialect", ["rest", "rpc"])
def test_chain_client(spark, dialect):
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            method = self.path.rsplit("/", 1)[-1] if dialect == "rest" else body["method"]
            params = body if dialect == "rest" else body["params"]
            calls.append(method)
            found = {"head_block_num": 100, "last_irreversible_block_num": "90"} if method == "get_info" else {"abi": blobs.TOKEN_ABI if params["account_name"] == "tok" else None}
            data = json.dumps(found if dialect == "rest" else {"result": found}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = chain.ChainClient(f"http://127.0.0.1:{server.server_port}", dialect)
    assert client.info() == {"head": 100, "lib": 90} == client.info() and calls == ["get_info"]
    assert json.loads(client.abi("tok"))["actions"][0]["name"] == "transfer" and client.abi("none") is None
    assert [r.account for r in client.fallback(spark, ["tok", "none"]).collect()] == ["tok"] and client.info_frame(spark).first().lib == 90
    server.shutdown()
    server.server_close()
    gone = chain.ChainClient("http://127.0.0.1:9", dialect, timeout=0.5)
    assert gone.info() is None and gone.abi("tok") is None and gone.info_frame(spark).first().head == 0
    with pytest.raises(ValueError):
        chain.ChainClient("x", "other")
