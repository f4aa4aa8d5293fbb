"""Serving a log to others, and reading one that is served.

``Server`` and ``client`` work over any transport of messages. One comes along: TCP, on which a request
or event is its length in four bytes and then its bytes, and an error its name at length 2**32 - 1.
``RemoteLog`` reads a log that is served so as a streaming source.
"""

from __future__ import annotations

import socket
import socketserver
import struct
import threading
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from threading import Event

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from logweir.errors import HeadReached, Stopped
from logweir.functions import wire
from logweir.options import StreamOptions

#: Opens a stream of rows (id, type, foreign_id, timestamp, metadata, trace) behind a cursor.
Opener = Callable[[str, StreamOptions], Iterable[tuple]]


class Server:
    """Answers requests with event messages until it is stopped."""

    def __init__(self, open_stream: Opener):
        self.open_stream, self.stopping = open_stream, Event()

    def stop(self) -> None:
        if self.stopping.is_set():
            raise RuntimeError("already stopped")
        self.stopping.set()

    def stream(self, request: bytes) -> Iterator[bytes]:
        after, options = wire.request_from_wire(request)
        if self.stopping.is_set():
            raise Stopped
        for i, kind, foreign_id, at, metadata, trace in self.open_stream(after, options):
            if self.stopping.is_set():
                raise Stopped
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            yield wire.event_to_wire(wire.WireEvent(str(i), kind, foreign_id, at, metadata or b"", trace or b""))


def client(call: Callable[[bytes], Iterable[bytes]]) -> Opener:
    """A stream opener over a call that sends a request and yields messages."""

    def open_stream(after: str, options: StreamOptions = StreamOptions()) -> Iterator[tuple[str, int, str, datetime, bytes, bytes]]:
        for raw in call(wire.request_to_wire(after, options)):
            e = wire.event_from_wire(raw)
            yield e.id, e.type, e.foreign_id, e.timestamp, e.metadata, e.trace

    return open_stream


_ERROR = 0xFFFFFFFF
#: Errors that are passed on to clients as what they are, and bytes that a slow client may lag behind.
_NAMED, BUFFER = {"Stopped": Stopped, "HeadReached": HeadReached}, 64 * 1024


def _send(out, raw: bytes, error: bool = False) -> None:
    out.write(struct.pack(">I", _ERROR) * error + struct.pack(">I", len(raw)) + raw)
    out.flush()


def _receive(source) -> bytes | None:
    head = source.read(4)
    if len(head) < 4:
        return None
    size = struct.unpack(">I", head)[0]
    if size == _ERROR:
        text = source.read(struct.unpack(">I", source.read(4))[0]).decode()
        raise _NAMED.get(text, RuntimeError)(text)
    return source.read(size)


class TcpServer:
    """Serves over TCP on threads of its own, until it is stopped. A client that does not read holds
    up its own stream alone, once the buffers are full."""

    def __init__(self, server: Server, host: str = "127.0.0.1", port: int = 0):
        class Handler(socketserver.StreamRequestHandler):
            def handle(self):
                self.connection.setsockopt(socket.SOL_SOCKET, socket.SO_SNDBUF, BUFFER)
                try:
                    request = _receive(self.rfile)
                    for message in server.stream(request) if request is not None else ():
                        _send(self.wfile, message)
                except (BrokenPipeError, ConnectionResetError):
                    return
                except Exception as e:
                    _send(self.wfile, type(e).__name__.encode(), error=True)

        class Listener(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        self.server, self.listener = server, Listener((host, port), Handler)
        self.address = self.listener.server_address
        threading.Thread(target=self.listener.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self.server.stop()
        self.listener.shutdown()
        self.listener.server_close()


def tcp_call(host: str, port: int) -> Callable[[bytes], Iterator[bytes]]:
    """The call that ``client`` needs, over TCP."""

    def call(request: bytes) -> Iterator[bytes]:
        with socket.create_connection((host, port)) as connection, connection.makefile("rwb") as both:
            connection.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, BUFFER)
            _send(both, request)
            while (message := _receive(both)) is not None:
                yield message

    return call


class RemoteLog(DataSource):
    """Options: host, port, after, pageSize. Each trigger reads a page, or to the head."""

    @classmethod
    def name(cls) -> str:
        return "remotelog"

    def schema(self) -> str:
        return "id string, type int, foreign_id string, timestamp timestamp, metadata binary, trace binary"

    def simpleStreamReader(self, schema):
        return _RemoteReader(self.options)


class _RemoteReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.call = tcp_call(options["host"], int(options["port"]))
        self.after, self.size = options.get("after", ""), int(options.get("pageSize") or 1000)

    def initialOffset(self) -> dict:
        return {"after": self.after}

    def _rows(self, after: str, stop: Callable[[int, str], bool]) -> tuple[list[tuple], str]:
        rows, cursor = [], after
        try:
            for row in client(self.call)(after, StreamOptions(to_head=True)):
                rows.append(row)
                cursor = row[0]
                if stop(len(rows), cursor):
                    break
        except HeadReached:
            pass
        return rows, cursor

    def read(self, start: dict):
        rows, cursor = self._rows(start["after"], lambda n, _: n >= self.size)
        return iter(rows), {"after": cursor}

    def readBetweenOffsets(self, start: dict, end: dict):
        if start["after"] == end["after"]:
            return iter([])
        return iter(self._rows(start["after"], lambda _, cursor: cursor == end["after"])[0])
