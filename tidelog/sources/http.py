"""HTTP adapter, both sides.

POST /api/events takes INSERT text, GET /api/admin tells statistics. Between stores,
POST /streams/{stream}/events takes forwarded rows ({"rows": [...]}) and POST
/streams/{stream}/register answers with the stream's migration. :func:`post` is the client.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import DataFrame

from ..lang.errors import ConstraintError, LanguageError
from ..store import EventStore


def answer(store: EventStore, method: str, path: str, body: str = "") -> tuple[int, object]:
    """Status and JSON body of a request."""
    if (method, path) == ("POST", "/api/events"):
        try:
            results = store.create_events(body)
        except (LanguageError, ConstraintError) as e:
            return 400, {"error": str(e)}
        return 200, [[json.loads(r) for r in x.toJSON().collect()] if isinstance(x, DataFrame) else {"count": x} for x in results]
    if (method, path) == ("GET", "/api/admin"):
        return 200, store.all_stream_stats()
    if method == "POST" and (to := re.fullmatch("/streams/([^/]+)/(events|register)", path)):
        stream = unquote(to[1])
        if stream not in store.config.streams:
            return 404, {"error": f"no stream {stream}"}
        if to[2] == "register":
            return 200, {"migration": store.config.streams[stream].migration}
        try:
            return 200, {"count": store.receive_rows(stream, json.loads(body)["rows"])}
        except (LanguageError, ConstraintError, KeyError, ValueError) as e:
            return 400, {"error": str(e)}
    return 404, {"error": "not found"}


def post(url: str, path: str, body: object, timeout: float = 60) -> tuple[int, object]:
    """Status and JSON body of a POST; 503 where nobody answers."""
    data = b"" if body is None else json.dumps(body, default=str).encode()
    request = urllib.request.Request(url.rstrip("/") + path, data, {"Content-Type": "application/json"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answered:
            return answered.status, json.loads(answered.read() or b"null")
    except urllib.error.HTTPError as e:
        return e.code, None
    except OSError:
        return 503, None


def server(store: EventStore, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _serve(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, body = answer(store, self.command, self.path, self.rfile.read(size).decode())
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _serve

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
