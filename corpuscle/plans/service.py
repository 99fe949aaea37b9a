"""A thin HTTP service over a search engine, and a client of it."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from . import validate
from .engine import SearchEngine


def answer(engine: SearchEngine | None, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and JSON of a request: ``GET /api/health`` and ``POST /api/search`` with ``{query, k}``.

    503 while there is no engine, 422 for a request that is not allowed, 400 for a blank query, 404 elsewhere.
    """
    if (method, path) not in (("GET", "/api/health"), ("POST", "/api/search")):
        return 404, {"detail": "Not Found"}
    if engine is None:
        return 503, {"detail": "Engine still starting up"}
    if method == "GET":
        state = engine.status().first().asDict()
        return 200, state | {"methods": engine.methods}
    try:
        asked = json.loads(body)
        query, k = asked["query"], asked.get("k", validate.DEFAULT_K)
        if not isinstance(query, str) or not isinstance(k, int) or isinstance(k, bool):
            raise ValueError("query is a text and k a whole number")
        if 1 <= len(query) <= validate.MAX_QUERY and not query.strip():
            return 400, {"detail": "Query must not be empty"}
        query = validate.check(query, k)
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return 422, {"detail": str(e)}
    return 200, engine.search(query, k)


def serve(engine: Callable[[], SearchEngine | None], host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is not started yet; ``engine`` gives the engine, or None while it is being built."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = answer(engine(), method, self.path, body)
            raw = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            self._reply("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._reply("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def ask(base: str, path: str, body: dict | None = None) -> dict:
    """A request's JSON. Raises RuntimeError with the error's ``detail``, or ``Request failed (status)`` without one."""
    raw = None if body is None else json.dumps(body).encode()
    try:
        with urlopen(Request(base + path, raw, {"Content-Type": "application/json"})) as got:
            return json.loads(got.read())
    except HTTPError as e:
        try:
            detail = json.loads(e.read())["detail"]
        except (ValueError, KeyError, TypeError):
            detail = f"Request failed ({e.code})"
        raise RuntimeError(detail) from e
