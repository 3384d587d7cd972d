"""A thin HTTP answer over an engine: POST /query, GET /health, with an optional bearer token."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from passagework.engine import Engine
from passagework.operators.rank import CloudRefused
from passagework.operators.scope import ScopeError

#: Fields of a request and their types.
FIELDS = {"text": str, "k": int, "pool": int, "ranker": str, "where": str, "links": bool, "neighbours": bool, "symbols": bool}


def checked(body: bytes) -> dict:
    """The fields of a request, or `ValueError` saying which is wrong."""
    try:
        asked = json.loads(body)
    except ValueError:
        raise ValueError("the body is not JSON") from None
    if not isinstance(asked, dict) or not isinstance(asked.get("text"), str) or not asked["text"].strip():
        raise ValueError("text is missing")
    for name, value in asked.items():
        if name not in FIELDS:
            raise ValueError(f"unknown field {name!r}")
        if not isinstance(value, FIELDS[name]) or FIELDS[name] is int and (isinstance(value, bool) or value < 1):
            raise ValueError(f"field {name!r} is not a {FIELDS[name].__name__}")
    return asked


def server(engine: Engine, port: int = 0, token: str | None = None) -> ThreadingHTTPServer:
    """A server on the loopback address; the caller runs and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _answer(self, code: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _allowed(self) -> bool:
            return token is None or hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {token}")

        def do_GET(self) -> None:
            self._answer(200, {"ok": True}) if self.path == "/health" else self._answer(404, {"error": "no such path"})

        def do_POST(self) -> None:
            if self.path != "/query":
                return self._answer(404, {"error": "no such path"})
            if not self._allowed():
                return self._answer(401, {"error": "the token is missing or wrong"})
            try:
                asked = checked(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                rows = engine.query(asked.pop("text"), **asked).orderBy("seq").collect()
            except (ValueError, ScopeError) as e:
                return self._answer(400, {"error": str(e)})
            except CloudRefused as e:
                return self._answer(403, {"error": str(e)})
            self._answer(200, [r.asDict(recursive=True) for r in rows])

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
