"""An HTTP service: ``/sparql`` answers a query, ``/nextresult`` hands out its rows one by one."""

from __future__ import annotations

import json
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine, QueryResult
from .sparql.lexer import SparqlSyntaxError


class Closed(LookupError):
    """A result that is not open: unknown, or closed to make room for others."""


class _Open:
    def __init__(self, result: QueryResult, began: float):
        self.result, self.rows, self.began = result, result.terms() if result.form != "ASK" else iter([]), began
        self.lock = threading.Lock()
        self.done = False


class Service:
    """Queries of one engine. An open result has an id of its own and is kept until its last row is taken.

    Asking by the query's text is for clients that know no ids; it is refused where several results of that text are open.
    """

    def __init__(self, engine: Engine, most_open: int = 64):
        self.engine, self.most_open = engine, most_open
        self.open: dict[str, _Open] = {}
        self.of_text: dict[str, list[str]] = {}
        #: Ids of results that were read to the end, the last ones.
        self.done: dict[str, list[str]] = {}
        self.lock = threading.Lock()

    def sparql(self, query: str, blocking: bool = True) -> dict:
        """The whole result; or, not blocking, its first row and an ``id``, the others by ``next_result``."""
        if blocking:
            return {**self.engine.query(query).to_dict(), "querytriples": _triples(query)}
        began = time.perf_counter()
        result = self.engine.query(query)
        if result.form == "ASK":
            return {**result.to_dict(), "querytriples": _triples(query)}
        key = uuid.uuid4().hex
        with self.lock:
            while len(self.open) >= self.most_open:
                self._close(next(iter(self.open)))
            self.open[key] = _Open(result, began)
            self.of_text.setdefault(query, []).append(key)
        first = self.next_result(id=key)
        return {"id": key, "vars": result.vars, "querytriples": _triples(query), "result": first["result"], "execTime": time.perf_counter() - began, "firstResult": first["time"], "totalRows": len(first["result"])}

    def _close(self, key: str) -> None:
        self.open.pop(key, None)
        for text, ids in list(self.of_text.items()):
            if key in ids:
                ids.remove(key)
                if not ids:
                    del self.of_text[text]
                return

    def _find(self, query: str, id: str | None) -> _Open | list[str]:
        """The open result, or the variables of one that was read to its end."""
        with self.lock:
            if id is None:
                ids = self.of_text.get(query, [])
                if len(ids) > 1:
                    raise Closed("several results of this query are open: ask by id")
                id = ids[0] if ids else "text " + query
            if id in self.open:
                return self.open[id]
            if id in self.done:
                return self.done[id]
        raise Closed("no such result is open; it may have been closed to make room for others")

    def next_result(self, query: str = "", id: str | None = None) -> dict:
        """{vars, result: one row or none, time}; after the last row the result is closed. Any other id is an error, not an end."""
        found = self._find(query, id)
        if isinstance(found, list):
            return {"vars": found, "result": [], "time": 0.0}
        with found.lock:
            row = None if found.done else next(found.rows, None)
            if row is None and not found.done:
                found.done = True
                with self.lock:
                    key = next((k for k, x in self.open.items() if x is found), None)
                    text = next((t for t, ids in self.of_text.items() if key in ids), None)
                    if key is not None:
                        self._close(key)
                    for name in (key, None if text is None else "text " + text):
                        if name is not None:
                            self.done.pop(name, None)
                            self.done[name] = found.result.vars
                    while len(self.done) > 16 * self.most_open:
                        self.done.pop(next(iter(self.done)))
        return {"vars": found.result.vars, "result": [] if row is None else [row], "time": time.perf_counter() - found.began}


def _triples(query: str) -> list[str]:
    from .sparql.ast import Group, Optional_, Triple, Union_
    from .sparql.parser import parse

    def of(part) -> list[str]:
        if isinstance(part, Triple):
            return [str(part)]
        if isinstance(part, Group):
            return [t for p in part.parts for t in of(p)]
        if isinstance(part, Optional_):
            return of(part.group)
        if isinstance(part, Union_):
            return [t for b in part.branches for t in of(b)]
        return []

    return of(parse(query).where)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 5000) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``. Queries come as the parameter ``query`` of GET or POST; ``blocking=0`` asks for the first row only, the others come by the answer's ``id``."""
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, params: dict) -> None:
            at, query = urlsplit(self.path).path.rstrip("/"), params.get("query", [""])[0]
            try:
                if at == "/sparql":
                    status, body = 200, service.sparql(query, params.get("blocking", ["1"])[0] not in ("0", "false"))
                elif at == "/nextresult":
                    status, body = 200, service.next_result(query, params.get("id", [None])[0])
                else:
                    status, body = 404, {"error": f"no {at or '/'} here"}
            except Closed as e:
                status, body = 410, {"error": str(e)}
            except SparqlSyntaxError as e:
                status, body = 400, {"error": str(e)}
            except Exception as e:  # noqa: BLE001  the client is told, the server goes on
                status, body = 500, {"error": f"{type(e).__name__}: {e}"[:2000]}
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.answer(parse_qs(urlsplit(self.path).query))

        def do_POST(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            self.answer({**parse_qs(urlsplit(self.path).query), **parse_qs(body)})

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
