"""The engine's verbs as named tools: in process, over HTTP, and a client with the same methods.

A tool takes and gives plain JSON values. The server listens on the local machine unless told otherwise; whose rows a caller may
see is decided by its token, never by what it says of itself.
"""

from __future__ import annotations

import datetime
import decimal
import hmac
import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .sources.failures import FailureStore
from .sqlx.execute import Engine

MAX_BODY = 1 << 20


class ToolError(Exception):
    """A tool's refusal or failure; ``retryable`` says whether another call may do."""

    def __init__(self, message: str, retryable: bool = False, step: str = ""):
        super().__init__(message)
        self.message, self.retryable, self.step = message, retryable, step


def plain(value: object) -> object:
    """A row's value as JSON can hold it; integers that a double can't hold exactly and decimals become texts."""
    if isinstance(value, bool) or value is None or isinstance(value, (str, float)):
        return value
    if isinstance(value, int):
        return value if abs(value) < 1 << 53 else str(value)
    if isinstance(value, (decimal.Decimal, datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


class Tools:
    """Named tools over an engine, a store of knowledge (``ingest.KnowledgeStore``) and one of failures, each of which may be missing."""

    def __init__(self, engine: Engine | None = None, knowledge: object = None, failures: FailureStore | None = None):
        self.engine, self.knowledge, self.failures = engine, knowledge, failures
        self.named: dict[str, Callable[..., object]] = {}
        if engine:
            self.named |= {"execute_query": self._execute, "explain_query": self._explain, "validate_query": self._validate, "health_check": lambda tenant: {"healthy": engine.health_check()}}
        if knowledge:
            self.named |= {"search": lambda tenant, question, k=10, entities=None, budget=7000: knowledge.search(question, k, entities, budget)}
        if failures:
            self.named |= {
                "log_failure": lambda tenant, nl_query, failed_sql, error, retries=0: {"id": failures.log(nl_query, failed_sql, error, retries)},
                "save_correction": lambda tenant, id, sql: {"saved": failures.save_correction(id, sql)},
                "list_failures": lambda tenant, corrected=None, most=100: [r.asDict() for r in failures.list(corrected, min(int(most), 1000)).collect()],
                "get_failure": lambda tenant, id: (r := failures.get(id)) and r.asDict(),
            }

    def _execute(self, tenant: int | None, sql: str, max_rows: int = 1000, question: str = "") -> dict:
        r = self.engine.execute_query(sql, tenant, int(max_rows), question)
        if not r.verdict.passed:
            raise ToolError(r.verdict.message, r.verdict.retryable, r.verdict.step)
        return {"rows": r.rows, "row_count": r.row_count, "elapsed_ms": r.elapsed_ms}

    def _explain(self, tenant: int | None, sql: str) -> dict:
        v = self.engine.verdict(sql, tenant)
        if not v.passed:
            raise ToolError(v.message, v.retryable, v.step)
        return self.engine.explain_query(v.written or sql, tenant)

    def _validate(self, tenant: int | None, sql: str, question: str = "") -> dict:
        v = self.engine.verdict(sql, tenant, question)
        return {"passed": v.passed, "step": v.step, "message": v.message, "retryable": v.retryable, "advice": v.advice}

    def call(self, name: str, arguments: dict, tenant: int | None = None) -> object:
        """What a tool gives; raises ToolError for an unknown tool, wrong arguments or a refusal."""
        if name not in self.named:
            raise ToolError(f"there is no tool {name}")
        if not isinstance(arguments, dict) or "tenant" in arguments:
            raise ToolError("arguments are an object, and the tenant isn't one of them")
        try:
            return plain(self.named[name](tenant, **arguments))
        except TypeError as e:
            raise ToolError(f"wrong arguments: {e}") from e


class ToolServer:
    """Tools over HTTP: GET /tools lists them, POST /tools/NAME calls one with a JSON object and gives {"result": ..} or {"error": ..}.

    ``tenants``: the tenant of each bearer token. A call without a token has none; one with an unknown token is refused.
    """

    def __init__(self, tools: Tools, host: str = "127.0.0.1", port: int = 0, tenants: dict[str, int] | None = None):
        known = tenants or {}

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args: object) -> None:
                pass

            def _send(self, status: int, body: dict) -> None:
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self._send(200, {"result": sorted(tools.named)}) if self.path == "/tools" else self._send(404, {"error": "not found"})

            def do_POST(self) -> None:
                size = int(self.headers.get("Content-Length") or 0)
                if not self.path.startswith("/tools/") or size > MAX_BODY:
                    return self._send(404 if size <= MAX_BODY else 413, {"error": "not found" if size <= MAX_BODY else "too large"})
                token, tenant = (self.headers.get("Authorization") or "").removeprefix("Bearer ").strip(), None
                if token:
                    tenant = next((t for k, t in known.items() if hmac.compare_digest(k.encode(), token.encode())), None)
                    if tenant is None:
                        return self._send(401, {"error": "unknown token"})
                try:
                    self._send(200, {"result": tools.call(self.path[len("/tools/") :], json.loads(self.rfile.read(size) or b"{}"), tenant)})
                except ToolError as e:
                    self._send(400, {"error": e.message, "retryable": e.retryable, "step": e.step})
                except ValueError as e:
                    self._send(400, {"error": f"no JSON: {e}"})
                except Exception as e:  # of the tool itself: the caller is told that it failed, not how
                    self._send(500, {"error": type(e).__name__, "retryable": True})

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.http.server_address[1]}"
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)

    def __enter__(self) -> ToolServer:
        self.thread.start()
        return self

    def __exit__(self, *exc: object) -> None:
        self.http.shutdown()
        self.http.server_close()


class ToolClient:
    """The tools of a server as methods of the same names: ``client.execute_query(sql=..)``. Calls that can't reach it are tried again."""

    def __init__(self, url: str, token: str = "", timeout: float = 30.0, tries: int = 3):
        self.url, self.token, self.timeout, self.tries = url.rstrip("/"), token, timeout, tries

    def call(self, name: str, arguments: dict) -> object:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for turn in range(self.tries):
            request = urllib.request.Request(f"{self.url}/tools/{name}", json.dumps(arguments).encode(), headers)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)["result"]
            except urllib.error.HTTPError as e:
                body = json.loads(e.read() or b"{}")
                raise ToolError(body.get("error", str(e)), bool(body.get("retryable")), body.get("step", "")) from e
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if turn == self.tries - 1:
                    raise ToolError(f"no answer from {self.url}: {e}", True) from e
        raise ToolError("no tries")

    def __getattr__(self, name: str) -> Callable[..., object]:
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda **arguments: self.call(name, arguments)
