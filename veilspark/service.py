"""The gate over HTTP, on this host alone. GET /health, /dictionary.json, /dictionary.md, /synthetic and
/synthetic/NAME, /audit; POST /submit with SQL as its body. All but /health need the token in the header X-Gate-Token;
a failure tells nothing of its cause."""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit

from veilspark.plans.gate import Gate
from veilspark.sources.store import Store, join

#: Largest body of a submission.
LARGEST = 1_000_000
# fixed values: the header of the token, kinds of content
TOKEN_HEADER = "X-Gate-Token"
JSON, MARKDOWN, CSV = "application/json", "text/markdown", "text/csv"

#: Status, kind of content, content.
Answer = tuple[int, str, bytes]


def said(status: int, value: object) -> Answer:
    return status, JSON, json.dumps(value).encode()


NOT_FOUND = said(404, {"error": "not found"})


class Routes:
    """What the service answers, apart from HTTP."""

    def __init__(self, gate: Gate) -> None:
        self.gate, self.store = gate, Store(gate.spark)
        self.home = (gate.dict_path or "").rpartition("/")[0]
        self.get: dict[str, Callable[[], Answer]] = {
            "/dictionary.json": lambda: self.file("dictionary.json", JSON),
            "/dictionary.md": lambda: self.file("dictionary.md", MARKDOWN),
            "/synthetic": lambda: said(200, self.samples()),
            "/audit": lambda: said(200, {"entries": gate.audit.entries()}),
        }

    def file(self, name: str, kind: str) -> Answer:
        path = join(self.home, name)
        return (200, kind, self.store.read(path).encode()) if self.store.exists(path) else NOT_FOUND

    def samples(self) -> list[str]:
        """Relative names of all samples; nothing but these is served."""
        out, todo = [], [""]
        while todo:
            folder = todo.pop()
            for name in self.store.names(join(self.home, "synthetic_samples", folder)):
                inside = f"{folder}/{name}".lstrip("/")
                (todo if self.store.is_folder(join(self.home, "synthetic_samples", inside)) else out).append(inside)
        return sorted(out)

    def sample(self, name: str) -> Answer:
        return self.file(f"synthetic_samples/{name}", CSV) if name in self.samples() else NOT_FOUND

    def asked(self, path: str) -> Answer:
        if path.startswith("/synthetic/"):
            return self.sample(unquote(path.removeprefix("/synthetic/")))
        return self.get.get(path, lambda: NOT_FOUND)()

    def submitted(self, body: bytes) -> Answer:
        if not 0 < len(body) <= LARGEST:
            return said(400, {"error": "bad request"})
        result = self.gate.submit(body.decode())
        outputs = [{"name": path.rpartition("/")[2], "content": self.store.read(path)} for path in result.outputs]
        return said(200, {"status": result.status, "message": result.message, "outputs": outputs})


class Handler(BaseHTTPRequestHandler):
    server: "Server"

    def log_message(self, format: str, *args: object) -> None:
        """Requests may hold values, so nothing is logged."""

    def _answer(self, make: Callable[[str], Answer]) -> None:
        path = urlsplit(self.path).path
        try:
            if path == "/health":
                answer = said(200, {"ok": True})
            elif not self.server.token or not hmac.compare_digest(self.headers.get(TOKEN_HEADER, "").encode(), self.server.token.encode()):
                answer = said(401, {"error": "unauthorized"})
            else:
                answer = make(path)
        except Exception:
            answer = said(500, {"error": "internal error"})
        status, kind, body = answer
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def _submit(self, path: str) -> Answer:
        if path != "/submit":
            return NOT_FOUND
        size = int(self.headers.get("Content-Length") or 0)
        return self.server.routes.submitted(self.rfile.read(min(size, LARGEST + 1)))

    def do_GET(self) -> None:  # noqa: N802
        self._answer(self.server.routes.asked)

    def do_POST(self) -> None:  # noqa: N802
        self._answer(self._submit)


class Server(ThreadingHTTPServer):
    def __init__(self, gate: Gate, token: str, address: tuple[str, int]) -> None:
        super().__init__(address, Handler)
        self.routes, self.token = Routes(gate), token


def make_server(gate: Gate, token: str, bind: str = "127.0.0.1", port: int = 0) -> Server:
    return Server(gate, token, (bind, port))
