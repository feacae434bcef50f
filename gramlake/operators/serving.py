"""A server and a client for the generation service: JSON over HTTP, streams as lines.

``POST /<verb>`` with a JSON object answers with one JSON object per line;
``GET /health`` says whether the model can be asked.
"""

from __future__ import annotations

import json
import signal
import threading
import urllib.error
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from gramlake.operators.service import Service

#: Requests that are worked on at once; others wait.
AT_ONCE = 100
VERBS = ("valid_text", "is_valid_text", "model_block_size", "generate_batch", "generate_stream")


class Server:
    """Serves in threads of its own until ``close``; port 0 takes any free one."""

    def __init__(self, service: Service, port: int = 0, host: str = "127.0.0.1"):
        places = threading.BoundedSemaphore(AT_ONCE)

        class Handler(BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.0"

            def log_message(self, *args) -> None:
                pass

            def _begin(self, code: int) -> None:
                self.send_response(code)
                self.send_header("Content-Type", "application/x-ndjson; charset=utf-8")
                self.end_headers()

            def _line(self, text: str) -> None:
                self.wfile.write(text.encode("utf-8") + b"\n")
                self.wfile.flush()

            def do_GET(self) -> None:
                known = self.path == "/health"
                self._begin(200 if known else 404)
                self._line(json.dumps({"status": "SERVING"} if known else {"error": "unknown path"}))

            def do_POST(self) -> None:
                verb, begun = self.path.strip("/"), False
                request = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8")
                if verb not in VERBS:
                    self._begin(404)
                    return self._line(json.dumps({"error": "unknown verb"}))
                with places:
                    try:
                        for line in service.answer_json(verb, request):
                            if not begun:
                                self._begin(200)
                                begun = True
                            self._line(line)
                        if not begun:
                            self._begin(200)
                    except (ValueError, TypeError, KeyError) as e:
                        if not begun:
                            self._begin(400)
                        self._line(json.dumps({"error": str(e)}))

        self._http = ThreadingHTTPServer((host, port), Handler)
        self.port = self._http.server_address[1]
        self._thread = threading.Thread(target=self._http.serve_forever, daemon=True)
        self._thread.start()

    def close(self) -> None:
        self._http.shutdown()
        self._http.server_close()

    def until_stopped(self) -> None:
        """Serve until the process is told to end."""
        done = threading.Event()
        for kind in (signal.SIGTERM, signal.SIGINT):
            signal.signal(kind, lambda *_: done.set())
        done.wait()
        self.close()


class Client:
    def __init__(self, port: int, host: str = "127.0.0.1"):
        self.base = f"http://{host}:{port}"

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(f"{self.base}/health", timeout=10) as answer:
                return json.load(answer)["status"] == "SERVING"
        except OSError:
            return False

    def ask(self, verb: str, **request) -> Iterator[dict]:
        """The answers in order; a refused request raises ``ValueError``."""
        call = urllib.request.Request(f"{self.base}/{verb}", json.dumps(request).encode("utf-8"), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(call) as answer:
                for line in answer:
                    got = json.loads(line)
                    if "error" in got:
                        raise ValueError(got["error"])
                    yield got
        except urllib.error.HTTPError as e:
            raise ValueError(json.loads(e.read() or b"{}").get("error", str(e))) from e
