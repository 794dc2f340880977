"""A client of the service's socket; needs no Spark."""

from __future__ import annotations

import json
import os
import socket
import tempfile
from hashlib import sha256
from pathlib import Path


class ServiceError(RuntimeError):
    """The service can't be reached, or says that a request failed."""


def socket_of(folder: str | Path) -> Path:
    """The socket of a project's folder. Paths of sockets are short, so it is named by a hash."""
    name = sha256(os.path.realpath(folder).encode()).hexdigest()[:16]
    return Path(os.environ.get("XDG_RUNTIME_DIR") or tempfile.gettempdir()) / f"loomgraph-{name}.sock"


class Client:
    """Requests over a Unix socket, a connection each."""

    def __init__(self, path: str | Path, timeout: float = 120.0):
        self.path, self.timeout = str(path), timeout

    def call(self, op: str, **params):
        """The result of an operation; raises ServiceError."""
        try:
            with socket.socket(socket.AF_UNIX) as s:
                s.settimeout(self.timeout)
                s.connect(self.path)
                s.sendall(json.dumps({"op": op, "params": params}).encode() + b"\n")
                with s.makefile("rb") as answers:
                    line = answers.readline()
            answer = json.loads(line)
        except OSError as e:
            raise ServiceError(f"no service at {self.path}: {e}") from e
        except ValueError as e:
            raise ServiceError(f"the service at {self.path} broke off its answer") from e
        if not answer["ok"]:
            raise ServiceError(answer["error"])
        return answer["result"]

    def alive(self) -> bool:
        try:
            return bool(self.call("ping")["pong"])
        except ServiceError:
            return False
