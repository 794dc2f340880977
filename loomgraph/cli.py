"""The command line: index, status, serve, daemon start|stop|restart|status, mcp."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

from loomgraph.client import Client, ServiceError, socket_of

#: Exit codes of `status`, by the project's state; others: 2.
EXIT = {"indexed": 0, "degraded": 1}
#: Seconds that a daemon may take to come up, and to end.
PATIENCE = 120.0


def _folder(args: argparse.Namespace) -> Path:
    from loomgraph.sources.storage import project_slug

    return Path(args.data) / project_slug(args.root)


def _status(folder: Path) -> dict:
    path = folder / "status.json"
    return json.loads(path.read_text()) if path.exists() else {"state": "uninitialized"}


def _pid(folder: Path) -> int | None:
    """The daemon's process, if it runs."""
    try:
        pid = int((folder / "daemon.pid").read_text())
        os.kill(pid, 0)
        # a process that has ended stays listed until its parent asks for it
        state = Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()[0] if Path("/proc/self").exists() else ""
    except (OSError, ValueError, IndexError):
        return None
    return None if state in ("Z", "X") else pid


def _until(condition) -> bool:
    end = time.monotonic() + PATIENCE
    while not (done := condition()) and time.monotonic() < end:
        time.sleep(0.1)
    return done


def start(args: argparse.Namespace) -> int:
    """Starts the daemon, unless it answers."""
    folder = _folder(args)
    client = Client(socket_of(folder))
    if client.alive():
        print("already running")
        return 0
    folder.mkdir(parents=True, exist_ok=True)
    with (folder / "daemon.log").open("ab") as log:
        command = [sys.executable, "-m", "loomgraph.cli", "serve", "--socket", "--root", args.root, "--data", args.data]
        child = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=log, stderr=log, start_new_session=True)
    if _until(lambda: client.alive() or child.poll() is not None) and client.alive():
        print("started")
        return 0
    print(f"did not come up, see {folder / 'daemon.log'}", file=sys.stderr)
    return 1


def stop(args: argparse.Namespace) -> int:
    """Leaves no daemon and nothing of one: asks it to end, terminates one that doesn't answer, kills
    one that doesn't end; what a dead one has left is removed."""
    folder = _folder(args)
    pid, answered = _pid(folder), False
    with contextlib.suppress(ServiceError):
        Client(socket_of(folder)).call("shutdown")
        answered = True
    for sign in (None if answered else signal.SIGTERM, signal.SIGKILL):
        if pid is None:
            break
        with contextlib.suppress(ProcessLookupError):
            if sign:
                os.kill(pid, sign)
        if _until(lambda: _pid(folder) is None):
            break
    for left in (folder / "daemon.pid", socket_of(folder)):
        left.unlink(missing_ok=True)
    print("stopped" if answered or pid is not None else "not running")
    return 0


def daemon_status(args: argparse.Namespace) -> int:
    """0: runs; 1: stopped; 2: ended without saying so."""
    folder = _folder(args)
    if Client(socket_of(folder)).alive():
        print(f"running, index {_status(folder)['state']}")
        return 0
    crashed = (folder / "daemon.pid").exists()
    print("crashed: it left its pid file" if crashed else "stopped")
    return 2 if crashed else 1


def serve(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from loomgraph.functions.embed import HashedTokens, SentenceModel
    from loomgraph.service import Service

    model = SentenceModel()
    service = Service(SparkSession.builder.appName("loomgraph").getOrCreate(), args.root, args.data, model if model.available() else HashedTokens())
    with contextlib.closing(service):
        if args.command == "index":
            service.op_index(wait=True)
            print(json.dumps(service.op_status()))
            return EXIT.get(service.op_status()["state"], 2)
        if not args.socket:
            service.serve(sys.stdin, sys.stdout)
            return 0
        pid = _folder(args) / "daemon.pid"
        pid.write_text(str(os.getpid()))
        signal.signal(signal.SIGTERM, lambda *_: sys.exit(0))
        service.serve_socket(socket_of(_folder(args)))
        pid.unlink(missing_ok=True)
        return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--root", default=".")
    common.add_argument("--data", default=str(Path.home() / ".loomgraph"))
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index", parents=[common])
    commands.add_parser("status", parents=[common])
    commands.add_parser("serve", parents=[common]).add_argument("--socket", action="store_true")
    commands.add_parser("daemon", parents=[common]).add_argument("action", choices=("start", "stop", "restart", "status"))
    commands.add_parser("mcp", parents=[common])
    args = parser.parse_args(argv)
    if args.command == "status":  # a file is read, without a session
        state = _status(_folder(args))
        print(json.dumps(state))
        return EXIT.get(state["state"], 2)
    if args.command == "daemon":
        if args.action == "restart":
            stop(args)
        return {"start": start, "restart": start, "stop": stop, "status": daemon_status}[args.action](args)
    if args.command == "mcp":
        from loomgraph import mcp

        def connected() -> Client:
            """A client of the daemon, which is started if it doesn't answer."""
            client = Client(socket_of(_folder(args)))
            if not client.alive():
                out, sys.stdout = sys.stdout, sys.stderr  # the channel is for messages alone
                try:
                    start(args)
                finally:
                    sys.stdout = out
            return client

        mcp.serve(sys.stdin, sys.stdout, connected)
        return 0
    return serve(args)


if __name__ == "__main__":
    sys.exit(main())
