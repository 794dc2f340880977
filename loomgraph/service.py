"""Operations on a project behind a JSON-line protocol, on a stream or a Unix socket.

One JSON object a line: {"op": ..., "params": {...}} in, {"ok": ..., "result" or "error"}
out.  An unknown operation or malformed line is an answer, not a crash.
"""

from __future__ import annotations

import contextlib
import json
import os
import socketserver
import threading
from pathlib import Path
from typing import IO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.embed import Embedder
from loomgraph.functions.expr import lines_between
from loomgraph.operators import graph, search
from loomgraph.plans.index_job import index_repository
from loomgraph.sources.storage import Store, project_slug

#: Search parameters that other services take and this one must refuse, not ignore.
REFUSED = ("semantic_query", "qn_pattern", "file_pattern", "min_degree", "max_degree", "exclude_entry_points")

class Service:
    """One project. Index jobs run one at a time; reads go on beside them."""

    def __init__(self, spark: SparkSession, root: str, folder: str, embedder: Embedder | None = None, config: search.RankConfig = search.RankConfig()):
        self.spark, self.root, self.project, self.embedder, self.config = spark, root, project_slug(root), embedder, config
        self.store = Store(spark, f"{folder}/{self.project}")
        self._lock = threading.Lock()

    def close(self) -> None:
        """Stops the session, after an index job that runs."""
        with self._lock:
            self.spark.stop()

    def op_ping(self) -> dict:
        return {"pong": True, "project": self.project, "pid": os.getpid()}

    def op_index(self, wait: bool = False) -> dict:
        if not self._lock.acquire(blocking=False):
            raise RuntimeError("an index job is running")

        def job() -> None:
            with contextlib.suppress(Exception):  # the status tells
                index_repository(self.store, self.root, self.project, F.current_timestamp(), self.embedder, job=number)
            self._lock.release()

        try:
            number = f"{self.project}-{self.store.next_version()}"
            self.store.set_status("queued", job=number)
            thread = threading.Thread(target=job, daemon=True)
            thread.start()
        except BaseException:
            self._lock.release()
            raise
        if wait:
            thread.join()
        return {"job": number, "state": self.store.status()["state"]}

    def op_status(self) -> dict:
        return self.store.status()

    def _graph(self) -> search.Graph:
        # the last change of each file is all that a search needs of the history
        changes = self.store.read("file_evolution").select("path", F.col("last_commit_at").alias("committed_at"))
        vectors = self.store.read("embeddings")
        return search.Graph(self.store.read("nodes"), self.store.read("edges"), changes, vectors)

    def _vector(self, query: str | None) -> list[float] | None:
        """The query's vector, if there is an embedder and the project has vectors."""
        if not query or self.embedder is None or not self.embedder.available() or not self.store.has_rows("embeddings"):
            return None
        return self.embedder.vectors([query])[0].tolist()

    def op_search(self, query: str | None = None, name_pattern: str | None = None, label: str | None = None, limit: int = 200, offset: int = 0, **more) -> dict:
        if more:
            known = sorted(set(more) & set(REFUSED))
            raise ValueError(f"not supported: {', '.join(known or sorted(more))}")
        asked = search.Query(query, name_pattern, label, self._vector(query))
        page = search.search_graph(self._graph(), asked, F.current_timestamp(), self.config, limit=limit, offset=offset)
        return {"items": page.items, "total": page.total, "has_more": page.has_more}

    def op_snippet(self, qualified_name: str) -> dict:
        node = self.store.read("nodes").where(F.col("qualified_name") == qualified_name).first()
        if node is None:
            raise KeyError(f"unknown symbol {qualified_name}")
        text = self.spark.read.text(str(Path(self.root).resolve() / node["file_path"]), wholetext=True)
        part = text.select(lines_between(F.col("value"), F.lit(node["start_line"]), F.lit(node["end_line"])).alias("text")).first()
        return {"qualified_name": qualified_name, "file_path": node["file_path"], "start_line": node["start_line"], "end_line": node["end_line"], "text": part["text"]}

    def op_trace(self, qualified_name: str, direction: str = "callees", depth: int = 5, limit: int = 10_000, offset: int = 0) -> list[dict]:
        """A page of the paths, the shortest first."""
        edges = self.store.read("edges").where("type = 'CALLS'")
        return [r.asDict() for r in graph.trace_path(edges, qualified_name, direction, depth).offset(offset).limit(limit).collect()]

    def op_schema_info(self) -> dict:
        rows = graph.schema_info(self.store.read("nodes"), self.store.read("edges")).collect()
        return {"labels": [r["value"] for r in rows if r["kind"] == "label"], "edge_types": [r["value"] for r in rows if r["kind"] == "edge_type"]}

    def op_list_projects(self) -> list[dict]:
        return [{"project": self.project, "root": os.path.realpath(self.root), "state": self.store.status()["state"]}]

    def op_delete_project(self) -> dict:
        self.store.delete()
        return {"deleted": self.project}

    def handle(self, line: str) -> dict:
        try:
            request = json.loads(line)
            run = getattr(self, f"op_{request['op']}", None)
            if run is None:
                raise KeyError(f"unknown operation {request['op']!r}")
            return {"ok": True, "result": run(**request.get("params", {}))}
        except Exception as e:  # noqa: BLE001  the protocol's answer
            return {"ok": False, "error": f"{type(e).__name__}: {e}"[:500]}

    def answer(self, line: str) -> tuple[str, bool]:
        """(the answer's line, whether it was a shutdown)."""
        with contextlib.suppress(ValueError, AttributeError):
            if json.loads(line).get("op") == "shutdown":
                return json.dumps({"ok": True, "result": {"stopped": True}}) + "\n", True
        return json.dumps(self.handle(line), default=str) + "\n", False

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        """Answers each line until the end or a shutdown."""
        for line in lines:
            if line.strip():
                text, stop = self.answer(line)
                out.write(text)
                out.flush()
                if stop:
                    return

    def serve_socket(self, path: str | Path) -> None:
        """Answers connections on a Unix socket, a thread each, until a shutdown."""
        service = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for line in self.rfile:
                    text, stop = service.answer(line.decode(errors="replace"))
                    self.wfile.write(text.encode())
                    self.wfile.flush()
                    if stop:
                        threading.Thread(target=self.server.shutdown, daemon=True).start()
                        return

        path = Path(path)
        path.unlink(missing_ok=True)
        with socketserver.ThreadingUnixStreamServer(str(path), Handler) as server:
            server.daemon_threads = True
            try:
                server.serve_forever(poll_interval=0.1)
            finally:
                path.unlink(missing_ok=True)
