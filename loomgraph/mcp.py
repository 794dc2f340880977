"""The service's operations as tools of the Model Context Protocol, over standard streams.

JSON-RPC 2.0, a message a line.  The tools relay to the service through a client, so this
process holds no session.  Parameters are checked here; an operation that fails is a
result marked as an error, which a model can read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import IO, Any

from loomgraph.client import Client, ServiceError

PROTOCOLS = ("2025-06-18", "2025-03-26", "2024-11-05")
TEXT, WHOLE = {"type": "string"}, {"type": "integer"}
TYPES = {"string": str, "integer": int, "boolean": bool, "array": list}
#: Parameters that other graph servers take: refused, not passed over.
REFUSED = {"semantic_query": {"type": "array"}, "qn_pattern": TEXT, "file_pattern": TEXT, "min_degree": WHOLE, "max_degree": WHOLE, "exclude_entry_points": {"type": "boolean"}}


@dataclass(frozen=True)
class Tool:
    """op: the service's operation. params: JSON schemas by name; renamed: names there that differ."""

    op: str
    about: str
    params: dict[str, dict]
    required: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()

    def listed(self, name: str) -> dict:
        return {"name": name, "description": self.about, "inputSchema": {"type": "object", "properties": self.params, "required": list(self.required), "additionalProperties": False}}

    def checked(self, given: dict[str, Any]) -> dict[str, Any]:
        """The operation's parameters; raises ValueError."""
        if missing := [n for n in self.required if n not in given]:
            raise ValueError(f"missing: {', '.join(missing)}")
        if other := [n for n in given if n not in self.params]:
            raise ValueError(f"unknown: {', '.join(other)}")
        if refused := [n for n in given if n in REFUSED and given[n] is not None]:
            raise ValueError(f"not supported: {', '.join(refused)}")
        for name, value in given.items():
            kind = self.params[name]["type"]
            if value is not None and (not isinstance(value, TYPES[kind]) or kind == "integer" and isinstance(value, bool)):
                raise ValueError(f"{name} must be of type {kind}")
            if "enum" in self.params[name] and value not in self.params[name]["enum"]:
                raise ValueError(f"{name} must be one of {', '.join(self.params[name]['enum'])}")
        names = dict(self.renamed)
        return {names.get(n, n): v for n, v in given.items() if v is not None}


TOOLS = {
    "index_repository": Tool("index", "Index the repository into the graph; ask index_status for its progress.", {}),
    "index_status": Tool("status", "State of the index: queued, running, indexed, degraded (with reasons) or failed.", {}),
    "search_graph": Tool("search", "Search symbols by text (ranked), by a pattern on the name, or by label.", {"query": TEXT, "name_pattern": TEXT, "label": TEXT, "limit": WHOLE, "offset": WHOLE, **REFUSED}),
    "get_code_snippet": Tool("snippet", "Source of a symbol by its qualified name.", {"qualified_name": TEXT}, ("qualified_name",)),
    "trace_path": Tool("trace", "Call paths from a function, up to ten calls deep.", {"function_name": TEXT, "direction": {"type": "string", "enum": ["callees", "callers"]}, "depth": WHOLE}, ("function_name",), (("function_name", "qualified_name"),)),
    "get_graph_schema": Tool("schema_info", "Labels and edge types of the graph.", {}),
    "list_projects": Tool("list_projects", "The projects of this service.", {}),
    "delete_project": Tool("delete_project", "Delete the project's graph.", {}),
}


def _call(params: dict, connect: Callable[[], Client]) -> dict:
    tool = TOOLS.get(params.get("name"))
    if tool is None:
        raise KeyError(f"unknown tool {params.get('name')!r}")
    try:
        result = connect().call(tool.op, **tool.checked(params.get("arguments") or {}))
    except (ServiceError, ValueError) as e:
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}
    whole = result if isinstance(result, dict) else {"result": result}
    return {"content": [{"type": "text", "text": json.dumps(whole, default=str)}], "structuredContent": whole, "isError": False}


def answer(message: dict, connect: Callable[[], Client]) -> dict | None:
    """The response to a message; None to a notification."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    try:
        if method == "initialize":
            asked = params.get("protocolVersion")
            reply["result"] = {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "0.2"}}
        elif method == "ping":
            reply["result"] = {}
        elif method == "tools/list":
            reply["result"] = {"tools": [t.listed(n) for n, t in TOOLS.items()]}
        elif method == "tools/call":
            reply["result"] = _call(params, connect)
        else:
            reply["error"] = {"code": -32601, "message": f"unknown method {method!r}"}
    except KeyError as e:
        reply["error"] = {"code": -32602, "message": str(e.args[0])}
    return reply


def serve(lines: IO[str], out: IO[str], connect: Callable[[], Client]) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answer(message, connect) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "a message is an object"}}
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if reply is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
