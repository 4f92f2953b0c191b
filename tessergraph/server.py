"""A JSON-RPC server on standard input and output: one message a line."""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from tessergraph.engine import Engine
from tessergraph.plans.render import format_subgraph
from tessergraph.session import scratch

VERSION, PROTOCOL = "0.1.0", "2024-11-05"
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
_TEXT, FORMATS = {"type": "string"}, ("markdown", "json", "yaml")


def _tool(name: str, description: str, required: list[str], **properties: dict) -> dict[str, Any]:
    return {"name": name, "description": description, "inputSchema": dict(type="object", properties=properties, required=required)}


TOOLS = [
    _tool("tessergraph_query", "The most relevant part of the graph within a token budget.", ["query"], query=_TEXT, budget={"type": "integer", "default": 4000}, format=dict(_TEXT, enum=list(FORMATS))),
    _tool("tessergraph_explain", "A node and its neighbours.", ["node"], node=_TEXT),
    _tool("tessergraph_path", "A shortest path between two nodes.", ["source", "target"], source=_TEXT, target=_TEXT),
    _tool("tessergraph_stats", "Counts of the graph.", []),
]


class Refusal(Exception):
    """Ends a request with an error response."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def budget_of(value: Any) -> int:
    """A positive whole number, also as a float; anything else is refused."""
    whole = not isinstance(value, bool) and isinstance(value, int | float) and value == int(value) if value == value and value not in (float("inf"), float("-inf")) else False
    if not whole or value <= 0:
        raise Refusal(PARAMS, "budget must be a positive whole number")
    return int(value)


def _string(args: dict[str, Any], name: str) -> str:
    if not isinstance(args.get(name), str) or not args[name]:
        raise Refusal(PARAMS, f"missing required string argument '{name}'")
    return args[name]


def call_tool(engine: Engine, name: str, args: dict[str, Any]) -> str:
    try:
        if name == "tessergraph_query":
            query, budget, fmt = _string(args, "query"), budget_of(args.get("budget", 4000)), args.get("format", "markdown")
            if fmt not in FORMATS:
                raise Refusal(PARAMS, f"unknown format {fmt!r}; there are markdown, json and yaml")
            answer = engine.ask(query, budget)
            return format_subgraph(answer.selection, fmt, answer.scores, query)
        if name == "tessergraph_explain":
            return engine.explain(_string(args, "node"))
        if name == "tessergraph_path":
            return engine.path(_string(args, "source"), _string(args, "target"))
        if name == "tessergraph_stats":
            return engine.stats()
    except KeyError as e:
        raise Refusal(PARAMS, f"node {e.args[0]!r} not found in graph") from e
    raise Refusal(PARAMS, f"unknown tool {name!r}")


def _answer(engine: Engine, method: str, params: dict[str, Any]) -> dict[str, Any]:
    if method == "initialize":
        return dict(protocolVersion=PROTOCOL, capabilities={"tools": {}}, serverInfo=dict(name="tessergraph", version=VERSION))
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": TOOLS}
    if method != "tools/call":
        raise Refusal(METHOD, f"unknown method {method!r}")
    name, args = params.get("name"), params.get("arguments") or {}
    if not isinstance(name, str) or not name:
        raise Refusal(PARAMS, "tools/call requires a string 'name'")
    if not isinstance(args, dict):
        raise Refusal(PARAMS, "'arguments' must be an object")
    with scratch():
        return dict(content=[dict(type="text", text=call_tool(engine, name, args))])


def respond(engine: Engine, line: str) -> dict[str, Any] | None:
    """The response to one line; None for blank lines and notifications. An error never ends the server."""
    if not line.strip():
        return None
    mid, quiet = None, False
    try:
        try:
            message = json.loads(line)
        except ValueError as e:
            raise Refusal(PARSE, f"invalid JSON: {e}") from e
        if not isinstance(message, dict):
            raise Refusal(REQUEST, "a message must be an object")
        mid, quiet = message.get("id"), "id" not in message
        if message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            raise Refusal(REQUEST, "invalid JSON-RPC 2.0 request")
        params = message.get("params") or {}
        if not isinstance(params, dict):
            raise Refusal(PARAMS, "'params' must be an object")
        body = {} if quiet else {"result": _answer(engine, message["method"], params)}
    except Refusal as e:
        body = {"error": {"code": e.code, "message": str(e)}}
    except Exception as e:  # whatever fails in a query is that request's failure only
        body = {"error": {"code": INTERNAL, "message": f"failed: {e}"}}
    return None if quiet else {"jsonrpc": "2.0", "id": mid, **body}


def serve(engine: Engine, inp: TextIO | None = None, out: TextIO | None = None) -> None:
    out = out or sys.stdout
    for line in inp or sys.stdin:
        response = respond(engine, line)
        if response is not None:
            out.write(json.dumps(response) + "\n")
            out.flush()
