"""A stdio server of the engine's questions: one JSON-RPC message per line, errors as results marked isError."""

from __future__ import annotations

import inspect
import json
import logging
import re
import sys
from typing import TextIO

from . import __version__
from .engine import Engine

TOOLS = "find_def find_refs dep_graph call_graph flow arch_list arch_query arch_assert arch_candidates".split()
TYPES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list[dict]": "array", "dict": "object"}
log = logging.getLogger("codegraph.server")


def describe(name: str) -> dict:
    """A tool's name, description and input schema, from its method."""
    method = getattr(Engine, name)
    properties, required = {}, []
    for key, p in list(inspect.signature(method).parameters.items())[1:]:
        kind = TYPES.get(str(p.annotation).removesuffix(" | None"), "string")
        properties[camel(key)] = {"type": kind} | ({"default": p.default} if p.default not in (p.empty, None) else {})
        if p.default is p.empty:
            required.append(camel(key))
    return {"name": name, "description": inspect.getdoc(method), "inputSchema": {"type": "object", "properties": properties, "required": required}}


def camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m[1].upper(), name)


def snake(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), name)


def answer(engine: Engine, message: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    id_, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if id_ is None:
        return None
    reply = {"jsonrpc": "2.0", "id": id_}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "codegraph", "version": __version__}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [describe(t) for t in TOOLS]}}
    if method != "tools/call" or params.get("name") not in TOOLS:
        return reply | {"error": {"code": -32601, "message": f"unknown: {params.get('name') or method}"}}
    try:
        text, failed = getattr(engine, params["name"])(**{snake(k): v for k, v in (params.get("arguments") or {}).items()}).text, False
    except Exception as e:  # noqa: BLE001  a question's failure is its answer; the server goes on
        log.warning("%s failed: %s", params["name"], e)
        text, failed = f"{type(e).__name__}: {e}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(engine: Engine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    engine.sync()
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            reply = answer(engine, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
