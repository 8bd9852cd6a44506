"""Setting up a tree: the client's server entry, the ignore file, versions."""

from __future__ import annotations

import json
import os
import re
import sys
from pathlib import Path

CLIENT, BLOCK = ".mcp.json", ["# codegraph: concepts are shared, the rest is local", ".codegraph/*", "!.codegraph/assertions.yaml"]


def relative_to(root: str, path: str) -> str:
    """A path inside root as written from there, any other as it is."""
    rel = os.path.relpath(path, root)
    return path if rel.startswith("..") else rel


def client_entry(root: str) -> dict:
    return {"command": relative_to(root, sys.executable), "args": ["-m", "codegraph", "--root", ".", "serve"]}


def write_client(root: str) -> str:
    """Put the server into the client's configuration; other entries stay, and a malformed file is begun anew."""
    path = Path(root, CLIENT)
    try:
        config = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError):
        config = {}
    if not isinstance(config, dict):
        config = {}
    servers = config.get("mcpServers")
    config["mcpServers"] = (servers if isinstance(servers, dict) else {}) | {"codegraph": client_entry(root)}
    path.write_text(json.dumps(config, indent=2) + "\n", "utf-8")
    return str(path)


def ensure_ignored(root: str) -> bool:
    """Add the block to the ignore file once, in place of an older line that ignored the whole folder; whether anything changed."""
    path = Path(root, ".gitignore")
    old = path.read_text("utf-8") if path.exists() else ""
    lines = old.splitlines()
    if all(b in lines for b in BLOCK):
        return False
    kept = [x for x in lines if not re.fullmatch(r"/?\.codegraph/?", x.strip()) and x not in BLOCK]
    path.write_text("\n".join([*kept, *([""] if kept and kept[-1] else []), *BLOCK]) + "\n", "utf-8")
    return True


def package_version(root: str) -> str:
    """The version in a tree's package.json, or 0.0.0."""
    try:
        found = json.loads(Path(root, "package.json").read_text("utf-8"))
        return found["version"] if isinstance(found.get("version"), str) else "0.0.0"
    except (OSError, ValueError, KeyError, AttributeError):
        return "0.0.0"
