"""Concept files: YAML in, dataclasses out; upserts go through a temporary file."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

import yaml

from ..operators.knowledge import Concept, Flow, Invariant, Locator, LocatorError

FIELD = {"symbol": "query", "path": "glob", "import": "of"}


class Loader(yaml.SafeLoader):
    """YAML 1.2 booleans: true and false alone; words such as on and yes stay text."""


Loader.yaml_implicit_resolvers = {c: [(tag, rx) for tag, rx in found if tag != "tag:yaml.org,2002:bool"] for c, found in yaml.SafeLoader.yaml_implicit_resolvers.items()}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _locator(raw: object, where: str) -> Locator:
    if not isinstance(raw, dict) or raw.get("kind") not in FIELD:
        raise LocatorError(f"{where}: a locator needs a kind of {', '.join(FIELD)}")
    field = FIELD[raw["kind"]]
    if not isinstance(raw.get(field), str) or not raw[field]:
        raise LocatorError(f"{where}: a {raw['kind']} locator needs {field}")
    title = raw.get("title")
    return Locator(raw["kind"], **{field: raw[field]}, within=raw.get("in"), title=str(title) if title is not None else None)


def _locators(raw: object, where: str) -> tuple[Locator, ...]:
    if not isinstance(raw, list):
        raise LocatorError(f"{where}: locators form a list")
    return tuple(_locator(x, where) for x in raw)


def concept(id_: str, raw: object) -> Concept:
    """One concept; a flow goes before stages and stages before locators."""
    if not isinstance(raw, dict):
        raise LocatorError(f"concept {id_}: not a mapping")
    where, must, flow = f"concept {id_}", None, None
    if raw.get("must") is not None:
        m = raw["must"]
        if not isinstance(m, dict):
            raise LocatorError(f"{where}: must is a mapping")
        must = Invariant(_locators(m.get("locators", []), where), m.get("title"))
    locators: tuple[Locator, ...] = ()
    stages: tuple[Locator, ...] = ()
    if raw.get("flow") is not None:
        f = raw["flow"]
        if not isinstance(f, dict) or not isinstance(f.get("entry"), str):
            raise LocatorError(f"{where}: a flow needs an entry")
        flow = Flow(f["entry"], f.get("pathGlob"))
    elif raw.get("stages") is not None:
        stages = _locators(raw["stages"], where)
    else:
        locators = _locators(raw.get("locators", []), where)
    return Concept(id_, str(raw.get("title") or id_), raw.get("description"), raw.get("note"), locators, stages, flow, must)


def load(path: str) -> dict[str, Concept]:
    """Concepts by id; a missing file has none, a malformed one raises."""
    try:
        raw = yaml.load(Path(path).read_text("utf-8"), Loader)
    except FileNotFoundError:
        return {}
    if raw is None:
        return {}
    if not isinstance(raw, dict) or not isinstance(raw.get("concepts", {}), dict):
        raise LocatorError(f"{path}: concepts form a mapping")
    return {str(k): concept(str(k), v) for k, v in raw.get("concepts", {}).items()}


def save(path: str, id_: str, entry: dict) -> None:
    """Replace one concept's entry as a whole; the others stay."""
    where = Path(path)
    raw = (yaml.load(where.read_text("utf-8"), Loader) if where.exists() else None) or {}
    raw.setdefault("concepts", {})[id_] = {k: v for k, v in entry.items() if v is not None}
    where.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=where.parent, delete=False, encoding="utf-8") as f:
        yaml.safe_dump(raw, f, sort_keys=False, allow_unicode=True)
    os.replace(f.name, path)
