"""Source listings: through git where there is a repository, else by walking; contents are read by the executors."""

from __future__ import annotations

import json
import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import DECLARATION_FILE, SOURCE_FILE, grammar_of, is_source_file

# Folders that hold no sources of their own.
SKIPPED = frozenset("node_modules .git dist build out coverage .codegraph".split())
# Configurations of a folder, in the order they are tried.
CONFIGS = ("tsconfig.app.json", "tsconfig.lib.json", "tsconfig.json")
LISTING = "path string, mtime_ms double, size long"


def is_source(path: str) -> bool:
    return bool(re.search(SOURCE_FILE.replace(r"\z", r"\Z"), path)) and not re.search(DECLARATION_FILE.replace(r"\z", r"\Z"), path)


def by_git(root: str) -> list[str] | None:
    """Tracked files and untracked ones that aren't ignored; None without git."""
    try:
        said = subprocess.run(["git", "ls-files", "-z", "--cached", "--others", "--exclude-standard"], cwd=root, capture_output=True, check=True)  # however long it takes: a walk lists by other rules
    except (OSError, subprocess.SubprocessError):
        return None
    return [p for p in said.stdout.decode("utf-8", "surrogateescape").split("\0") if p]


def by_walk(root: str) -> list[str]:
    """All files but those in skipped or dotted folders; links are not followed, unreadable folders are left out."""
    found, todo = [], [""]
    while todo:
        at = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, at)))
        except OSError:
            continue
        for e in entries:
            path = f"{at}/{e.name}" if at else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIPPED and not e.name.startswith("."):
                    todo.append(path)
            elif e.is_file(follow_symlinks=False):
                found.append(path)
    return found


def discover(root: str) -> list[tuple[str, float, int]]:
    """(path, mtime_ms, size) of the source files that exist, sorted."""
    names = by_git(root)
    out = []
    for path in sorted({p for p in (by_walk(root) if names is None else names) if is_source(p)}):
        try:
            s = os.lstat(os.path.join(root, path))
        except OSError:
            continue
        out.append((path, s.st_mtime_ns / 1e6, s.st_size))
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(discover(root), LISTING)


def contents(listed: DataFrame, root: str) -> DataFrame:
    """listed with content, read where the task runs; files that can't be read are left out (and stay due)."""
    names = [*listed.columns, "content"]

    def read(batches):
        for pdf in batches:
            texts = []
            for p in pdf["path"]:
                try:
                    texts.append(Path(root, p).read_text("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            pdf["content"] = texts
            yield pdf[names]

    return listed.mapInPandas(read, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema) + ", content string").filter("content is not null")


def sources(files: DataFrame) -> DataFrame:
    """Rows of a (path, content, ...) table that are sources, with their grammar."""
    return files.filter(is_source_file(F.col("path"))).withColumn("grammar", grammar_of(F.col("path")))


# ---- configuration


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings are left alone."""
    out = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or " ", text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], out)


def read_config(path: str) -> dict | None:
    try:
        found = json.loads(strip_jsonc(Path(path).read_text("utf-8-sig")))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def alias_rows(root: str) -> list[tuple[int, str, bool, list[str]]]:
    """(alias_ord, prefix, wildcard, targets) of the first configuration that has paths."""
    for name in ("tsconfig.base.json", "tsconfig.json"):
        options = (read_config(os.path.join(root, name)) or {}).get("compilerOptions")
        paths = options.get("paths") if isinstance(options, dict) else None
        if isinstance(paths, dict):
            base = options.get("baseUrl") or "."
            rows = [(k, [os.path.normpath(os.path.join(base, t)) for t in v if isinstance(t, str)]) for k, v in paths.items() if isinstance(v, list)]
            return [(i, k.removesuffix("*"), k.endswith("*"), v) for i, (k, v) in enumerate(rows)]
    return []


def aliases(spark: SparkSession, root: str) -> DataFrame | None:
    rows = alias_rows(root)
    return spark.createDataFrame(rows, "alias_ord int, prefix string, wildcard boolean, targets array<string>") if rows else None


def project_of(root: str, path: str) -> str | None:
    """The nearest configuration above a file whose include patterns hold it (no patterns hold everything below)."""
    from ..functions.exprs import glob_regex

    at = os.path.dirname(path)
    while True:
        for name in CONFIGS:
            config = read_config(os.path.join(root, at, name))
            if config is None:
                continue
            inside = os.path.relpath(path, at or ".")
            patterns = [*config.get("include", []), *config.get("files", [])]
            if not patterns or any(re.search(glob_regex(p.removeprefix("./") if re.search(r"[*?]|\.\w+$", p) else p.rstrip("/") + "/**", r"\A", r"\Z"), inside) for p in patterns):
                return os.path.normpath(os.path.join(at, name))
        if not at:
            return None
        at = os.path.dirname(at)
