"""Scalar and array expressions. All are built from JVM functions; user text never becomes SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193
# Commands that count as a text search.
SEARCH_COMMANDS = "grep rg ripgrep fgrep egrep ag ack"
# Patterns of source, declaration and test files.
# The extensions of source files, and of those among them that only declare.
SOURCE_EXTENSIONS, DECLARATION_EXTENSIONS = "ts tsx mts cts js jsx mjs cjs".split(), "d.ts d.mts d.cts".split()
SOURCE_FILE = rf"\A.*\.(?:{'|'.join(SOURCE_EXTENSIONS)})\z"
DECLARATION_FILE = rf"\.(?:{'|'.join(map(re.escape, DECLARATION_EXTENSIONS))})\z"
TEST_FILE = r"(?i)\.(?:spec|test)\.|(?:^|/)__(?:mocks|tests)__/|(?:^|/)testing/|(?:^|[/._-])mock"


def glob_regex(glob: str, start: str = r"\A", end: str = r"\z") -> str:
    """An anchored regex of a path glob: ** crosses slashes and takes one slash after it, * and ? do not cross; all else is literal."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    known = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
    return start + "".join(known.get(p) or re.sub(r"([^\w/ -])", r"\\\1", p) for p in parts) + end


def matches_glob(column: Column, glob: str | None) -> Column:
    """Whether the whole value matches; no glob matches everything."""
    return F.lit(True) if not glob else column.rlike("(?s)" + glob_regex(glob))


def round2(column: Column) -> Column:
    """To two places, halves up as floor(100 x + 0.5) / 100 (which is not round(x, 2) where 100 x is inexact)."""
    return F.floor(column * 100 + 0.5) / 100


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("long")


def fnv1a32(column: Column) -> Column:
    """Unsigned 32-bit FNV-1a over a string's UTF-16 code units, as a long; null for null."""
    plain = F.filter(F.transform(F.split(column, ""), lambda c: F.ascii(c).cast("long")), lambda c: c > 0)
    raw = F.hex(F.encode(column, "UTF-16BE"))
    at = F.when(F.length(raw) > 0, F.sequence(F.lit(0), F.length(raw).cast("int") - 1, F.lit(4))).otherwise(F.array().cast("array<int>"))
    units = F.transform(at, lambda i: F.conv(F.substr(raw, i + 1, F.lit(4)), 16, 10).cast("long"))
    ascii_only = (F.octet_length(column) == F.length(column)) & (F.instr(column, "\0") == 0)  # no unit beyond a byte, and none that splitting drops
    fold = lambda codes: F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(column.isNull(), F.lit(None).cast("long")).when(ascii_only, fold(plain)).otherwise(fold(units))


def k_grams(items: Column, k: int, separator: str = "\x01") -> Column:
    """Distinct, sorted joined runs of k array items; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(items) - (k - 1)), lambda i: F.array_join(F.slice(items, i, k), separator))
    return F.when(F.size(items) >= k, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<string>"))


def shingles(types: Column, k: int = 3) -> Column:
    """Sorted distinct hashes of the k-grams of a sequence of node types."""
    return F.array_sort(F.array_distinct(F.transform(k_grams(types, k), fnv1a32)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all items of two sets, 0 of two empty ones."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(0.0)


def one_line(column: Column, limit: int) -> Column:
    """White space runs as one blank, trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(column, r"[\s\x{A0}\x{FEFF}\x{2028}\x{2029}]+", " ")), 1, limit)


def hash16(column: Column) -> Column:
    """First 16 hex digits of SHA-1, of the empty string for null."""
    return F.substring(F.sha1(F.coalesce(column, F.lit(""))), 1, 16)


# ---- paths


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"(?:^|/)[^/]*\z", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1)


def normalize(path: Column) -> Column:
    """Without empty and dot segments; each .. takes the segment before it away, where there is one."""

    def fold(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0)
        return (
            F.when(part.isin("", "."), done)
            .when(up & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold), "/")


def is_source_file(path: Column) -> Column:
    return path.rlike(SOURCE_FILE) & ~path.rlike(DECLARATION_FILE)


def grammar_of(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == ".tsx", "tsx").when(ext.isin(".ts", ".mts", ".cts"), "typescript").when(ext.isin(".js", ".jsx", ".mjs", ".cjs"), "javascript")


def is_external_file(path: Column) -> Column:
    """Outside the graph: declaration files, installed packages, tests and mocks (by relative path)."""
    return path.rlike(DECLARATION_FILE) | path.rlike(r"(?:^|/)node_modules/") | path.rlike(TEST_FILE)


# ---- logs


def is_search_command(command: Column) -> Column:
    """Whether any part of a shell line, between newlines, semicolons, pipes and ampersands, begins with a text search."""
    first = rf"^\s*(?:(?:{'|'.join(SEARCH_COMMANDS.split())})|git\s+grep)\b"
    return F.exists(F.split(command, r"[\n;|&]+"), lambda part: part.rlike(first))


def tool_kind(name: Column, command: Column, own_prefix: str) -> Column:
    """own, grep (file globs too) or search; null for calls that are none."""
    return (
        F.when(name.startswith(own_prefix), "own")
        .when(name.isin("Grep", "Glob"), "grep")
        .when(name == "ToolSearch", "search")
        .when((name == "Bash") & F.coalesce(is_search_command(command), F.lit(False)), "grep")
    )


# ---- references


def reference_kind(node: Column, parent: Column, field: Column) -> Column:
    """Kind of a name's occurrence, from its node, its parent and its place there; the first rule that holds counts."""
    return (
        F.when(node == "type_identifier", "type")
        .when((parent == "call_expression") & (field == "function"), "call")
        .when((parent == "new_expression") & (field == "constructor"), "new")
        .when((parent == "member_expression") & (field == "object"), "access")
        .when(parent.isin("import_specifier", "namespace_import", "import_clause"), "import")
        .when(parent.isin("extends_clause", "class_heritage", "implements_clause"), "extends")
        .otherwise("identifier")
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
