"""What one source file says, as rows: definitions, imports, fingerprints, occurrences, and the tables of the typed tier."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property, lru_cache

from ..functions.exprs import FNV_OFFSET, FNV_PRIME
from .parser import FUNCTIONS, Node, parse

SIGNATURE, SNIPPET, CALLEE, LEAST_TOKENS = 200, 120, 40, 20
BLANKS = re.compile(r"[\s﻿]+")
# Nodes whose `name` is a declaration and no reference.
DECLARES = frozenset("class_declaration abstract_class_declaration function_declaration generator_function_declaration function_signature interface_declaration type_alias_declaration enum_declaration method_definition variable_declarator internal_module module".split())
# Kinds of definitions by node type.
KINDS = {
    "function_declaration": "function", "generator_function_declaration": "function", "function_signature": "function",
    "class_declaration": "class", "abstract_class_declaration": "class", "class": "class",
    "method_definition": "method", "method_signature": "method", "abstract_method_signature": "method",
    "interface_declaration": "interface", "type_alias_declaration": "type", "enum_declaration": "enum",
    "internal_module": "module", "module": "module",
}
# Nodes that are functions as values, branches, error handling, and classes.
FUNCTION_VALUES = frozenset("arrow_function function_expression generator_function".split())
BRANCHES = frozenset("if_statement ternary_expression switch_case".split())
ERRORS = frozenset("try_statement throw_statement".split())
CLASSES = frozenset("class_declaration abstract_class_declaration class".split())
# Nodes that names are declared in, and types whose one argument stands for them.
SCOPES = FUNCTIONS | {"statement_block", "for_statement", "for_in_statement", "catch_clause", "switch_body", "class_static_block"}
TRANSPARENT = frozenset("Promise Readonly Partial Required".split())
# Methods that hand their elements to the first parameter of a function.
EACH = frozenset("forEach map filter find findIndex findLast some every flatMap".split())
LITERALS = {"number": "number", "string": "string", "template_string": "string", "true": "boolean", "false": "boolean", "null": "null"}
NO_ORIGIN = dict.fromkeys(("via_kind", "via_form", "via_receiver", "via_name", "via_cls", "via_args"))
PARAMETERS = 8  # of a type or function that are told apart

Row = dict


@lru_cache(1 << 16)
def gram_hash(*types: str) -> int:
    """exprs.fnv1a32 of node types joined as in exprs.k_grams; there are few different runs of them, so nearly all are found."""
    h = FNV_OFFSET
    for c in "\x01".join(types).encode("ascii"):
        h = (h ^ c) * FNV_PRIME & 0xFFFFFFFF
    return h


class File:
    def __init__(self, path: str, source: str, grammar: str):
        self.path, self.source, self.grammar = path, source, grammar
        self.root, self.errors = parse(source, grammar)
        self.breaks = [m.start() for m in re.finditer("\n", source)]

    @cached_property
    def nodes(self) -> list[Node]:
        return self.root.walk()

    # ---- positions and texts

    def line(self, pos: int) -> int:
        return bisect_right(self.breaks, pos - 1) + 1 if pos else 1

    def column(self, pos: int) -> int:
        line = self.line(pos)
        return pos - (self.breaks[line - 2] + 1 if line > 1 else 0) + 1

    def text(self, node: Node | None) -> str:
        return self.source[node.start : node.end] if node else ""

    def bare_text(self, node: Node | None) -> str:
        """The text of a name without type arguments that follow it."""
        args = node.get("type_arguments") if node else None
        return self.source[node.start : args.start].strip() if args is not None else self.text(node)

    def snippet(self, pos: int) -> str:
        line = self.line(pos)
        a = self.breaks[line - 2] + 1 if line > 1 else 0
        b = self.breaks[line - 1] if line <= len(self.breaks) else len(self.source)
        return self.source[a:b].strip()[:SNIPPET]

    def header(self, node: Node) -> str:
        """The text up to a function's or declaration's body, on one line."""
        body = node.get("body")
        if body is None and (value := node.get("value")) is not None:
            inner = value.get("body")
            body = inner if inner is not None and inner.type == "statement_block" else None
        end = body.start if body is not None else node.end
        text = BLANKS.sub(" ", self.source[node.start : end]).strip()
        return text[:SIGNATURE]

    # ---- definitions

    def defs(self) -> list[Row]:
        found: dict[tuple[str, int], Row] = {}

        def put(name: Node | None, kind: str, node: Node) -> None:
            symbol = self.text(name).strip("\"'`") if name is not None else ""
            if not symbol or symbol == "constructor":
                return
            row = {"symbol": symbol, "kind": kind, "line": self.line(name.start), "signature": self.header(node), "ord": len(found)}
            old = found.get(key := (symbol, row["line"]))
            if old is None:
                found[key] = row
            elif old["kind"] == "constant" and kind != "constant":
                found[key] = row | {"ord": old["ord"]}

        for node in self.nodes:
            if node.type in KINDS:
                put(node.get("name"), KINDS[node.type], node)
            elif node.type == "variable_declarator":
                value = node.get("value")
                if value is not None and value.type in FUNCTION_VALUES:
                    put(node.get("name"), "function", node)
                declaration = node.parent
                if declaration.parent is not None and declaration.parent.type == "export_statement" and self.source.startswith("const", declaration.start):
                    if node.get("name").type == "identifier":
                        put(node.get("name"), "constant", declaration.parent)
            elif node.type in ("assignment_expression", "pair"):
                value = node.get("right") or node.get("value")
                if value is not None and value.type in FUNCTION_VALUES:
                    name = node.get("left") or node.get("key")
                    if name.type == "member_expression":
                        name = name.get("property")
                    if name is not None and name.type in ("identifier", "property_identifier"):
                        put(name, "function", node)
        return list(found.values())

    # ---- imports

    def edges(self) -> list[Row]:
        out = []
        for node in self.root.kids:
            source = node.get("source")
            if node.type not in ("import_statement", "export_statement") or source is None:
                continue
            names, star = [], False
            specifier = self.text(source).strip("\"'`")
            if node.type == "import_statement":
                clause = next((k for k in node.kids if k.type == "import_clause"), None)
                for k in clause.kids if clause else ():
                    if k.type == "identifier":
                        names.append(("default", self.text(k)))
                    elif k.type == "namespace_import":
                        star = True
                        names.append(("*", self.text(k.kids[0])))
                    else:
                        names += [self.specifier(s) for s in k.kids]
            else:
                clause = next((k for k in node.kids if k.type == "export_clause"), None)
                space = next((k for k in node.kids if k.type == "namespace_export"), None)
                star = clause is None
                if space is not None:
                    names.append(("*", self.text(space.kids[0])))
                names += [self.specifier(s) for s in clause.kids] if clause else []
            kind = "import" if node.type == "import_statement" else "re-export"
            out.append({"specifier": specifier, "kind": kind, "star": star, "names": [{"imported": i, "local": n} for i, n in names], "line": self.line(node.start)})
        return out

    def exports(self) -> list[Row]:
        """Names a file exports under another name: its default, and those of export lists without a source."""
        out = []
        for node in self.root.kids:
            if node.type != "export_statement" or node.get("source") is not None:
                continue
            clause = next((k for k in node.kids if k.type == "export_clause"), None)
            pairs = [self.specifier(s) for s in clause.kids] if clause else []
            if self.source[node.start : node.end].startswith("export default"):
                held = node.get("declaration") or node.get("value")
                name = held if held is not None and held.type == "identifier" else held and held.get("name")
                pairs = [(self.text(name), "default")] if name is not None else []
            out += [{"exported": exported, "local": local} for local, exported in pairs if exported != local]
        return out

    def specifier(self, node: Node) -> tuple[str, str]:
        name, alias = self.text(node.get("name")).strip("\"'"), node.get("alias")
        return name, self.text(alias).strip("\"'") if alias else name

    # ---- functions

    def function_name(self, node: Node) -> str:
        """Its own name, or that of the variable or property that holds it."""
        name = node.get("name") or (node.parent and (node.parent.get("name") or node.parent.get("key") or node.parent.get("property")))
        if name is None and node.parent is not None and node.parent.type == "assignment_expression":
            left = node.parent.get("left")
            name = left.get("property") if left.type == "member_expression" else left
        return self.text(name)

    def class_of(self, node: Node) -> str | None:
        at = node.parent
        while at is not None and at.type not in CLASSES | {"interface_declaration"}:
            if at.type in FUNCTIONS and at.type != "arrow_function":
                return None
            at = at.parent
        return self.text(at.get("name")) if at is not None else None

    def fingerprints(self) -> list[Row]:
        """Node types of every function, in order of appearance, where there are enough, and the sorted hashes of their runs of three."""
        out = []
        for node in self.nodes:
            if node.type in FUNCTIONS:
                types = [n.type for n in node.walk()]
                if len(types) >= LEAST_TOKENS:
                    line = self.line(node.start)
                    grams = sorted({gram_hash(*g) for g in zip(types, types[1:], types[2:])})
                    out.append({"name": self.function_name(node) or f"anonymous@{line}", "line": line, "types": types, "shingles": grams})
        return out

    def functions(self) -> tuple[list[Row], list[Row]]:
        """Every function with a body or signature, and the calls in it, nested functions' included."""
        functions, calls = [], []
        for node in self.nodes:
            if node.type not in FUNCTIONS and node.type not in ("function_signature", "method_signature", "abstract_method_signature"):
                continue
            own, cls = node.get("name"), self.class_of(node) if node.type != "arrow_function" or (node.parent and "field" in node.parent.type) else None
            name = self.function_name(node) or "(anonymous)"
            kind = "method" if cls is not None and node.type != "function_signature" else "function"
            shown = f"{cls}.constructor" if name == "constructor" else name
            fn = {
                "start": node.start, "name": name, "shown": shown, "cls": cls, "kind": kind, "has_body": node.get("body") is not None,
                "line": self.line((own or node).start), "branches": 0, "errors": 0, "awaits": 0, "top": self.is_top(node),
                "returns": self.returned(node), "gives": self.given(node), "params": self.parameters(node),
            }
            functions.append(fn)
            body = node.get("body")
            found = 0
            for at in body.walk() if body is not None else ():
                fn["branches"] += at.type in BRANCHES
                fn["errors"] += at.type in ERRORS
                fn["awaits"] += at.type == "await_expression"
                if at.type in ("call_expression", "new_expression"):
                    calls.append({"caller": node.start, "ord": found} | self.callee(at))
                    found += 1
        return functions, calls

    def is_top(self, node: Node) -> bool:
        """Whether a name declared here is visible in the whole file."""
        at = node.parent
        while at is not None and at.type in ("variable_declarator", "lexical_declaration", "variable_declaration", "export_statement", "ambient_declaration", "expression_statement"):
            at = at.parent
        return at is None or at.type == "program"

    def callee(self, call: Node) -> Row:
        """How a call names what it calls: form (name, this, field, variable, super, other), receiver and name."""
        target = call.get("function") or call.get("constructor")
        text = BLANKS.sub(" ", self.text(target))[:CALLEE]
        kind = "new" if call.type == "new_expression" else "call"
        form, receiver, name = self.access(target)
        return {"kind": kind, "form": form, "receiver": receiver, "name": name, "text": text, "pos": target.start}

    def arguments(self, call: Node) -> list[str]:
        """Type terms of a call's arguments: of literals and `new`, "?" for any other."""
        list_ = call.get("arguments")
        kids = list_.kids if list_ is not None and list_.type == "arguments" else []
        if any(k.type == "spread_element" for k in kids):
            return ["..."]
        return [LITERALS.get(k.type) or (self.term(k) if k.type == "new_expression" else "number" if k.type == "unary_expression" and k.kids and k.kids[-1].type == "number" else "?") for k in kids]

    def access(self, target: Node) -> tuple[str, str | None, str | None]:
        """How an expression names a function or member: form, receiver and name. What comes of a call or a longer chain is
        held under a name of its own, "#" and its end (see bindings)."""
        if target.type == "identifier":
            return "name", None, self.bare_text(target)
        if target.type == "super":
            return "super", None, "constructor"
        name = self.member(target)
        if name is None:
            return "other", None, None
        obj = self.bare(target.get("object"))
        if obj.type in ("this", "super"):
            return obj.type, None, name
        if obj.type == "identifier":
            return "variable", self.text(obj), name
        if (field := self.member(obj)) is not None and obj.get("object").type == "this":
            return "field", field, name
        if (made := self.type_name(obj)) is not None:
            return "typed", made, name
        if obj.type in ("call_expression", "member_expression", "subscript_expression"):
            return "variable", f"#{obj.end}", name
        return "other", None, name

    def member(self, node: Node) -> str | None:
        """The name of a member access: after a dot, or a plain string in brackets."""
        if node.type == "member_expression":
            return self.text(node.get("property"))
        index = node.get("index") if node.type == "subscript_expression" else None
        return self.text(index)[1:-1] if index is not None and index.type == "string" else None

    def bare(self, node: Node | None) -> Node | None:
        """An expression without parentheses, `!` and await around it."""
        while node is not None and node.type in ("non_null_expression", "parenthesized_expression", "await_expression") and node.kids:
            node = node.kids[0]
        return node

    def origin(self, node: Node | None) -> Row | None:
        """The call, member or element whose type an expression has."""
        node = self.bare(node)
        if node is not None and node.type == "subscript_expression" and self.member(node) is None:
            return self.element(node.get("object"))
        if node is None or node.type not in ("call_expression", "member_expression", "subscript_expression"):
            return None
        target = node.get("function") if node.type == "call_expression" else node
        form, receiver, name = self.access(target)
        if form == "other" or target.type == "super":
            return None
        args = self.arguments(node) if target is not node else None
        return {"via_kind": "call" if target is not node else "access", "via_form": form, "via_receiver": receiver, "via_name": name, "via_cls": self.this_class(node) if form in ("this", "field", "super") else None, "via_args": args}

    def element(self, node: Node | None, kind: str = "element") -> Row | None:
        """The elements of what an expression holds."""
        node = self.bare(node)
        if node is None:
            return None
        held = {"via_kind": kind, "via_name": None, "via_cls": None, "via_args": None}
        if node.type == "identifier":
            return held | {"via_form": "variable", "via_receiver": self.text(node)}
        if (name := self.member(node)) is not None and node.get("object").type == "this":
            return held | {"via_form": "field", "via_receiver": name, "via_cls": self.this_class(node)}
        return held | {"via_form": "variable", "via_receiver": f"#{node.end}"} if node.type in ("call_expression", "member_expression", "subscript_expression") else None

    # ---- types

    def returned(self, node: Node) -> str | None:
        """The class a function gives: declared, or the one that all its returns name; "this" for its own object."""
        declared = node.get("return_type")
        if declared is not None:
            kinds = [k.type for k in declared.kids]
            return "this" if kinds == ["this_type"] else self.type_name(declared)
        body = node.get("body")
        if body is None:
            return None
        given = [body] if body.type != "statement_block" else [k.kids[0] if k.kids else None for k in self.own(body) if k.type == "return_statement"]
        found = {"this" if k is not None and k.type == "this" else self.type_name(k) for k in map(self.bare, given)}
        return found.pop() if len(found) == 1 else None

    def own(self, node: Node):
        """The nodes below one, without those of functions in it."""
        left = list(node.kids)
        while left:
            k = left.pop()
            yield k
            if k.type not in FUNCTIONS:
                left += k.kids

    def type_name(self, node: Node | None) -> str | None:
        """The one named type of an annotation or of a `new` expression."""
        if node is None:
            return None
        if node.type == "new_expression":
            made = node.get("constructor")
            return self.bare_text(made) if made.type == "identifier" else None
        if node.type == "type_annotation":
            node = node.kids[0] if node.kids else None
        while node is not None and node.type in ("generic_type", "parenthesized_type", "as_expression"):
            if node.type == "generic_type" and self.text(node.get("name")) in ("Promise", "Readonly", "Partial", "Required"):
                args = node.get("type_arguments")
                node = args.kids[0] if args and args.kids else None
            else:
                node = node.get("name") if node.type == "generic_type" else node.kids[-1]
        if node is not None and node.type == "union_type":
            named = [k for k in node.walk() if k.type == "type_identifier"]
            node = named[0] if len(named) == 1 else None
        return self.text(node) if node is not None and node.type == "type_identifier" else None

    def term(self, node: Node | None) -> str | None:
        """A type as a term: its name and, in angles, the terms of its arguments; "?" for what has no name.

        Parameters of the class around it are ^0, ^1, ..., those of the function ~0, ~1, ...; T[] is Array<T>.
        """
        if node is None:
            return None
        if node.type in ("type_annotation", "parenthesized_type", "as_expression", "readonly_type"):
            return self.term(node.kids[-1]) if node.kids else None
        if node.type == "array_type":
            return f"Array<{self.term(node.kids[0])}>" if node.kids else "Array<?>"
        if node.type == "union_type":
            named = [k for k in node.kids if k.type in ("type_identifier", "generic_type", "array_type")]
            plain = [k for k in node.kids if self.text(k) in ("null", "undefined")]
            return self.term(named[0]) if len(named) == 1 and len(named) + len(plain) == len(node.kids) else "?"
        if node.type == "predefined_type":
            return self.text(node)
        if node.type in ("type_identifier", "identifier", "generic_type", "new_expression"):
            held = node.get("constructor") if node.type == "new_expression" else node
            args = held.get("type_arguments") or node.get("type_arguments")
            named = held.get("name") if held.type == "generic_type" else held
            if named.type not in ("type_identifier", "identifier"):
                return "?"
            name = self.bare_text(named)
            terms = [self.term(k) for k in args.kids] if args is not None else []
            if name in TRANSPARENT and len(terms) == 1:
                return terms[0]
            return self.parameter(node, name) or name + (f"<{','.join(terms)}>" if terms else "")
        return "?"

    def parameter(self, node: Node, name: str) -> str | None:
        """^i or ~i where a name is a type parameter of the class or function around a place."""
        at = node.parent
        while at is not None:
            held = at.get("type_parameters")
            names = [self.text(k.get("name")) for k in held.kids if k.type == "type_parameter"] if held is not None else []
            if name in names:
                i = names.index(name)
                return "?" if i >= PARAMETERS else f"{'^' if at.type in CLASSES or at.type == 'interface_declaration' else '~'}{i}"
            at = at.parent
        return None

    def given(self, node: Node) -> str | None:
        """The term of what a function gives: declared, or as its returns name it; `this` for its own object."""
        if self.returned(node) == "this":
            return "this"
        declared = node.get("return_type")
        return self.term(declared) if declared is not None else self.returned(node)

    def parameters(self, node: Node) -> list[str]:
        """Terms of a function's parameters, optional ones with "=", the rest with "..." before them."""
        held = node.get("parameters")
        out = []
        for k in held.kids if held is not None else [node.get("parameter")] if node.get("parameter") is not None else []:
            if k.type not in ("required_parameter", "optional_parameter"):
                out.append("?")
                continue
            rest = k.get("pattern") is not None and k.get("pattern").type == "rest_pattern"
            loose = k.type == "optional_parameter" or k.get("value") is not None
            out.append(("..." if rest else "=" if loose else "") + (self.term(k.get("type")) or "?"))
        return out

    def heritage(self) -> tuple[list[Row], list[Row]]:
        """Classes and interfaces, and their parents."""
        types, parents = [], []
        for node in self.nodes:
            if node.type not in CLASSES and node.type != "interface_declaration":
                continue
            name = self.text(node.get("name"))
            if not name:
                continue
            interface = node.type == "interface_declaration"
            held = node.get("type_parameters")
            types.append({"name": name, "kind": "interface" if interface else "class", "line": self.line(node.get("name").start), "params": min(PARAMETERS, len(held.kids)) if held is not None else 0})
            clauses = node.get("heritage")
            for k in (clauses.walk() if clauses is not None else ()):
                if k.type in ("type_identifier", "identifier") and (k.parent.type in ("extends_clause", "implements_clause", "extends_type_clause", "class_heritage") or k.parent.type == "generic_type" and k.field == "name"):
                    at = k.parent if k.parent.type != "generic_type" else k.parent.parent
                    args = k.parent.get("type_arguments") if k.parent.type == "generic_type" else k.get("type_arguments") or k.parent.get("type_arguments")
                    parents.append({"name": name, "parent": self.bare_text(k), "args": [self.term(x) for x in args.kids] if args is not None else [], "kind": "implements" if at.type == "implements_clause" else "extends"})
        return types, parents

    def bindings(self) -> list[Row]:
        """Names declared in a file, with a type or with the call, member or element their type comes from, or with neither.

        scope and until bound the place where a name is seen, null for the whole file; cls is set for fields. Names of the
        whole file are listed only with a type. Calls and chains that are receivers themselves have rows too.
        """
        out = []

        def put(name: str, annotation: Node | None, value: Node | None, scope: Node | None, cls: str | None, via: Row | None = None) -> None:
            type_, term = self.type_name(annotation), self.term(annotation)
            if annotation is None and (held := self.bare(value)) is not None:
                type_, term = self.type_name(held), self.term(held) if held.type in ("new_expression", "as_expression") else None
            via = (via or self.origin(value)) if annotation is None and not type_ else None  # what is declared isn't traced
            term = None if term == "?" else term
            if name and (term or via or scope is not None):
                at = value or annotation or scope
                out.append({"scope": scope.start if scope else None, "until": scope.end if scope else None, "cls": cls, "name": name, "type": type_, "term": term, "pos": at.start if at else 0, **(via or NO_ORIGIN)})

        for node in self.nodes:
            annotation, value, kind = node.get("type"), node.get("value"), node.type
            if kind in ("member_expression", "subscript_expression"):
                held = self.bare(node.get("object"))
                if self.access(node)[1] == f"#{held.end}" or self.member(node) is None and (self.element(held) or {}).get("via_receiver") == f"#{held.end}":
                    put(f"#{held.end}", None, held, None, None)
            elif kind == "variable_declarator":
                loop = node.parent.parent if node.parent is not None else None
                each = self.element(loop.get("right")) if loop is not None and loop.type == "for_in_statement" and " of " in self.source[node.end : loop.get("right").start].join("  ") else None
                if each is not None and each["via_receiver"].startswith("#"):
                    put(each["via_receiver"], None, self.bare(loop.get("right")), None, None)
                self.declare(put, node.get("name"), annotation, value, self.scope_of(node, node.parent.type == "variable_declaration"), each)
            elif kind in ("required_parameter", "optional_parameter"):
                owner = node.parent.parent
                if owner.type not in FUNCTIONS:
                    continue
                self.declare(put, node.get("pattern"), annotation, value, owner, self.handed(owner, node))
                if node.get("modifier") is not None:
                    put(self.text(node.get("pattern")), annotation, value, None, self.class_of(owner))
            elif kind == "arrow_function" and node.get("parameter") is not None:
                self.declare(put, node.get("parameter"), None, None, node, self.handed(node, node.get("parameter")))
            elif kind == "catch_clause" and node.get("parameter") is not None:
                self.declare(put, node.get("parameter"), None, None, node, None)
            elif kind in ("function_declaration", "generator_function_declaration"):
                self.declare(put, node.get("name"), None, None, self.scope_of(node, False), None)
            elif kind in ("public_field_definition", "field_definition", "property_signature"):
                put(self.text(node.get("name") or node.get("property")), annotation, value, None, self.class_of(node))
        return out

    def declare(self, put, pattern: Node | None, annotation: Node | None, value: Node | None, scope: Node | None, via: Row | None) -> None:
        """Put the names of a pattern; only a plain name has the type of the whole."""
        if pattern is None:
            return
        if pattern.type == "identifier":
            put(self.text(pattern), annotation, value, scope, None, via)
        elif pattern.type == "rest_pattern" and pattern.kids and pattern.kids[-1].type == "identifier":
            put(self.text(pattern.kids[-1]), annotation, None, scope, None)
        else:
            for name in self.names_in(pattern):
                put(name, None, None, scope, None)

    def names_in(self, pattern: Node):
        if pattern.type in ("identifier", "shorthand_property_identifier_pattern"):
            yield self.text(pattern)
        for k in pattern.kids:
            if not (pattern.type == "pair_pattern" and k.field == "key" or pattern.type == "assignment_pattern" and k.field == "right" or k.type == "type_annotation"):
                yield from self.names_in(k)

    def handed(self, function: Node, parameter: Node) -> Row | None:
        """The container whose elements a method hands to the first parameter of a function."""
        held = function.parent
        call = held.parent if held is not None and held.type == "arguments" else None
        target = call.get("function") if call is not None and call.type == "call_expression" else None
        first = function.get("parameter") or (function.get("parameters").kids[0] if function.get("parameters") is not None and function.get("parameters").kids else None)
        if target is None or target.type != "member_expression" or held.kids[0] is not function or first is not parameter or self.text(target.get("property")) not in EACH:
            return None
        via = self.element(target.get("object"), "handed")
        return via and via | {"pos": target.start}

    def scope_of(self, node: Node, whole: bool) -> Node | None:
        """The nearest node around one that its name is declared in: a function where `whole`, else any scope."""
        at = node.parent
        while at is not None and at.type not in (FUNCTIONS if whole else SCOPES):
            at = at.parent
        return at

    def scope(self, node: Node) -> int | None:
        at = self.scope_of(node, True)
        return at.start if at is not None else None

    # ---- occurrences

    def occurrences(self, name: str) -> list[Row]:
        """References to a name, in value or type position, with what stands around them."""
        out = []
        if name not in self.source:
            return out
        for node in self.nodes:
            if node.type not in ("identifier", "type_identifier") or self.text(node) != name:
                continue
            parent = node.parent
            if parent is not None and parent.type in DECLARES and node.field == "name":
                continue
            out.append({
                "line": self.line(node.start), "column": self.column(node.start), "snippet": self.snippet(node.start),
                "node": node.type, "parent": parent.type if parent else "", "field": node.field,
            })
        return out

    def member_names(self, name: str) -> list[Row]:
        """Uses of a name as a member: receiver as for calls, and the function they stand in."""
        out = []
        if name not in self.source:
            return out
        for node in self.nodes:
            if node.parent is None or node.field not in ("property", "index") or self.member(node.parent) != name:
                continue
            use, member = node.parent.parent, node.parent
            called = use is not None and use.type in ("call_expression", "new_expression") and member.field in ("function", "constructor")
            kind = "access" if not called else "new" if use.type == "new_expression" else "call"
            form, receiver, _ = self.access(member)
            out.append({"line": self.line(node.start), "column": self.column(node.start), "snippet": self.snippet(node.start), "kind": kind, "form": form, "receiver": receiver, "pos": member.start, "cls": self.this_class(node)})
        return out

    def this_class(self, node: Node) -> str | None:
        """The class that `this` means at a node."""
        at = node
        while at.parent is not None and (at.type not in FUNCTIONS or at.type == "arrow_function"):
            at = at.parent
        return self.class_of(at if at.type in FUNCTIONS else node)


def extract(path: str, source: str, grammar: str) -> dict:
    """All tables of one file."""
    f = File(path, source, grammar)
    functions, calls = f.functions()
    types, parents = f.heritage()
    return {
        "defs": f.defs(), "edges": f.edges(), "fingerprints": f.fingerprints(), "functions": functions, "calls": calls,
        "types": types, "heritage": parents, "exports": f.exports(), "bindings": f.bindings(), "errors": f.errors,
    }
