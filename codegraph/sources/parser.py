"""A tolerant parser for TypeScript and JavaScript that builds a small syntax tree.

Node types carry the names that grammars of these languages use in public (call_expression, type_identifier and so on).
What cannot be parsed is skipped a token at a time and kept as an ERROR node, so later statements are still found.
"""

from __future__ import annotations

from collections.abc import Callable

from .lexer import Lexer, Token


class Node:
    __slots__ = ("type", "start", "end", "kids", "parent", "field")

    def __init__(self, type_: str, start: int, end: int = -1):
        self.type, self.start, self.end = type_, start, end
        self.kids: list[Node] = []
        self.parent: Node | None = None
        self.field = ""

    def add(self, field: str, kid: Node | None) -> Node | None:
        if kid is not None:
            kid.parent, kid.field = self, field
            self.kids.append(kid)
        return kid

    def get(self, field: str) -> Node | None:
        for k in self.kids:
            if k.field == field:
                return k
        return None

    def walk(self) -> list[Node]:
        """The node and all below it, in order of appearance."""
        found, stack = [], [self]
        while stack:
            node = stack.pop()
            found.append(node)
            if node.kids:
                stack += node.kids[::-1]
        return found


class Unparsable(Exception):
    pass


# Binding strength of binary operators.
LEVELS = ["??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"]
BINARY = {op: n for n, ops in enumerate(LEVELS, 1) for op in ops.split()}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
MODIFIERS = frozenset("public private protected static readonly abstract override declare async accessor export default in out const".split())
PREDEFINED = frozenset("any unknown number string boolean symbol void never object bigint undefined null".split())
# Nodes that are functions.
FUNCTIONS = frozenset("function_declaration function_expression generator_function_declaration generator_function arrow_function method_definition".split())
DEPTH = 400  # nesting beyond which a file is given up where it stands; the place counts as a problem of the file, which answers report


class Parser:
    def __init__(self, source: str, typed: bool = True, jsx: bool = False):
        self.source, self.typed, self.jsx = source, typed, jsx
        self.lexer = Lexer(source)
        self.tok = self.lexer.at(0, None)
        self.last_end = 0
        self.not_arrow: set[int] = set()
        self.depth = 0
        self.errors = 0

    # ---- tokens

    def next(self) -> Token:
        token = self.tok
        self.last_end = token.end
        self.tok = self.lexer.at(token.end, token)
        return token

    def jump(self, pos: int, before: Token | None = None) -> None:
        self.last_end = pos
        self.tok = self.lexer.at(pos, before)

    def peek(self) -> Token:
        return self.lexer.at(self.tok.end, self.tok)

    def is_(self, *texts: str) -> bool:
        return self.tok.text in texts and self.tok.kind in ("punct", "name")

    def eat(self, text: str) -> bool:
        if self.is_(text):
            self.next()
            return True
        if text == ">" and self.tok.kind == "punct" and self.tok.text.startswith(">") and len(self.tok.text) > 1:
            t = self.tok  # one of several closing angles
            self.tok = Token("punct", t.text[1:], t.start + 1, t.end, False)
            self.last_end = t.start + 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            raise Unparsable(f"{text} at {self.tok.start}")

    def leaf(self, type_: str) -> Node:
        t = self.next()
        return Node(type_, t.start, t.end)

    def done(self, node: Node) -> Node:
        node.end = max(self.last_end, node.start)
        return node

    def attempt(self, f: Callable[[], Node | None]) -> Node | None:
        saved = self.tok, self.last_end, self.depth
        try:
            found = f()
        except Unparsable:
            found = None
        if found is None:
            self.tok, self.last_end, self.depth = saved
        return found

    def name(self, type_: str = "identifier") -> Node:
        if self.tok.kind != "name":
            raise Unparsable(f"name at {self.tok.start}")
        return self.leaf(type_)

    # ---- statements

    def program(self) -> Node:
        root = Node("program", 0)
        while self.tok.kind != "end":
            self.statements(root)
            if self.tok.kind != "end":  # a closing brace too many
                self.errors += 1
                root.add("", self.leaf("ERROR"))
        root.end = len(self.source)
        return root

    def statements(self, into: Node) -> None:
        while self.tok.kind != "end" and not self.is_("}"):
            at = self.tok.start
            try:
                self.depth = self.depth + 1
                if self.depth > DEPTH:
                    raise Unparsable("too deep")
                into.add("", self.statement())
            except (Unparsable, RecursionError):
                self.errors += 1
                error = Node("ERROR", at)
                if self.tok.start == at:
                    self.next()
                while not self.is_(";", "}", "{") and self.tok.kind != "end" and not self.tok.newline:
                    self.next()
                into.add("", self.done(error))
                if self.is_("{"):
                    into.add("", self.block())
            finally:
                self.depth -= 1

    def block(self) -> Node:
        node = Node("statement_block", self.tok.start)
        self.need("{")
        self.statements(node)
        self.need("}")
        return self.done(node)

    def end_statement(self) -> None:
        if not self.eat(";") and not (self.is_("}") or self.tok.kind == "end" or self.tok.newline):
            raise Unparsable(f"end of statement at {self.tok.start}")

    def statement(self) -> Node | None:
        t, start = self.tok, self.tok.start
        if t.kind == "punct":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.next()
                return self.done(Node("empty_statement", start))
            if t.text == "@":
                decorators = self.decorators()
                node = self.statement()
                if node is not None:
                    for d in reversed(decorators):
                        d.parent, d.field = node, "decorator"
                        node.kids.insert(0, d)
                    node.start = start if node.type == "export_statement" else node.start
                return node
        elif t.kind == "name":
            known = getattr(self, f"s_{t.text}", None) if t.text.isascii() else None
            if known is not None and (node := known()) is not None:
                return node
            if self.peek().text == ":" and self.peek().kind == "punct":
                node = Node("labeled_statement", start)
                node.add("label", self.name("statement_identifier"))
                self.next()
                node.add("body", self.statement())
                return self.done(node)
        node = Node("expression_statement", start)
        node.add("", self.expressions())
        self.end_statement()
        return self.done(node)

    def decorators(self) -> list[Node]:
        found = []
        while self.is_("@"):
            node = Node("decorator", self.tok.start)
            self.next()
            node.add("", self.postfix(self.primary(), calls=True))
            found.append(self.done(node))
        return found

    def s_var(self) -> Node | None:
        return self.declaration("variable_declaration")

    def s_const(self) -> Node | None:
        if self.peek().text == "enum":
            self.next()
            return self.s_enum()
        return self.declaration("lexical_declaration")

    def s_let(self) -> Node | None:
        p = self.peek()
        return self.declaration("lexical_declaration") if p.kind == "name" or p.text in "[{" else None

    def declaration(self, type_: str, in_for: bool = False) -> Node:
        node = Node(type_, self.tok.start)
        self.next()
        while True:
            d = Node("variable_declarator", self.tok.start)
            d.add("name", self.pattern())
            self.eat("!")
            if self.is_(":"):
                d.add("type", self.annotation())
            if self.is_("="):
                self.next()
                d.add("value", self.assignment(no_in=in_for))
            node.add("", self.done(d))
            if not self.eat(","):
                break
        if not in_for:
            self.end_statement()
        return self.done(node)

    def s_function(self) -> Node | None:
        return self.function(True)

    def s_async(self) -> Node | None:
        p = self.peek()
        return self.function(True) if p.text == "function" and not p.newline else None

    def function(self, declared: bool) -> Node:
        start = self.tok.start
        self.eat("async")
        self.need("function")
        star = self.eat("*")
        node = Node("function_declaration" if declared else "function_expression", start)
        if star:
            node.type = "generator_function_declaration" if declared else "generator_function"
        if self.tok.kind == "name":
            node.add("name", self.name())
        elif declared and not self.is_("("):
            raise Unparsable("function name")
        self.signature(node)
        if self.is_("{"):
            node.add("body", self.block())
        elif declared and self.typed:
            self.eat(";")
            node.type = "function_signature"
        else:
            raise Unparsable("function body")
        return self.done(node)

    def signature(self, node: Node) -> None:
        if self.is_("<"):
            node.add("type_parameters", self.type_parameters())
        node.add("parameters", self.parameters())
        if self.is_(":"):
            node.add("return_type", self.annotation())

    def parameters(self) -> Node:
        node = Node("formal_parameters", self.tok.start)
        self.need("(")
        while not self.is_(")"):
            p = Node("required_parameter" if self.typed else "parameter", self.tok.start)
            for d in self.decorators():
                p.add("decorator", d)
            while self.tok.text in MODIFIERS and self.tok.kind == "name" and (self.peek().kind == "name" or self.peek().text in ("{", "[", "...")):
                p.add("modifier", self.leaf("accessibility_modifier"))
            if self.is_("..."):
                rest = Node("rest_pattern", self.next().start)
                rest.add("", self.pattern())
                p.add("pattern", self.done(rest))
            else:
                p.add("pattern", self.pattern())
            if self.eat("?"):
                p.type = "optional_parameter"
            if self.is_(":"):
                p.add("type", self.annotation())
            if self.eat("="):
                p.add("value", self.assignment())
            node.add("", self.done(p) if self.typed else self.plain_parameter(p))
            if not self.eat(","):
                break
        self.need(")")
        return self.done(node)

    def plain_parameter(self, p: Node) -> Node:
        """JavaScript parameters have no node of their own."""
        pattern, value = p.get("pattern"), p.get("value")
        if value is None:
            return pattern
        node = Node("assignment_pattern", p.start)
        node.add("left", pattern)
        node.add("right", value)
        return self.done(node)

    def pattern(self) -> Node:
        start = self.tok.start
        if self.is_("["):
            node = Node("array_pattern", start)
            self.next()
            while not self.is_("]"):
                if self.eat(","):
                    continue
                node.add("", self.element_pattern())
                if not self.is_("]"):
                    self.need(",")
            self.need("]")
            return self.done(node)
        if self.is_("{"):
            node = Node("object_pattern", start)
            self.next()
            while not self.is_("}"):
                if self.is_("..."):
                    node.add("", self.element_pattern())
                else:
                    at, key = self.tok.start, self.property_name()
                    if self.eat(":"):
                        pair = Node("pair_pattern", at)
                        pair.add("key", key)
                        pair.add("value", self.element_pattern())
                        node.add("", self.done(pair))
                    else:
                        key.type = "shorthand_property_identifier_pattern"
                        if self.eat("="):
                            whole = Node("object_assignment_pattern", at)
                            whole.add("left", key)
                            whole.add("right", self.assignment())
                            key = self.done(whole)
                        node.add("", key)
                if not self.is_("}"):
                    self.need(",")
            self.need("}")
            return self.done(node)
        return self.name()

    def element_pattern(self) -> Node:
        start = self.tok.start
        if self.eat("..."):
            node = Node("rest_pattern", start)
            node.add("", self.pattern())
            return self.done(node)
        left = self.pattern()
        if self.eat("="):
            node = Node("assignment_pattern", start)
            node.add("left", left)
            node.add("right", self.assignment())
            return self.done(node)
        return left

    def s_class(self) -> Node | None:
        return self.class_("class_declaration")

    def s_abstract(self) -> Node | None:
        if self.peek().text != "class":
            return None
        start = self.next().start
        node = self.class_("abstract_class_declaration")
        node.start = start
        return node

    def class_(self, type_: str) -> Node:
        node = Node(type_, self.tok.start)
        self.need("class")
        if self.tok.kind == "name" and not self.is_("extends", "implements"):
            node.add("name", self.name("type_identifier" if self.typed else "identifier"))
        if self.is_("<"):
            node.add("type_parameters", self.type_parameters())
        heritage = Node("class_heritage", self.tok.start)
        while self.is_("extends", "implements"):
            kind = self.tok.text
            clause = Node(f"{kind}_clause", self.next().start)
            while True:
                if kind == "extends":
                    clause.add("value", self.postfix(self.primary(), calls=True, types=False))
                    if self.is_("<") and self.typed:
                        clause.add("type_arguments", self.type_arguments())
                else:
                    clause.add("", self.type_())
                if not self.eat(","):
                    break
            if self.typed:
                heritage.add("", self.done(clause))
            else:
                for k in clause.kids:
                    heritage.add("", k)
        if heritage.kids:
            node.add("heritage", self.done(heritage))
        node.add("body", self.class_body())
        return self.done(node)

    def class_body(self) -> Node:
        body = Node("class_body", self.tok.start)
        self.need("{")
        while not self.is_("}"):
            if self.tok.kind == "end":
                raise Unparsable("class body")
            if not self.eat(";"):
                at = self.tok.start
                member = self.attempt(self.member)
                if member is None:
                    self.errors += 1
                    member = Node("ERROR", at)
                    self.next()
                    self.done(member)
                body.add("", member)
        self.need("}")
        return self.done(body)

    def member(self) -> Node:
        start, decorators = self.tok.start, self.decorators()
        if self.is_("static") and self.peek().text == "{":
            self.next()
            node = Node("class_static_block", start)
            node.add("body", self.block())
            return self.done(node)
        flags, head = set(), self.tok.start
        while self.tok.text in MODIFIERS | {"get", "set"} and self.tok.kind == "name":
            p = self.peek()
            if p.text in ("(", "=", ";", "?", "!", ":", "<", "}", ",") and p.kind == "punct" or (p.newline and p.kind != "name" and p.text not in ("[", "*")):
                break
            flags.add(self.next().text)
        self.eat("*")
        if self.is_("[") and self.typed and (index := self.attempt(self.index_signature)):
            return index
        key = self.property_name()
        self.eat("?")
        self.eat("!")
        if self.is_("(", "<"):
            node = Node("method_definition", head)
            node.add("name", key)
            self.signature(node)
            if self.is_("{"):
                node.add("body", self.block())
            else:
                node.type = "abstract_method_signature" if "abstract" in flags else "method_signature"
                self.eat(";") or self.eat(",")
        else:
            node = Node("public_field_definition" if self.typed else "field_definition", head)
            node.add("name" if self.typed else "property", key)
            if self.is_(":"):
                node.add("type", self.annotation())
            if self.eat("="):
                node.add("value", self.assignment())
            self.end_statement()
        for d in reversed(decorators):
            d.parent, d.field = node, "decorator"
            node.kids.insert(0, d)
        return self.done(node)

    def property_name(self) -> Node:
        t = self.tok
        if t.kind == "name":
            return self.leaf("private_property_identifier" if t.text.startswith("#") else "property_identifier")
        if t.kind in ("string", "number"):
            return self.leaf(t.kind)
        node = Node("computed_property_name", t.start)
        self.need("[")
        node.add("", self.assignment())
        self.need("]")
        return self.done(node)

    def s_interface(self) -> Node | None:
        p = self.peek()
        if not self.typed or p.kind != "name" or p.newline:
            return None
        node = Node("interface_declaration", self.next().start)
        node.add("name", self.name("type_identifier"))
        if self.is_("<"):
            node.add("type_parameters", self.type_parameters())
        if self.is_("extends"):
            clause = Node("extends_type_clause", self.next().start)
            while True:
                clause.add("type", self.type_())
                if not self.eat(","):
                    break
            node.add("heritage", self.done(clause))
        body = self.object_type()
        body.type = "interface_body"
        node.add("body", body)
        return self.done(node)

    def s_type(self) -> Node | None:
        p = self.peek()
        if not self.typed or p.kind != "name" or p.newline:
            return None
        node = Node("type_alias_declaration", self.next().start)
        node.add("name", self.name("type_identifier"))
        if self.is_("<"):
            node.add("type_parameters", self.type_parameters())
        self.need("=")
        node.add("value", self.type_())
        self.end_statement()
        return self.done(node)

    def s_enum(self) -> Node | None:
        p = self.peek()
        if not self.typed or p.kind != "name":
            return None
        node = Node("enum_declaration", self.next().start)
        node.add("name", self.name())
        body = Node("enum_body", self.tok.start)
        self.need("{")
        while not self.is_("}"):
            at, key = self.tok.start, self.property_name()
            if self.eat("="):
                whole = Node("enum_assignment", at)
                whole.add("name", key)
                whole.add("value", self.assignment())
                key = self.done(whole)
            body.add("", key)
            if not self.eat(","):
                break
        self.need("}")
        node.add("body", self.done(body))
        return self.done(node)

    def s_namespace(self) -> Node | None:
        p = self.peek()
        if not self.typed or p.kind not in ("name", "string") or p.newline:
            return None
        t = self.next()
        node = Node("internal_module" if t.text == "namespace" else "module", t.start)
        if self.tok.kind == "string":
            node.add("name", self.leaf("string"))
        else:
            name = self.name()
            while self.eat("."):
                whole = Node("nested_identifier", name.start)
                whole.add("object", name)
                whole.add("property", self.name("property_identifier"))
                name = self.done(whole)
            node.add("name", name)
        if self.is_("{"):
            node.add("body", self.block())
        else:
            self.end_statement()
        return self.done(node)

    s_module = s_namespace

    def s_global(self) -> Node | None:
        if not self.typed or self.peek().text != "{":
            return None
        node = Node("module", self.tok.start)
        node.add("name", self.name())
        node.add("body", self.block())
        return self.done(node)

    def s_declare(self) -> Node | None:
        p = self.peek()
        if not self.typed or p.kind != "name" or p.newline:
            return None
        node = Node("ambient_declaration", self.next().start)
        node.add("", self.statement())
        return self.done(node)

    # ---- modules

    def s_import(self) -> Node | None:
        p = self.peek()
        if p.text in ("(", "."):
            return None
        node = Node("import_statement", self.next().start)
        if self.tok.kind == "string":
            node.add("source", self.leaf("string"))
            return self.module_end(node)
        if self.is_("type", "typeof") and (self.peek().text in ("{", "*") or self.peek().kind == "name" and self.peek().text != "from"):
            self.next()
        clause = Node("import_clause", self.tok.start)
        if self.tok.kind == "name":
            clause.add("", self.name())
            if self.eat("="):  # import x = require("y")
                node.add("", self.done(clause))
                value = self.expressions()
                node.add("value", value)
                return self.module_end(node)
            self.eat(",")
        if self.eat("*"):
            space = Node("namespace_import", self.last_end - 1)
            self.need("as")
            space.add("", self.name())
            clause.add("", self.done(space))
        elif self.is_("{"):
            clause.add("", self.specifiers("named_imports", "import_specifier"))
        node.add("", self.done(clause))
        self.need("from")
        node.add("source", self.string())
        return self.module_end(node)

    def string(self) -> Node:
        if self.tok.kind != "string":
            raise Unparsable("string")
        return self.leaf("string")

    def module_end(self, node: Node) -> Node:
        if self.is_("with", "assert") and self.peek().text == "{":
            self.next()
            node.add("", self.primary())
        self.end_statement()
        return self.done(node)

    def specifiers(self, type_: str, each: str) -> Node:
        node = Node(type_, self.tok.start)
        self.need("{")
        while not self.is_("}"):
            one = Node(each, self.tok.start)
            if self.is_("type") and (self.peek().kind in ("name", "string")) and (self.peek().text != "as" or self.lexer.at(self.peek().end, self.peek()).text not in (",", "}")):
                self.next()
            one.add("name", self.leaf("string") if self.tok.kind == "string" else self.name())
            if self.eat("as"):
                one.add("alias", self.leaf("string") if self.tok.kind == "string" else self.name())
            node.add("", self.done(one))
            if not self.eat(","):
                break
        self.need("}")
        return self.done(node)

    def s_export(self) -> Node | None:
        node = Node("export_statement", self.next().start)
        if self.eat("default"):
            if self.is_("function", "class", "abstract", "interface") or (self.is_("async") and self.peek().text == "function"):
                node.add("declaration", self.default_declaration())
            else:
                node.add("value", self.assignment())
                self.end_statement()
            return self.done(node)
        if self.is_("type") and self.peek().text in ("{", "*"):
            self.next()
        if self.eat("*"):
            if self.eat("as"):
                space = Node("namespace_export", self.last_end)
                space.add("", self.leaf("string") if self.tok.kind == "string" else self.name())
                node.add("", self.done(space))
            self.need("from")
            node.add("source", self.string())
            return self.module_end(node)
        if self.is_("{"):
            node.add("", self.specifiers("export_clause", "export_specifier"))
            if self.eat("from"):
                node.add("source", self.string())
            return self.module_end(node)
        if self.eat("="):
            node.add("value", self.expressions())
            self.end_statement()
            return self.done(node)
        if self.is_("as"):  # export as namespace X
            self.next(), self.need("namespace")
            node.add("", self.name())
            self.end_statement()
            return self.done(node)
        if self.eat("import"):
            node.add("", self.name())
            self.need("=")
            node.add("value", self.expressions())
            self.end_statement()
            return self.done(node)
        node.add("declaration", self.statement())
        return self.done(node)

    def default_declaration(self) -> Node:
        if self.is_("class"):
            return self.class_("class_declaration")
        if self.is_("abstract"):
            return self.s_abstract()
        if self.is_("interface"):
            return self.s_interface()
        return self.function(True)

    # ---- control flow

    def condition(self) -> Node:
        node = Node("parenthesized_expression", self.tok.start)
        self.need("(")
        node.add("", self.expressions())
        self.need(")")
        return self.done(node)

    def s_if(self) -> Node | None:
        node = Node("if_statement", self.next().start)
        node.add("condition", self.condition())
        node.add("consequence", self.statement())
        if self.is_("else"):
            clause = Node("else_clause", self.next().start)
            clause.add("", self.statement())
            node.add("alternative", self.done(clause))
        return self.done(node)

    def s_while(self) -> Node | None:
        node = Node("while_statement", self.next().start)
        node.add("condition", self.condition())
        node.add("body", self.statement())
        return self.done(node)

    def s_do(self) -> Node | None:
        node = Node("do_statement", self.next().start)
        node.add("body", self.statement())
        self.need("while")
        node.add("condition", self.condition())
        self.eat(";")
        return self.done(node)

    def s_for(self) -> Node | None:
        node = Node("for_statement", self.next().start)
        self.eat("await")
        self.need("(")
        if self.is_("var", "let", "const"):
            node.add("initializer", self.declaration("lexical_declaration", in_for=True))
        elif not self.is_(";"):
            node.add("initializer", self.expressions(no_in=True))
        if self.is_("of", "in"):
            node.type = "for_in_statement"
            self.next()
            node.add("right", self.expressions())
        else:
            self.need(";")
            if not self.is_(";"):
                node.add("condition", self.expressions())
            self.need(";")
            if not self.is_(")"):
                node.add("increment", self.expressions())
        self.need(")")
        node.add("body", self.statement())
        return self.done(node)

    def s_switch(self) -> Node | None:
        node = Node("switch_statement", self.next().start)
        node.add("value", self.condition())
        body = Node("switch_body", self.tok.start)
        self.need("{")
        while not self.is_("}"):
            case = Node("switch_case" if self.is_("case") else "switch_default", self.tok.start)
            if self.eat("case"):
                case.add("value", self.expressions())
            else:
                self.need("default")
            self.need(":")
            while not self.is_("case", "default", "}") and self.tok.kind != "end":
                case.add("body", self.statement())
            body.add("", self.done(case))
        self.need("}")
        node.add("body", self.done(body))
        return self.done(node)

    def s_try(self) -> Node | None:
        if self.peek().text != "{":
            return None
        node = Node("try_statement", self.next().start)
        node.add("body", self.block())
        if self.is_("catch"):
            clause = Node("catch_clause", self.next().start)
            if self.eat("("):
                clause.add("parameter", self.pattern())
                if self.is_(":"):
                    clause.add("type", self.annotation())
                self.need(")")
            clause.add("body", self.block())
            node.add("handler", self.done(clause))
        if self.is_("finally"):
            clause = Node("finally_clause", self.next().start)
            clause.add("body", self.block())
            node.add("finalizer", self.done(clause))
        return self.done(node)

    def _simple(self, type_: str) -> Node:
        node = Node(type_, self.next().start)
        if not (self.is_(";", "}") or self.tok.newline or self.tok.kind == "end"):
            node.add("", self.expressions())
        self.end_statement()
        return self.done(node)

    def s_return(self) -> Node | None:
        return self._simple("return_statement")

    def s_throw(self) -> Node | None:
        return self._simple("throw_statement")

    def s_break(self) -> Node | None:
        return self._simple("break_statement")

    def s_continue(self) -> Node | None:
        return self._simple("continue_statement")

    def s_debugger(self) -> Node | None:
        return self._simple("debugger_statement")

    # ---- expressions

    def expressions(self, no_in: bool = False) -> Node:
        first = self.assignment(no_in)
        while self.is_(","):
            self.next()
            node = Node("sequence_expression", first.start)
            node.add("left", first)
            node.add("right", self.assignment(no_in))
            first = self.done(node)
        return first

    def assignment(self, no_in: bool = False) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            raise Unparsable("too deep")
        try:
            return self._assignment(no_in)
        finally:
            self.depth -= 1

    def _assignment(self, no_in: bool) -> Node:
        t, start = self.tok, self.tok.start
        arrow = self.arrow()
        if arrow is not None:
            return arrow
        if t.kind == "name" and t.text == "yield":
            node = Node("yield_expression", self.next().start)
            self.eat("*")
            if not (self.tok.newline or self.is_(")", "]", "}", ",", ";") or self.tok.kind == "end"):
                node.add("", self.assignment(no_in))
            return self.done(node)
        left = self.ternary(no_in)
        if self.tok.kind == "punct" and self.tok.text in ASSIGN:
            plain = self.next().text == "="
            node = Node("assignment_expression" if plain else "augmented_assignment_expression", start)
            node.add("left", left)
            node.add("right", self.assignment(no_in))
            return self.done(node)
        return left

    def arrow(self) -> Node | None:
        t = self.tok
        if t.kind == "name":
            p = self.peek()
            if p.text == "=>" and p.kind == "punct":
                node = Node("arrow_function", t.start)
                node.add("parameter", self.name())
                return self.arrow_body(node)
            if t.text != "async" or p.newline or not (p.kind == "name" and p.text != "function" or p.text in ("(", "<")):
                return None
        elif t.text not in ("(", "<") or t.kind != "punct":
            return None
        if t.start in self.not_arrow:
            return None
        node = self.attempt(self._arrow)
        if node is None:
            self.not_arrow.add(t.start)
        return node

    def _arrow(self) -> Node:
        node = Node("arrow_function", self.tok.start)
        if self.is_("async"):
            self.next()
            if self.tok.kind == "name":
                node.add("parameter", self.name())
                return self.arrow_body(node)
        if self.is_("<"):
            node.add("type_parameters", self.type_parameters())
        self.quick_reject()
        node.add("parameters", self.parameters())
        if self.is_(":") and self.typed:
            node.add("return_type", self.annotation())
        return self.arrow_body(node)

    def quick_reject(self) -> None:
        """Parentheses not followed by an arrow or a return type hold no parameters."""
        depth, pos, before = 0, self.tok.start, None
        while True:
            token = self.lexer.at(pos, before)
            if token.kind == "end":
                raise Unparsable("parentheses")
            if token.kind == "punct":
                depth += (token.text in "([{") - (token.text in ")]}")
                if not depth:
                    after = self.lexer.at(token.end, token)
                    if after.text not in ("=>", ":"):
                        raise Unparsable("no arrow")
                    return
            pos, before = token.end, token

    def arrow_body(self, node: Node) -> Node:
        if not self.is_("=>") or self.tok.newline:
            raise Unparsable("arrow")
        self.next()
        node.add("body", self.block() if self.is_("{") else self.assignment())
        return self.done(node)

    def ternary(self, no_in: bool) -> Node:
        start = self.tok.start
        test = self.binary(0, no_in)
        if not self.is_("?"):
            return test
        self.next()
        node = Node("ternary_expression", start)
        node.add("condition", test)
        node.add("consequence", self.assignment())
        self.need(":")
        node.add("alternative", self.assignment(no_in))
        return self.done(node)

    def binary(self, least: int, no_in: bool) -> Node:
        start = self.tok.start
        left = self.unary()
        while True:
            op = self.tok.text
            if self.typed and self.tok.kind == "name" and op in ("as", "satisfies") and not self.tok.newline:
                self.next()
                node = Node(f"{op}_expression", start)
                node.add("", left)
                if self.is_("const"):
                    self.next()
                else:
                    node.add("", self.type_())
                left = self.done(node)
                continue
            strength = BINARY.get(op, 0) if self.tok.kind in ("punct", "name") else 0
            if not strength or strength <= least or (op == "in" and no_in):
                return left
            self.next()
            node = Node("binary_expression", start)
            node.add("left", left)
            node.add("right", self.binary(strength - (op == "**"), no_in))
            left = self.done(node)

    def unary(self) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "punct" and t.text in ("!", "~", "+", "-", "++", "--"):
            self.next()
            node = Node("update_expression" if len(t.text) == 2 else "unary_expression", start)
            node.add("argument", self.unary())
            return self.done(node)
        if t.kind == "name" and t.text in ("typeof", "void", "delete", "await"):
            p = self.peek()
            if t.text != "await" or p.kind != "punct" or p.text in ("(", "[", "{", "+", "-", "!", "~", "<", "`"):
                self.next()
                node = Node("await_expression" if t.text == "await" else "unary_expression", start)
                node.add("" if t.text == "await" else "argument", self.unary())
                return self.done(node)
        if t.text == "<" and t.kind == "punct" and self.typed and not self.jsx:
            node = Node("type_assertion", start)
            node.add("", self.type_arguments())
            node.add("", self.unary())
            return self.done(node)
        left = self.postfix(self.primary(), calls=True)
        if self.is_("++", "--") and not self.tok.newline:
            self.next()
            node = Node("update_expression", start)
            node.add("argument", left)
            return self.done(node)
        return left

    def postfix(self, left: Node, calls: bool, types: bool = True) -> Node:
        while True:
            t = self.tok
            if t.kind == "template":
                node = Node("call_expression", left.start)
                node.add("function", left)
                node.add("arguments", self.template())
                left = self.done(node)
                continue
            if t.kind != "punct":
                return left
            if t.text in (".", "?."):
                self.next()
                if t.text == "?." and self.is_("("):
                    left = self.call(left)
                    continue
                if t.text == "?." and self.is_("["):
                    left = self.subscript(left)
                    continue
                node = Node("member_expression", left.start)
                node.add("object", left)
                if self.tok.kind != "name":
                    raise Unparsable("member name")
                node.add("property", self.leaf("private_property_identifier" if self.tok.text[0] == "#" else "property_identifier"))
                left = self.done(node)
            elif t.text == "[":
                left = self.subscript(left)
            elif t.text == "(" and calls:
                left = self.call(left)
            elif t.text == "!" and self.typed and not t.newline and self.peek().text != "=":
                self.next()
                node = Node("non_null_expression", left.start)
                node.add("", left)
                left = self.done(node)
            elif t.text in ("<", "<<") and self.typed and types and t.text == "<":
                generic = self.attempt(lambda left=left: self.generic_call(left, calls))
                if generic is None:
                    return left
                left = generic
            else:
                return left

    def generic_call(self, left: Node, calls: bool) -> Node | None:
        arguments = self.type_arguments()
        if self.tok.kind == "template":
            node = Node("call_expression", left.start)
            node.add("function", left)
            node.add("type_arguments", arguments)
            node.add("arguments", self.template())
            return self.done(node)
        if self.is_("(") and calls:
            node = self.call(left)
            arguments.parent, arguments.field = node, "type_arguments"
            node.kids.insert(1, arguments)
            return node
        if not calls and self.is_("("):
            left.add("type_arguments", arguments)
            return self.done(left)
        return None

    def call(self, left: Node) -> Node:
        node = Node("call_expression", left.start)
        node.add("function", left)
        node.add("arguments", self.arguments())
        return self.done(node)

    def arguments(self) -> Node:
        node = Node("arguments", self.tok.start)
        self.need("(")
        self.items(node, ")")
        return self.done(node)

    def items(self, node: Node, close: str) -> None:
        while not self.is_(close):
            if self.eat(","):
                continue
            if self.is_("..."):
                spread = Node("spread_element", self.next().start)
                spread.add("", self.assignment())
                node.add("", self.done(spread))
            else:
                node.add("", self.assignment())
            if not self.is_(close):
                self.need(",")
        self.need(close)

    def subscript(self, left: Node) -> Node:
        node = Node("subscript_expression", left.start)
        node.add("object", left)
        self.need("[")
        node.add("index", self.expressions())
        self.need("]")
        return self.done(node)

    def template(self) -> Node:
        t = self.tok
        node = Node("template_string", t.start)
        pos = t.start + 1
        while pos < t.end - 1:
            if self.source[pos] == "\\":
                pos += 2
            elif self.source.startswith("${", pos):
                part = Node("template_substitution", pos)
                self.jump(pos + 2)
                if not self.is_("}"):
                    part.add("", self.expressions())
                part.end = self.tok.end
                if not self.is_("}"):
                    raise Unparsable("substitution")
                node.add("", part)
                pos = self.tok.end
            else:
                pos += 1
        self.jump(t.end, t)
        node.end = t.end
        return node

    def primary(self) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind == "name":
            if t.text == "function" or (t.text == "async" and self.peek().text == "function" and not self.peek().newline):
                return self.function(False)
            if t.text == "class":
                return self.class_("class")
            if t.text == "new":
                return self.new()
            if t.text in ("this", "super", "true", "false", "null", "undefined"):
                return self.leaf(t.text)
            if t.text == "import":
                node = self.leaf("import")
                return node
            if t.text in BEFORE_EXPRESSION:
                raise Unparsable(f"{t.text} at {start}")
            return self.leaf("private_property_identifier" if t.text.startswith("#") else "identifier")
        if t.kind in ("number", "string", "regex"):
            return self.leaf(t.kind)
        if t.kind == "template":
            return self.template()
        if t.text == "(":
            node = Node("parenthesized_expression", start)
            self.next()
            node.add("", self.expressions())
            self.need(")")
            return self.done(node)
        if t.text == "[":
            node = Node("array", start)
            self.next()
            self.items(node, "]")
            return self.done(node)
        if t.text == "{":
            return self.object_()
        if t.text == "<" and (self.jsx or not self.typed):
            return self.jsx_element()
        if t.text == "@":
            self.decorators()
            return self.primary()
        raise Unparsable(f"{t.text!r} at {start}")

    def new(self) -> Node:
        start = self.next().start
        if self.is_("."):
            self.next()
            node = Node("meta_property", start)
            self.next()
            return self.done(node)
        node = Node("new_expression", start)
        node.add("constructor", self.postfix(self.new() if self.is_("new") else self.primary(), calls=False))
        if self.is_("("):
            node.add("arguments", self.arguments())
        return self.done(node)

    def object_(self) -> Node:
        node = Node("object", self.tok.start)
        self.need("{")
        while not self.is_("}"):
            if self.is_("..."):
                spread = Node("spread_element", self.next().start)
                spread.add("", self.assignment())
                node.add("", self.done(spread))
            else:
                node.add("", self.property())
            if not self.eat(","):
                break
        self.need("}")
        return self.done(node)

    def property(self) -> Node:
        start = self.tok.start
        while self.is_("async", "get", "set") and self.peek().text not in (",", ":", "(", "}", "=", "<"):
            self.next()
        self.eat("*")
        key = self.property_name()
        if self.is_("(", "<"):
            node = Node("method_definition", start)
            node.add("name", key)
            self.signature(node)
            node.add("body", self.block())
            return self.done(node)
        if self.eat(":"):
            node = Node("pair", start)
            node.add("key", key)
            node.add("value", self.assignment())
            return self.done(node)
        key.type = "shorthand_property_identifier"
        if self.eat("="):
            node = Node("object_assignment_pattern", start)
            node.add("left", key)
            node.add("right", self.assignment())
            return self.done(node)
        return key

    # ---- JSX, read by characters between its braces

    def jsx_element(self) -> Node:
        start = self.tok.start
        node = Node("jsx_element", start)
        self.need("<")
        if self.eat(">"):
            return self.jsx_children(node)
        opening = Node("jsx_opening_element", start)
        opening.add("name", self.jsx_name())
        if self.is_("<") and self.typed:
            opening.add("type_arguments", self.type_arguments())
        while not self.is_(">", "/") and self.tok.kind != "end":
            if self.is_("{"):
                opening.add("attribute", self.jsx_braces())
                continue
            attribute = Node("jsx_attribute", self.tok.start)
            attribute.add("", self.jsx_name("property_identifier"))
            if self.eat("="):
                if self.is_("{"):
                    attribute.add("", self.jsx_braces())
                elif self.is_("<"):
                    attribute.add("", self.jsx_element())
                else:
                    attribute.add("", self.jsx_string())
            opening.add("attribute", self.done(attribute))
        if self.eat("/"):
            self.need(">")
            opening.type = "jsx_self_closing_element"
            return self.done(opening)
        if not self.is_(">"):
            raise Unparsable("tag")
        self.last_end = self.tok.end
        node.add("open_tag", self.done(opening))
        end = self.tok.end
        self.tok = Token("punct", ">", end - 1, end, False)
        return self.jsx_children(node, True)

    def jsx_string(self) -> Node:
        quote = self.source[self.tok.start]
        if quote not in "\"'":
            raise Unparsable("attribute")
        node = Node("string", self.tok.start, self.source.find(quote, self.tok.start + 1) + 1)
        if not node.end:
            raise Unparsable("attribute")
        self.jump(node.end)
        return node

    def jsx_name(self, type_: str = "identifier") -> Node:
        node = self.name(type_)
        while self.is_("-", ":", ".") and not self.tok.newline:
            dotted = self.is_(".")
            self.next()
            rest = self.name("property_identifier")
            if dotted:
                whole = Node("member_expression", node.start)
                whole.add("object", node)
                whole.add("property", rest)
                node = whole
            node.end = rest.end
        return node

    def jsx_braces(self) -> Node:
        node = Node("jsx_expression", self.tok.start)
        self.need("{")
        if self.is_("..."):
            self.next()
        if not self.is_("}"):
            node.add("", self.expressions())
        node.end = self.tok.end
        self.need("}")
        return node

    def jsx_children(self, node: Node, opened: bool = False) -> Node:
        pos = self.tok.end if opened else self.last_end
        s = self.source
        while True:
            at = pos
            while pos < len(s) and s[pos] not in "<{":
                pos += 1
            if s[at:pos].strip():
                node.add("", Node("jsx_text", at, pos))
            if pos >= len(s):
                raise Unparsable("element not closed")
            self.jump(pos)
            if s[pos] == "{":
                part = Node("jsx_expression", pos)
                self.next()
                if self.is_("..."):
                    self.next()
                if not self.is_("}"):
                    part.add("", self.expressions())
                if not self.is_("}"):
                    raise Unparsable("braces")
                pos = part.end = self.tok.end
                node.add("", part)
            elif self.peek().text == "/" or s.startswith("</", pos):
                close = s.find(">", pos)
                if close < 0:
                    raise Unparsable("closing tag")
                node.add("close_tag", Node("jsx_closing_element", pos, close + 1))
                self.jump(close + 1, Token("punct", ")", close, close + 1, False))
                return self.done(node)
            else:
                child = self.jsx_element()
                node.add("", child)
                pos = child.end

    # ---- types

    def annotation(self) -> Node:
        node = Node("type_annotation", self.tok.start)
        self.need(":")
        if not self.typed:
            raise Unparsable("type in JavaScript")
        if self.is_("asserts") and self.peek().kind == "name" and not self.peek().newline:
            self.next()
        node.add("", self.type_())
        return self.done(node)

    def type_parameters(self) -> Node:
        node = Node("type_parameters", self.tok.start)
        self.need("<")
        while not self.is_(">"):
            one = Node("type_parameter", self.tok.start)
            while self.is_("const", "in", "out") and self.peek().kind == "name":
                self.next()
            one.add("name", self.name("type_identifier"))
            if self.eat("extends"):
                one.add("constraint", self.type_())
            if self.eat("="):
                one.add("value", self.type_())
            node.add("", self.done(one))
            if not self.eat(","):
                break
        self.need(">")
        return self.done(node)

    def type_arguments(self) -> Node:
        node = Node("type_arguments", self.tok.start)
        self.need("<")
        while True:
            node.add("", self.type_())
            if not self.eat(","):
                break
        self.need(">")
        return self.done(node)

    def type_(self) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            raise Unparsable("too deep")
        try:
            start = self.tok.start
            if self.is_("(", "<", "new", "abstract") and (function := self.attempt(self.function_type)):
                return function
            left = self.union()
            if self.is_("extends") and not self.tok.newline:
                self.next()
                node = Node("conditional_type", start)
                node.add("left", left)
                node.add("right", self.union())
                self.need("?")
                node.add("consequence", self.type_())
                self.need(":")
                node.add("alternative", self.type_())
                return self.done(node)
            if self.is_("is") and not self.tok.newline:
                self.next()
                node = Node("type_predicate", start)
                left.type = "identifier"
                node.add("name", left)
                node.add("type", self.type_())
                return self.done(node)
            return left
        finally:
            self.depth -= 1

    def function_type(self) -> Node:
        node = Node("function_type", self.tok.start)
        self.eat("abstract")
        if self.eat("new"):
            node.type = "constructor_type"
        if self.is_("<"):
            node.add("type_parameters", self.type_parameters())
        node.add("parameters", self.parameters())
        self.need("=>")
        self.eat("asserts") if self.peek().kind == "name" else None
        node.add("return_type", self.type_())
        return self.done(node)

    def union(self) -> Node:
        start = self.tok.start
        self.eat("|") or self.eat("&")
        left = self.array_type()
        while self.is_("|", "&"):
            op = self.next().text
            node = Node("union_type" if op == "|" else "intersection_type", start)
            node.add("", left)
            node.add("", self.function_type() if self.is_("(") and self._arrow_ahead() else self.array_type())
            left = self.done(node)
        return left

    def _arrow_ahead(self) -> bool:
        saved = self.tok, self.last_end
        try:
            self.parameters()
            return self.is_("=>")
        except Unparsable:
            return False
        finally:
            self.tok, self.last_end = saved

    def array_type(self) -> Node:
        start = self.tok.start
        if self.is_("keyof", "unique", "readonly", "infer", "typeof") and self.peek().text not in (",", ">", ")", ";", "|", "="):
            word = self.next().text
            node = Node({"infer": "infer_type", "typeof": "type_query"}.get(word, "index_type_query"), start)
            if word == "typeof":
                name = self.leaf("import") if self.is_("import") else self.name()
                if name.type == "import":
                    self.arguments()
                while self.eat("."):
                    whole = Node("member_expression", name.start)
                    whole.add("object", name)
                    whole.add("property", self.name("property_identifier"))
                    name = self.done(whole)
                node.add("", name)
                if self.is_("<") and not self.tok.newline:
                    node.add("", self.type_arguments())
            else:
                node.add("", self.array_type())
                if word == "infer" and self.is_("extends"):
                    found = self.attempt(self._infer_bound)
                    node.add("", found)
            left = self.done(node)
        else:
            left = self.primary_type()
        while self.is_("[") and not self.tok.newline:
            self.next()
            node = Node("array_type" if self.is_("]") else "lookup_type", start)
            node.add("", left)
            if not self.is_("]"):
                node.add("", self.type_())
            self.need("]")
            left = self.done(node)
        return left

    def _infer_bound(self) -> Node | None:
        self.need("extends")
        bound = self.union()
        return None if self.is_("?") else bound

    def primary_type(self) -> Node:
        t, start = self.tok, self.tok.start
        if t.kind in ("string", "number"):
            return self._literal(start)
        if t.kind == "template":
            return self.template()
        if t.text == "-" and t.kind == "punct":
            self.next()
            return self._literal(start)
        if t.text == "(":
            node = Node("parenthesized_type", start)
            self.next()
            node.add("", self.type_())
            self.need(")")
            return self.done(node)
        if t.text == "{":
            return self.object_type()
        if t.text == "[":
            node = Node("tuple_type", start)
            self.next()
            while not self.is_("]"):
                self.eat("...")
                if self.tok.kind == "name" and (self.peek().text == ":" or self.peek().text == "?" and self.lexer.at(self.peek().end, None).text == ":"):
                    self.next()
                    self.eat("?")
                    self.need(":")
                node.add("", self.type_())
                self.eat("?")
                if not self.eat(","):
                    break
            self.need("]")
            return self.done(node)
        if t.kind != "name":
            raise Unparsable(f"type at {start}")
        if t.text == "import":
            node = Node("generic_type", start)
            self.next()
            node.add("", self.arguments())
            name: Node = self.done(node)
        elif t.text in PREDEFINED:
            return self.leaf("predefined_type")
        elif t.text in ("this", "true", "false"):
            return self.leaf("this_type" if t.text == "this" else "literal_type")
        elif t.text == "asserts" and self.peek().kind == "name":
            self.next()
            return self.type_()
        else:
            name = self.name("type_identifier")
        while self.is_(".") and not self.tok.newline:
            self.next()
            whole = Node("nested_type_identifier", name.start)
            if name.type == "type_identifier":
                name.type = "identifier"
            whole.add("module", name)
            whole.add("name", self.name("type_identifier"))
            name = self.done(whole)
        if self.is_("<") and not self.tok.newline:
            node = Node("generic_type", start)
            node.add("name", name)
            node.add("type_arguments", self.type_arguments())
            return self.done(node)
        return name

    def _literal(self, start: int) -> Node:
        node = Node("literal_type", start)
        node.add("", self.leaf(self.tok.kind))
        return self.done(node)

    def index_signature(self) -> Node:
        node = Node("index_signature", self.tok.start)
        self.need("[")
        node.add("name", self.name())
        if self.eat("in"):
            node.type = "mapped_type_clause"
            node.add("", self.type_())
            if self.eat("as"):
                node.add("", self.type_())
        else:
            node.add("", self.annotation())
        self.need("]")
        self.eat("-") or self.eat("+")
        self.eat("?")
        if self.is_(":"):
            node.add("type", self.annotation())
        self.eat(";") or self.eat(",")
        return self.done(node)

    def object_type(self) -> Node:
        node = Node("object_type", self.tok.start)
        self.need("{")
        while not self.is_("}"):
            if self.eat(";") or self.eat(","):
                continue
            if self.tok.kind == "end":
                raise Unparsable("object type")
            node.add("", self.signature_member())
        self.need("}")
        return self.done(node)

    def signature_member(self) -> Node:
        start = self.tok.start
        self.eat("+") or self.eat("-")
        while self.is_("readonly", "get", "set") and self.peek().text not in (":", "?", "(", "<", ";", ",", "}"):
            self.next()
        if self.is_("[") and (index := self.attempt(self.index_signature)):
            return index
        node = Node("property_signature", start)
        if self.is_("(", "<"):
            node.type = "call_signature"
            self.signature(node)
        elif self.is_("new") and self.peek().text in ("(", "<"):
            self.next()
            node.type = "construct_signature"
            self.signature(node)
        else:
            node.add("name", self.property_name())
            self.eat("?")
            if self.is_("(", "<"):
                node.type = "method_signature"
                self.signature(node)
            elif self.is_(":"):
                node.add("type", self.annotation())
        if not (self.eat(";") or self.eat(",") or self.is_("}") or self.tok.newline):
            raise Unparsable("member")
        return self.done(node)


# Words that begin no expression.
BEFORE_EXPRESSION = frozenset("if else for while do switch case default return throw try catch finally break continue var const export extends in instanceof debugger with".split())


def parse(source: str, grammar: str) -> tuple[Node, int]:
    """The tree of a file and the number of places that could not be parsed."""
    parser = Parser(source, grammar != "javascript", grammar in ("tsx", "javascript"))
    return parser.program(), parser.errors
