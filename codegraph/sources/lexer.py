"""Tokens of TypeScript and JavaScript, read on demand so that the parser can say where it stands."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

SPACE = re.compile(r"(?:[\s﻿]+|//[^\n  ]*|/\*(?:[^*]|\*(?!/))*\*/|<!--[^\n]*)+")
NAME = re.compile(r"[#@]?(?:[^\W\d]|\$|\\u\{?[0-9a-fA-F]+\}?)(?:\w|\$|‌|‍|\\u\{?[0-9a-fA-F]+\}?)*")
NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?")
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
# The languages' punctuators, longest first.
PUNCTUATORS = """>>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #""".split()
PUNCT = re.compile("|".join(map(re.escape, PUNCTUATORS)))
# What a token is that begins with a character which begins no other kind of token and no gap, and those that are whole tokens.
KIND = dict.fromkeys(string.ascii_letters + "_$", "name") | dict.fromkeys("{}()[];,>+-*%&|^!~?:=", "punct")
ALONE = frozenset("{}()[];,~:")
# Words after which a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof await yield extends".split())


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, template, regex, punct, end
    text: str
    start: int
    end: int
    newline: bool  # a line break stands before it


class Lexer:
    def __init__(self, source: str):
        self.source = source

    def at(self, pos: int, before: Token | None) -> Token:
        """The token at or after pos; `before` decides whether a slash divides."""
        s = self.source
        at = pos + 1 if s.startswith(" ", pos) else pos
        if pos and (kind := KIND.get(c := s[at : at + 1])):  # nothing but at most a blank stands before it
            text = c if c in ALONE else (NAME if kind == "name" else PUNCT).match(s, at)[0]
            return Token(kind, text, at, at + len(text), False)
        gap = SPACE.match(s, pos)
        start = gap.end() if gap else pos
        newline = pos == 0 or bool(gap and "\n" in gap[0])
        if pos == 0 and s.startswith("#!"):
            end = s.find("\n")
            return self.at(len(s) if end < 0 else end, None)
        if start >= len(s):
            return Token("end", "", len(s), len(s), True)
        c = s[start]
        if kind := KIND.get(c):
            text = c if c in ALONE else (NAME if kind == "name" else PUNCT).match(s, start)[0]
            return Token(kind, text, start, start + len(text), newline)
        if c == "`":
            return Token("template", s[start : (end := self.template_end(start))], start, end, newline)
        if c == "/" and self._regex_may_follow(before) and (m := REGEX.match(s, start)):
            return Token("regex", m[0], start, m.end(), newline)
        for kind, pattern in (("string", STRING), ("number", NUMBER), ("name", NAME)):
            if (kind != "number" or c.isdigit() or c == ".") and (m := pattern.match(s, start)):
                if kind == "name" and c == "@":
                    break
                return Token(kind, m[0], start, m.end(), newline)
        m = PUNCT.match(s, start)
        text = m[0] if m else c
        return Token("punct", text, start, start + len(text), newline)

    @staticmethod
    def _regex_may_follow(before: Token | None) -> bool:
        if before is None:
            return True
        if before.kind == "name":
            return before.text in BEFORE_REGEX
        return before.kind == "punct" and before.text not in (")", "]", "}")

    def template_end(self, start: int) -> int:
        """The end of the template literal that begins at start."""
        s, pos = self.source, start + 1
        while pos < len(s):
            if s[pos] == "\\":
                pos += 2
            elif s[pos] == "`":
                return pos + 1
            elif s.startswith("${", pos):
                pos = self.braces_end(pos + 2)
            else:
                pos += 1
        return len(s)

    def braces_end(self, pos: int) -> int:
        """Just after the brace that closes the one before pos."""
        depth, before = 1, None
        while True:
            token = self.at(pos, before)
            if token.kind == "end":
                return token.end
            if token.kind == "punct":
                depth += (token.text == "{") - (token.text == "}")
                if not depth:
                    return token.end
            pos, before = token.end, token
