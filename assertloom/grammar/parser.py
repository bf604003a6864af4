"""Assertion text to a tree: operator precedence over tokens. Stricter than the regular expressions of functions.parse; errors raise."""

from __future__ import annotations

import re
from functools import lru_cache

from assertloom.grammar.nodes import Node, past, repeat, sig

_SKIP = r"(?:\s+|//[^\n]*|/\*.*?\*/)*+"
_TOKEN = re.compile(
    _SKIP + r"(?:(?P<delay>##\s*(?:\[\s*\d+\s*:\s*(?:\d+|\$)\s*\]|\d+))|(?P<rep>\[(?:\*|->|=)\s*(?:\d+\s*(?::\s*(?:\d+|\$))?)\s*\])"
    r"|(?P<num>\d*'[sS]?[bBhHdDoO][0-9a-fA-FxXzZ_]+|\d+)|(?P<name>\$?[a-zA-Z_]\w*)|(?P<op>\|->|\|=>|===|!==|==|!=|<=|>=|&&|\|\||\^~|~\^|[-+*/%&|^~!<>?:(),.]))",
    re.S,
)
_BLANK = re.compile(_SKIP, re.S)
#: How tightly the binary operators of the boolean layer bind, from the loosest.
_LEVELS = (("||",), ("&&",), ("|",), ("^", "^~", "~^"), ("&",), ("==", "!=", "===", "!=="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))
_BINDS = {op: n for n, ops in enumerate(_LEVELS, 1) for op in ops}
_SIGNS = frozenset("!~-+&|^")
#: Words between properties, and words between sequences, with how tightly they bind.
_UNITES, _MATCHES = {"or": 1, "and": 2}, {"intersect": 1, "within": 2}
#: Words that begin a property, and what may follow one.
_HEADS, _ENDS = frozenset(("disable", "if", "not", "first_match")), frozenset((")", "", "|->", "|=>", "until", "until_with"))
_ONE = Node("number", "1")
_COUNTED = re.compile(r"(\[(?:->|\*|=))(.*)\]")


class SyntaxProblem(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in _TOKEN.finditer(text):
        if m.start() != at:
            break
        at, kind = m.end(), m.lastgroup
        out.append((kind, re.sub(r"\s+", "", m[kind]) if kind in ("delay", "rep") else m[kind]))
    at = _BLANK.match(text, at).end()
    if at < len(text):
        raise SyntaxProblem(f"unexpected token {text[at:at + 10]!r}")
    return out


class _Parser:
    """Each token is looked at a few times, however many operators there are: how tightly an operator binds is looked up, not descended to."""

    def __init__(self, text: str):
        found = tokens(text)
        self.n, self.i = len(found), 0
        self.kinds, self.values = zip(*found, ("", ""))

    def take(self, *values: str) -> str:
        if self.i >= self.n:
            raise SyntaxProblem("unexpected end")
        value = self.values[self.i]
        if values and value not in values:
            raise SyntaxProblem(f"expected {' or '.join(values)}, found {value}")
        self.i += 1
        return value

    def property(self) -> Node:
        value = self.values[self.i]
        if self.kinds[self.i] == "name" and self.values[self.i + 1] in _ENDS and value not in _HEADS and value[0] != "$":  # a signal alone
            self.i += 1
            return self.extended(sig(value))
        if value == "disable":
            self.take()
            self.take("iff")
            self.take("(")
            reset = self.boolean()
            self.take(")")
            return Node("disable", "", (reset, self.property()))
        if value == "if":
            self.take()
            self.take("(")
            cond = self.boolean()
            self.take(")")
            then = self.property()
            if self.values[self.i] == "else":
                self.take()
                return Node("if_else", "", (cond, then, self.property()))
            return Node("if", "", (cond, then))
        return self.extended(self.chain(_UNITES, 1, self.negated))

    def extended(self, left: Node) -> Node:
        value = self.values[self.i]
        if value in ("|->", "|=>"):
            return Node("implies", self.take(), (left, self.property()))
        if value in ("until", "until_with"):
            return Node("until", self.take(), (left, self.property()))
        return left

    def chain(self, words: dict[str, int], least: int, below) -> Node:
        left = below()
        while (binds := words.get(self.values[self.i], 0)) >= least:
            word = self.take()
            right = self.chain(words, binds + 1, below)
            kind = "prop" if left.type == "PROPERTY" or right.type == "PROPERTY" else "seq"
            left = Node(kind, word, (left, right))
        return left

    def negated(self) -> Node:
        if self.values[self.i] == "not":
            self.take()
            return Node("not", "", (self.negated(),))
        return self.chain(_MATCHES, 1, self.thoroughly)

    def thoroughly(self) -> Node:
        left = _ONE if self.kinds[self.i] == "delay" else self.repeated()
        while self.kinds[self.i] == "delay":
            left = Node("delay", self.take(), (left, self.repeated()))
        if self.values[self.i] == "throughout":
            self.take()
            return Node("seq", "throughout", (left, self.thoroughly()))
        return left

    def repeated(self) -> Node:
        x = self.boolean()
        while self.kinds[self.i] == "rep":
            m = _COUNTED.match(self.take())
            x = repeat(x, m[1], m[2])
        return x

    def boolean(self) -> Node:
        x = self.binary(1)
        if self.values[self.i] == "?":
            self.take()
            then = self.boolean()
            self.take(":")
            return Node("ternary", "", (x, then, self.boolean()))
        return x

    def binary(self, least: int) -> Node:
        x = self.unary() if self.values[self.i] in _SIGNS else self.primary()
        while (binds := _BINDS.get(self.values[self.i], 0)) >= least:
            x = Node("binary", self.take(), (x, self.binary(binds + 1)))
        return x

    def unary(self) -> Node:
        if self.values[self.i] in _SIGNS:
            return Node("unary", self.take(), (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        kind, value = self.kinds[self.i], self.take()
        if kind == "name" and value[0] != "$" and value != "first_match":
            return sig(value)
        if value == "(":
            x = self.property()
            self.take(")")
            if self.values[self.i] == ".":
                self.take()
                self.take("ended")
                return Node("ended", "", (x,))
            return x
        if kind == "num":
            return Node("number", value)
        if kind != "name":
            raise SyntaxProblem(f"unexpected token {value!r}")
        self.take("(")
        x = self.property() if value == "first_match" else self.boolean()
        more = []
        while self.values[self.i] == ",":
            self.take()
            more.append(self.take())
        self.take(")")
        if value == "first_match":
            return Node("first_match", "", (x,))
        return past(x, int(more[0]) if more else None) if value == "$past" else Node("call", value, (x,))


@lru_cache(maxsize=10_000)
def parse(text: str) -> Node:
    """The tree of a bare property expression, without clock; raises SyntaxProblem. Texts met of late aren't parsed again."""
    p = _Parser(text)
    out = p.property()
    if p.i < p.n:
        raise SyntaxProblem(f"unexpected token {p.values[p.i]!r}")
    return out
