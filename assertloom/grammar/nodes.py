"""Assertions as trees. One node type; a table says how each kind is written and what it denotes."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

EXPR, BOOL, SEQUENCE, PROPERTY = "EXPR", "BOOL", "SEQUENCE", "PROPERTY"
UNARY = ("!", "~", "-", "+")
ARITHMETIC, BITWISE = ("+", "-", "*", "/", "%"), ("&", "|", "^", "^~", "~^")
RELATIONAL, EQUALITY, LOGICAL = ("<", "<=", ">", ">="), ("==", "!=", "===", "!=="), ("&&", "||")
FUNCTIONS = ("$rose", "$fell", "$stable", "$changed", "$onehot", "$onehot0", "$isunknown", "$countones")

#: How a kind is written: {0} {1} {2} are its parts and {op} its operator.
_FORMS = {
    "signal": "{op}",
    "number": "{op}",
    "unary": "({op}{0})",
    "binary": "({0} {op} {1})",
    "ternary": "({0} ? {1} : {2})",
    "call": "{op}({0})",
    "past": "$past({0}{op})",
    "delay": "({0} {op} {1})",
    "repeat": "({0}{op})",
    "seq": "({0} {op} {1})",
    "first_match": "first_match({0})",
    "ended": "({0}).ended",
    "implies": "{0} {op} {1}",
    "disable": "disable iff ({0}) ({1})",
    "not": "not ({0})",
    "if": "if ({0}) {1}",
    "if_else": "if ({0}) {1} else {2}",
    "until": "({0} {op} {1})",
    "prop": "({0} {op} {1})",
}
_TYPES = {"signal": EXPR, "number": EXPR, "ternary": EXPR, "past": EXPR, "call": BOOL, "ended": BOOL} | dict.fromkeys(("delay", "repeat", "seq", "first_match"), SEQUENCE)


class Node(NamedTuple):
    kind: str
    op: str = ""
    parts: tuple[Node, ...] = ()

    def __str__(self) -> str:
        return _FORMS[self.kind].format(*self.parts, op=self.op)

    @property
    def type(self) -> str:
        if self.kind == "unary":
            return BOOL if self.op == "!" else EXPR
        if self.kind == "binary":
            return BOOL if self.op in LOGICAL + RELATIONAL + EQUALITY else EXPR
        return _TYPES.get(self.kind, PROPERTY)

    @property
    def depth(self) -> int:
        """Of a past value, 1 where none is written."""
        return int(self.op.lstrip(", ") or 1)

    @property
    def repetition(self) -> tuple[str, str]:
        """(opening, count) of a repeat."""
        at = 3 if self.op.startswith("[->") else 2
        return self.op[:at], self.op[at:].rstrip("]")

    def walk(self):
        yield self
        for p in self.parts:
            yield from p.walk()

    def rows(self, tree_id: int) -> list[tuple]:
        """(tree_id, node_id, parent_id, kind, op, text) of every node, parents first: the tree as a relation."""
        columns = tuple([] for _ in range(6))
        self.into(columns, tree_id)
        return list(zip(*columns))

    def into(self, columns: tuple[list, ...], tree_id: int) -> None:
        """Appends the values of rows() to six lists."""
        ids, numbers, parents, kinds, ops, texts = columns
        start = len(ids)

        def add(node: Node, parent: int | None) -> str:
            at, (kind, op, parts) = len(ids), node
            ids.append(tree_id)
            numbers.append(at - start)
            parents.append(parent)
            kinds.append(kind)
            ops.append(op)
            texts.append(op)
            if parts:  # the text is made of those of the parts
                texts[at] = _FORMS[kind].format(*[add(p, at - start) for p in parts], op=op)
            return texts[at]

        add(self, None)


@lru_cache(maxsize=10_000)
def sig(name: str) -> Node:
    return Node("signal", name)


def past(x: Node, depth: int | None = None) -> Node:
    return Node("past", "" if depth is None else f", {depth}", (x,))


def repeat(x: Node, op: str, count: str) -> Node:
    return Node("repeat", f"{op}{count}]", (x,))
