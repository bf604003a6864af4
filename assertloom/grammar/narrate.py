"""English for a tree, with symbols for the parts that are not simple: a scope, one sentence of logic, and definitions."""

from __future__ import annotations

from assertloom.grammar import words
from assertloom.grammar.nodes import Node


def _simple(x: Node) -> bool:
    if x.kind in ("unary", "binary") or x.kind == "delay" and x.op == "##0":
        return all(map(_simple, x.parts))
    return x.kind == "signal"


def _plain(x: Node) -> str:
    """A simple node with signals in words and operators as they are; any other node as it is written."""
    if x.kind == "signal":
        return words.signal(x.op)
    if x.kind == "unary":
        return x.op + _plain(x.parts[0])
    if x.kind == "binary":
        return f"({_plain(x.parts[0])} {x.op} {_plain(x.parts[1])})"
    return str(x)


class _Symbols:
    """Names given to parts; equal parts have one. One counter serves all prefixes."""

    def __init__(self) -> None:
        self.of: dict[str, str] = {}
        self.lines: list[str] = []

    def named(self, x: Node, prefix: str, meaning: str) -> str:
        key = str(x)
        if key not in self.of:
            self.of[key] = f"{prefix}_{len(self.of)}"
            self.lines.append(f"* {self.of[key]}: {meaning}\n")
        return self.of[key]

    def tell(self, x: Node, root: bool = False) -> str:
        """What x says: at the root in full, inside as a symbol unless it is simple."""
        if x.kind == "signal":
            return words.signal(x.op)
        if x.kind == "implies":
            return self.sentence(x)
        told = self._meaning(x)
        if told is None:
            return _plain(x)
        prefix, meaning = told
        return meaning if root and prefix != "Calc" else self.named(x, prefix, meaning)

    def _meaning(self, x: Node) -> tuple[str, str] | None:
        if x.kind == "binary" and x.op not in ("&&", "||"):
            return None if _simple(x) else ("Calc", f"The result of: {x}")
        if x.kind not in ("binary", "call", "past", "delay", "repeat", "seq", "if", "if_else", "until", "prop"):
            return None
        p = [self.tell(part) for part in x.parts]
        if x.kind == "binary":
            return "Exp", f"{p[0]} {'and' if x.op == '&&' else 'or'} {p[1]}"
        if x.kind == "call":
            return "Sys", words.CALLS.get(x.op, x.op + " applied to {}").format(p[0])
        if x.kind == "past":
            return "Past", f"the previous value of {p[0]}" if x.depth == 1 else f"the value of {p[0]} from {x.depth} cycles ago"
        if x.kind == "delay":
            return "Seq", f"{p[0]} followed by {p[1]} {words.delay(x.op)}"
        if x.kind == "repeat":
            return "Seq", words.repeated(*x.repetition, p[0])
        if x.kind == "seq":
            return "Seq", words.PAIRS[x.op].format(*p)
        if x.kind == "until":
            return "Prop", f"{p[0]} holds {'until and including' if x.op == 'until_with' else 'until'} {p[1]} occurs"
        if x.kind == "prop":
            return "Prop", f"{p[0]} {x.op} {p[1]}"
        return "Prop", f"If {p[0]} holds, then {p[1]}" + (f", otherwise {p[2]}" if len(p) == 3 else "")

    def sentence(self, x: Node) -> str:
        trigger, outcome = (self.tell(p, root=True) for p in x.parts)
        return f"When {trigger} occurs, then in the {'next' if x.op == '|=>' else 'same'} cycle, {outcome} must hold."


def narrate(x: Node) -> str:
    """The description that goes with a synthesised property; only a disable clause at the root gives a scope."""
    scope = ""
    if x.kind == "disable":
        scope, x = f"Scope: This property is active unless {_plain(x.parts[0])} is asserted.\n", x.parts[1]
    symbols = _Symbols()
    logic = symbols.tell(x, root=True)
    return f"{scope}Logic: {logic}\nDefinitions:\n" + "".join(symbols.lines)
