"""A parsed assertion as a description in three sections with definitions; works on text, by its own tolerant splitting of sequences."""

from __future__ import annotations

import re
from typing import NamedTuple

from assertloom.functions.pure import split_arguments
from assertloom.grammar import words

STYLES = ("symbolic", "natural")
_NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
_DELAY = re.compile(r"##\s*(\[\d+\s*:\s*\d+\s*\]|\[\d+\s*:\s*\$\s*\]|\d+)")
_CALLED = re.compile(r"\$[^\W\d_]\w*\s*")
_COMPUTES = ("===", "!==", "==", "!=", "<=", ">=", "<", ">", "^~", "~^", "^", "&", "|", "+", "-", "*", "/", "%")
_SIMPLE = re.compile(rf"{_NAME}|[!~+-]\s*{_NAME}|{_NAME}\s*(?:{'|'.join(map(re.escape, _COMPUTES))})\s*{_NAME}")
_SPOKEN = (
    ("|=>", "implies in the next cycle"), ("|->", "implies in the same cycle"), ("!==", "is not exactly equal to"), ("===", "is exactly equal to"), ("==", "equals"), ("!=", "does not equal"),
    (">=", "is at least"), ("<=", "is at most"), (">", "is greater than"), ("<", "is less than"), ("&&", "and"), ("||", "or"), ("^~", "bitwise XNOR"), ("~^", "bitwise XNOR"),
    ("^", "bitwise XOR"), ("&", "bitwise AND"), ("|", "bitwise OR"), ("+", "plus"), ("-", "minus"), ("*", "times"), ("/", "divided by"), ("%", "modulo"), ("?", "then"), (":", "else"),
)


class Part(NamedTuple):
    """A sequence by how it splits: base, repeat, delay, pair, first or ended."""

    kind: str
    op: str
    inner: tuple


# splitting


def _depths(text: str):
    """(index, character, nesting of parentheses, nesting of brackets), the nesting counted with the character itself and never below 0."""
    p = b = 0
    for i, ch in enumerate(text):
        p = max(0, p + (ch == "(") - (ch == ")"))
        b = max(0, b + (ch == "[") - (ch == "]"))
        yield i, ch, p, b


def _wraps(text: str) -> bool:
    """Whether the first parenthesis closes with the last character."""
    depth = 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == ")" and depth == 0 and i < len(text) - 1:
            return False
    return depth == 0


def bare(text: str) -> str:
    while text[:1] == "(" and text[-1:] == ")" and _wraps(text):
        text = text[1:-1].strip()
    return text


def _call(text: str, name: str) -> str | None:
    if text.startswith(name + "(") and text.endswith(")"):
        inner = text[len(name) + 1 : -1].strip()
        return inner if _wraps(f"({inner})") else None
    return None


def _repetition(text: str) -> tuple[str, str, str] | None:
    if not text.endswith("]"):
        return None
    depth = 0
    for i in range(len(text) - 1, -1, -1):
        depth += (text[i] == "]") - (text[i] == "[")
        if text[i] == "[" and depth == 0:
            inside, base = text[i + 1 : -1].strip(), text[:i].strip()
            mark = next((m for m in ("->", "*", "=") if inside.startswith(m)), None)
            count = inside[len(mark) :].strip() if mark else ""
            return (base, "[" + mark, count) if base and count else None
    return None


def _delay(text: str) -> tuple[str, str, str] | None:
    if "##" not in text:
        return None
    for i, _, p, b in _depths(text):
        if p == b == 0 and text.startswith("##", i):
            m = _DELAY.match(text, i)
            if not m:
                return None
            token = "##" + m[1].replace(" ", "")
            left, right = text[:i].strip(), text[i + len(token) :].strip()  # spaces within the token are not skipped
            return (left, token, right) if left and right else None
    return None


def _pair(text: str) -> tuple[str, str, str] | None:
    if not any(w in text for w in words.PAIRS):
        return None
    word = ""
    for i, ch, p, b in _depths(text):
        if p or b:
            word = ""
        elif ch.isalnum() or ch == "_":
            word += ch
        else:
            left, right = text[: i - len(word)].strip(), text[i:].strip()
            if word in words.PAIRS and left and right:
                return left, word, right
            word = ""
    return None


def _logical(text: str) -> tuple[str, str, str] | None:
    if "&&" not in text and "||" not in text:
        return None
    for i, _, p, b in _depths(text):
        if p == b == 0 and text[i : i + 2] in ("&&", "||"):
            left, right = text[:i].strip(), text[i + 2 :].strip()
            if left and right:
                return left, text[i : i + 2], right
    return None


def parts_of(text: str) -> Part:
    text = bare(text.strip())
    for name, kind in (("first_match", "first"), ("ended", "ended")):
        if (inner := _call(text, name)) is not None:
            return Part(kind, "", (parts_of(inner),))
    if found := _repetition(text):
        return Part("repeat", found[1] + found[2], (parts_of(found[0]),))
    for kind, split in (("delay", _delay), ("pair", _pair)):
        if found := split(text):
            return Part(kind, found[1], (parts_of(found[0]), parts_of(found[2])))
    return Part("base", text, ())


def computes(text: str) -> bool:
    """Whether an expression is more than a name, a sign on one, or an operator between two."""
    text = bare(text.strip())
    if not text or _SIMPLE.fullmatch(text) or any(m in text for m in ("##", "[*", "[=", "[->")):
        return False
    return any(op in text for op in _COMPUTES)


def tidy(text: str) -> str:
    text = re.sub(r"\(\s+", "(", re.sub(r"\s+", " ", text))
    return re.sub(r"\s+\)", ")", text).replace(" ,", ",").strip()


def spoken(text: str) -> str:
    """Operators in words; a plus that is no sum is dropped."""
    out, last = [], ""
    for ch in text:
        if ch == "+" and (not last or last in "([{:?,=<>!~&|^+-*/%"):
            continue
        out.append(ch)
        last = last if ch.isspace() else ch
    text = "".join(out)
    for op, english in _SPOKEN:
        text = text.replace(op, f" {english} ")
    return re.sub(r"~\s*", "bitwise not ", re.sub(r"!\s*", "not ", text))


def call_meaning(name: str, arguments: list[str]) -> str:
    if not arguments:
        return ""
    what = words.signal(arguments[0])
    if name == "$past":
        return f"the value of {what} from {arguments[1]} cycles ago" if len(arguments) > 1 else f"the previous value of {what}"
    return words.CALLS[name].format(what) if name in words.CALLS else f"{name} applied to {', '.join(arguments)}"


class _Description:
    def __init__(self, p: dict, style: str):
        self.style = style
        self.names = sorted({s["name"] for s in p["signals"]}, key=lambda n: (-len(n), n))
        self.sequences: dict[Part, str] = {}
        self.sequence_lines: list[str] = []
        self.sums: dict[str, str] = {}
        self.calls: dict[tuple, str] = {}
        self.call_lines: list[str] = []
        for f in p["builtin_functions"]:
            key = (f["name"], *f["arguments"])
            if key not in self.calls and (meaning := call_meaning(f["name"], list(f["arguments"]))):
                self.calls[key] = f"Sys_{len(self.calls)}"
                self.call_lines.append(f"{self.calls[key]}: {meaning}")

    def with_calls(self, text: str) -> str:
        """Calls of built-in functions become their symbols, or what they mean; a call that isn't closed stays without its space."""
        out, i = [], 0
        while m := _CALLED.search(text, i):
            out.append(text[i : m.start()])
            name, i = m[0].rstrip(), m.end()
            if text[i : i + 1] == "(":
                depth, k = 1, i + 1
                while k < len(text) and depth:
                    depth += (text[k] == "(") - (text[k] == ")")
                    k += 1
                if not depth:
                    arguments = split_arguments(text[i + 1 : k - 1])
                    out.append(self.calls.get((name, *arguments)) or call_meaning(name, arguments))
                    i = k
                    continue
            out.append(name)
        return "".join(out) + text[i:]

    def with_signals(self, text: str) -> str:
        for n in self.names:
            if n not in text:
                continue
            text = re.sub(rf"\b{re.escape(n)}\b", words.signal(n).replace("\\", r"\\"), text)
        return text

    def flat(self, text: str) -> str:
        text = self.with_signals(self.with_calls(text))
        return tidy(text.replace("&&", " and ").replace("||", " or "))

    def expression(self, text: str) -> str:
        if self.style == "natural":
            return tidy(self.with_signals(spoken(self.with_calls(text))))
        text = text.strip()
        seq = parts_of(text)
        if seq.kind != "base":
            return self.sequence(seq, True)
        if split := _logical(text):
            return f"{self.expression(split[0])} {'and' if split[1] == '&&' else 'or'} {self.expression(split[2])}"
        if computes(text):
            return self.sums.setdefault(text, f"Calc_{len(self.sums)}")
        return self.flat(text)

    def sequence(self, s: Part, root: bool) -> str:
        if s.kind == "base":
            return self.flat(s.op)
        if not root:
            if s not in self.sequences:
                self.sequences[s] = f"Seq_{len(self.sequences)}"
                self.sequence_lines.append(f"{self.sequences[s]}: {self.sequence(s, True)}")
            return self.sequences[s]
        inner = [self.sequence(x, False) for x in s.inner]
        if s.kind == "repeat":
            at = 3 if s.op.startswith("[->") else 2
            return words.repeated(s.op[:at], s.op[at:].rstrip("]"), inner[0])
        if s.kind == "delay":
            return f"{inner[0]} followed by {inner[1]} {words.delay(s.op)}"
        if s.kind == "pair":
            return words.PAIRS[s.op].format(*inner)
        return f"the first match of {inner[0]}" if s.kind == "first" else f"{inner[0]} has ended"


def translate(code: str, p: dict, body: str, style: str = "symbolic") -> str:
    """The description of an assertion, from its text, its parsed struct and its body."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    d = _Description(p, style)
    sides = [(side, p[side]) for side in ("antecedent", "consequent") if p[side]]
    refs = {side: f"Exp_{i}" for i, (side, _) in enumerate(sides)}
    said = [f"{refs[side]}: {d.expression(text)}" for side, text in sides]
    clock, op = p["clock_signal"], p["implication_type"]
    edge = "rising edge" if p["clock_edge"] == "posedge" else "falling edge"
    lines = ["**1. Relevant Signals:**"]
    lines.append(f"- Clock name: `{clock}`, trigger at every {edge} of `{clock}`" if clock else "- Clock not specified; sampling assumed at each evaluation cycle")
    if p["reset_signal"]:
        lines.append(f"- Reset signal: `{p['reset_signal']}` (active {'low' if p['reset_active_low'] else 'high'})")
    elif p["disable_condition"]:
        lines.append(f"- Disable condition: `{p['disable_condition']}`")
    else:
        lines.append("- Reset not specified in the description, so none assumed")
    if p["disable_condition"]:
        lines.append(f"- Scope: This property is active unless {p['disable_condition']} is asserted.")
    others = sorted(s["name"] for s in p["signals"] if not s["is_clock"] and not s["is_reset"])
    lines.append("- Other relevant signals: " + (", ".join(f"`{n}`" for n in others) or "(none detected)"))
    lines += ["", "2. Check Condition:"]
    if not op:
        lines += [f"Evaluate the property: {body or code}", "", "3. Expected Results:", "No explicit implication; the property is the condition itself."]
    else:
        at = f"At a {edge} of `{clock}`" if clock else "At each evaluation cycle"
        lines.append(f"{at}, the target condition is that {refs.get('antecedent', 'the trigger')} holds.")
        same = op == "|->"
        when = (f"At that same {edge} of `{clock}`" if same else f"On the next {edge} of `{clock}`") if clock else f"In the {'same' if same else 'next'} cycle"
        lines += ["", "3. Expected Results:", f"{when}, {refs.get('consequent', 'the outcome')} must hold."]
    sums = [f"{symbol}: The result of: {text}" for text, symbol in d.sums.items()]
    if told := d.sequence_lines + sums + said + d.call_lines:
        lines += ["", "Definitions:", *(f"- {x}" for x in told)]
    return "\n".join(lines).strip()
