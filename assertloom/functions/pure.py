"""Text functions that keep state over characters or lines; plain Python for use in Arrow-batched functions."""

from __future__ import annotations

import re

from assertloom.functions.names import BUILTINS

_OPEN = {"property", "sequence", "module", "begin"}
_CLOSE = {"endproperty", "endsequence", "endmodule", "end"}
_CALLS = [(name, re.compile(rf"\{name}\s*\(([^)]*(?:\([^)]*\)[^)]*)*)\)", re.I)) for name in BUILTINS]
_FENCE = re.compile(r"```(?:systemverilog|verilog|sv)?\s*\n?(.*?)```", re.S | re.I)
_PAST = re.compile(r"\$past\s*\(\s*([a-zA-Z_]\w*)\s*(?:,\s*(\d+))?\s*\)", re.I | re.A)


def reindent(code: str, indent: int = 4) -> str:
    """Lines by the nesting of the first word of each."""
    depth, out = 0, []
    for line in code.strip().split("\n"):
        words = line.split()
        if not words:
            out.append("")
            continue
        first = words[0].lower()
        depth -= first in _CLOSE and depth > 0
        out.append(" " * (indent * depth) + line.strip())
        depth += first in _OPEN
    return "\n".join(out)


def _outside(line: str, mark: str) -> int:
    """Where `mark` first stands outside a string; both quotes open one, so the tick of a sized literal does too."""
    quote = ""
    for i, ch in enumerate(line):
        if ch in "\"'" and (i == 0 or line[i - 1] != "\\"):
            quote = ch if not quote else "" if ch == quote else quote
        elif not quote and line.startswith(mark, i):
            return i
    return -1


def strip_comments(code: str) -> str:
    """Without comments and blank lines, every line stripped; a block comment that ends within its line is cut once a line."""
    out, inside = [], False
    for line in code.split("\n"):
        if inside:
            if "*/" not in line:
                continue
            line, inside = line[line.index("*/") + 2 :], False
        elif (at := _outside(line, "/*")) >= 0:
            end = line.find("*/", at)
            inside = end < 0
            line = line[:at] + ("" if inside else line[end + 2 :])
        if not inside and (at := _outside(line, "//")) >= 0:
            line = line[:at]
        if line.strip():
            out.append(line.strip())
    return "\n".join(out)


def check_syntax(code: str) -> tuple[bool, str | None]:
    """The rules of functions.text.syntax_check."""
    p = b = 0
    for ch in code:
        p += (ch == "(") - (ch == ")")
        b += (ch == "[") - (ch == "]")
        if p < 0:
            return False, "Unbalanced parentheses: extra ')'"
        if b < 0:
            return False, "Unbalanced brackets: extra ']'"
    if p or b:
        return False, f"Unbalanced parentheses: {p} unclosed '('" if p else f"Unbalanced brackets: {b} unclosed '['"
    for word in ("property", "sequence"):
        n, m = (len(re.findall(rf"\b{w}\b", code, re.I)) for w in (word, "end" + word))
        if n != m:
            return False, f"Mismatched {word}/end{word}: {n} vs {m}"
    return True, None


def reply_code(reply: str, valid=lambda code: check_syntax(code)[0]) -> str:
    """The first fenced block, or the whole reply without fences, that is valid once its comments are gone; else the first that isn't empty; else ''."""
    blocks = [strip_comments(x.strip()) for x in (_FENCE.findall(reply) or [reply.strip()])]
    blocks = [x for x in blocks if x]
    if blocks:
        return next((x for x in blocks if valid(x)), blocks[0])
    lines = reply.strip().split("\n")
    if lines[0].startswith("```"):
        lines = lines[1:-1] if len(lines) > 1 and lines[-1].strip() == "```" else lines[1:]
    return strip_comments("\n".join(lines).strip())


def split_arguments(text: str) -> list[str]:
    """Parts between the commas that stand outside parentheses; empty ones are left out."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return [x.strip() for x in parts if x.strip()]


def nested_calls(expression: str) -> list[dict]:
    return [{"name": name, "arguments": split_arguments(m)} for name, pattern in _CALLS for m in pattern.findall(expression)]


def past_uses(expression: str) -> dict[str, int]:
    """The deepest $past of each signal, in order of first use."""
    out: dict[str, int] = {}
    for name, depth in _PAST.findall(expression):
        out[name] = max(out.get(name, 0), int(depth or 1))
    return out


def past_registers(expression: str, clock: str = "clk") -> str:
    """Declarations, a blank line, and the clocked shifts."""
    uses = past_uses(expression)
    regs = [f"    reg {s}_d{d};" for s, n in uses.items() for d in range(1, n + 1)]
    shifts: list[str] = []
    for s, n in uses.items():
        names = [s, *(f"{s}_d{d}" for d in range(1, n + 1))]
        shifts += [f"    always @(posedge {clock}) begin", "        if (!rst_n) begin", *(f"            {x} <= 1'b0;" for x in names[1:])]
        shifts += ["        end else begin", *(f"            {a} <= {b};" for a, b in zip(names[1:], names)), "        end", "    end", ""]
    return "\n".join(regs) + "\n\n" + "\n".join(shifts) if uses else ""
