"""Engines that decide implication or check syntax: the built-in ones, and external programs where they are installed."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from dataclasses import dataclass
from typing import Protocol

from assertloom.functions.names import BUILTINS
from assertloom.functions.pure import check_syntax, past_registers
from assertloom.grammar.parser import SyntaxProblem, parse
from assertloom.verify import bounded

#: What an engine may answer.
RESULTS = ("implies", "not_implies", "equivalent", "error", "timeout", "syntax_error")


class Engine(Protocol):
    def check(self, antecedent: str, consequent: str, clock: str = "clk", edge: str = "posedge") -> tuple[str, str, str | None]:
        """(result, message, counterexample) for two bare property expressions, both on the antecedent's clock."""


@dataclass(frozen=True)
class Bounded:
    """The built-in checker. Its cycles are those of the one clock, whatever that is called."""

    bound: int = bounded.BOUND
    limit: int = 200_000
    seconds: float = 20.0

    def check(self, antecedent: str, consequent: str, clock: str = "clk", edge: str = "posedge") -> tuple[str, str, str | None]:
        return bounded.check(antecedent, consequent, self.bound, self.limit, self.seconds)


def module(antecedent: str, consequent: str, signals: list[str], clock: str = "clk", edge: str = "posedge", name: str = "implication_check") -> str:
    """A module in which the antecedent is assumed, and covered, and the consequent asserted."""
    ports = ",\n".join(f"  input wire {s}" for s in [clock, "rst_n", *signals])
    at = f"@({edge} {clock}) disable iff (!rst_n)"
    goals = "\n".join(f"  {label}: {verb} property ({at} {x});" for label, verb, x in (("assume_antecedent", "assume", antecedent), ("assert_consequent", "assert", consequent), ("cover_antecedent", "cover", antecedent)))
    past = past_registers(f"{antecedent} {consequent}", clock)
    return f"module {name} (\n{ports}\n);\n" + (past + "\n" if past else "") + f"{goals}\nendmodule\n"


@dataclass(frozen=True)
class Program:
    """An external bounded prover: `command FILE --top NAME --bound DEPTH`, whose return code 0 means proved."""

    command: str = "ebmc"
    bound: int = 20
    seconds: float = 300.0

    def available(self) -> bool:
        return shutil.which(self.command) is not None

    def check(self, antecedent: str, consequent: str, clock: str = "clk", edge: str = "posedge") -> tuple[str, str, str | None]:
        if not self.available():
            return "error", f"{self.command} is not installed", None
        names = sorted(set(re.findall(r"\b[a-zA-Z_]\w*\b", re.sub(r"\$\w+|\d+'\w+", "", f"{antecedent} {consequent}"))) - {"and", "or", "not", "throughout", "intersect", "within", "first_match", "until", "until_with", clock, "rst_n"})
        with tempfile.TemporaryDirectory() as folder:  # a scratch file of this task alone
            path = os.path.join(folder, "check.sv")
            with open(path, "w", encoding="utf-8") as f:
                f.write(module(antecedent, consequent, names, clock, edge))
            try:
                run = subprocess.run([self.command, path, "--top", "implication_check", "--bound", str(self.bound)], capture_output=True, text=True, timeout=self.seconds)
            except subprocess.TimeoutExpired:
                return "timeout", f"no result in {self.seconds:g} s", None
        return self.verdict(run.returncode, run.stdout + run.stderr, f"{antecedent} {consequent}")

    def verdict(self, code: int, log: str, text: str) -> tuple[str, str, str | None]:
        if code == 0:
            return "implies", "the antecedent implies the consequent", None
        unknown = [n for n in BUILTINS if n in ("$changed", "$isunknown", "$countones", "$sampled", "$bits") and re.search(rf"(?i)\{n}\s*\(", text)]
        if unknown:
            return "error", "unsupported functions: " + ", ".join(unknown), None
        low = log.lower()
        if "refuted" not in low and re.search("syntax error|parse error|parsing error|unexpected|unknown identifier", low):
            return "syntax_error", next((x.strip() for x in log.split("\n") if "error" in x.lower()), "syntax error"), None
        if "refuted" not in low and "error" in low:
            return "error", next((x.strip() for x in log.split("\n") if "error" in x.lower()), "error"), None
        lines = log.split("\n")
        at = next((i for i, x in enumerate(lines) if re.search("counterexample|refuted|state|cycle", x.lower())), None)
        return "not_implies", "the antecedent does not imply the consequent", None if at is None else "\n".join(lines[at : at + 51])


def valid(text: str) -> tuple[bool, str | None]:
    """The built-in syntax check: balanced, and, if it is a bare expression, by the grammar."""
    ok, message = check_syntax(text)
    if not ok or re.search(r"(?i)\b(property|module|sequence)\b", text):
        return ok, message
    try:
        parse(text)
    except (SyntaxProblem, RecursionError) as e:
        return False, str(e)
    return True, None
