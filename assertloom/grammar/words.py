"""English for names, delays and counts, shared by the two describers."""

from __future__ import annotations

SHORT = {"req": "request", "ack": "acknowledge", "gnt": "grant", "clk": "clock", "rst": "reset", "en": "enable", "data_en": "data enable", "addr": "address", "we": "write enable", "re": "read enable"}
CALLS = {
    "$rose": "{} rises from low to high",
    "$fell": "{} falls from high to low",
    "$stable": "{} remains stable",
    "$changed": "{} changes value",
    "$onehot": "exactly one bit of {} is high",
    "$onehot0": "at most one bit of {} is high",
    "$isunknown": "{} is unknown (X or Z)",
    "$countones": "the count of high bits in {}",
}
PAIRS = {"intersect": "Sequence {} and Sequence {} start and end at the exact same time", "throughout": "{} holds true throughout the execution of {}", "and": "{} and {} both occur", "or": "{} or {} occurs"}


def signal(name: str) -> str:
    """`the request (req) signal` for a short name that is known in any case, else `the NAME signal`."""
    low = name.lower()
    return f"the {SHORT[low]} ({low}) signal" if low in SHORT else f"the {name} signal"


def delay(token: str) -> str:
    """When the right side of a delay comes; a text that is no delay counts as at once."""
    if not token.startswith("##") or token == "##0":
        return "immediately"
    low, _, high = token[2:].strip("[]").partition(":")
    if high == "$":
        return "eventually" if int(low) == 0 else f"at least {int(low)} cycles later"
    if high and int(high) != int(low):
        return f"between {int(low)} and {int(high)} cycles later"
    n = int(low)
    if n == 1:
        return "one cycle later" if high else "in the next cycle"
    return f"{n} cycles later"


def times(count: str) -> str:
    low, colon, high = count.partition(":")
    if colon and high == "$":
        return f"at least {low} times"
    if colon and high != low:
        return f"between {low} and {high} times"
    return "an unbounded number of times" if count == "$" else f"{low} times"


def ordinal(count: str) -> str:
    """1st, 2nd, 3rd, 11th; of a range its lower end; `$-th` where that is no number."""
    low = count.split(":")[0].strip()
    if not low.lstrip("-").isdigit():
        return f"{count}-th"
    n = int(low)
    return f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def repeated(op: str, count: str, what: str) -> str:
    """op is [*, [= or [->, count stands without its bracket."""
    if op == "[*":
        return f"{what} remains true {times(count)} consecutively"
    if op == "[=":
        return f"{what} occurs {times(count)} non-consecutively before the sequence continues"
    return f"wait for the {ordinal(count)} occurrence of {what}"
