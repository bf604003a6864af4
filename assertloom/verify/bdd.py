"""Binary decision diagrams over integer-numbered variables, shared and reduced."""

from __future__ import annotations


class TooLarge(RuntimeError):
    pass


class Bdd:
    """Node 0 is false and 1 is true; any other node is (variable, low, high)."""

    def __init__(self, limit: int = 200_000):
        self.nodes: list[tuple[int, int, int]] = [(1 << 60, 0, 0), (1 << 60, 1, 1)]
        self.known: dict[tuple[int, int, int], int] = {}
        self.done: dict[tuple[int, int, int], int] = {}
        self.limit = limit

    def node(self, v: int, low: int, high: int) -> int:
        if low == high:
            return low
        key = (v, low, high)
        if key not in self.known:
            if len(self.nodes) > self.limit:
                raise TooLarge("too many states")
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return self.known[key]

    def var(self, v: int) -> int:
        return self.node(v, 0, 1)

    def ite(self, f: int, g: int, h: int) -> int:
        """g where f holds, else h."""
        if f < 2:
            return g if f else h
        if g == h:
            return g
        if (g, h) == (1, 0):
            return f
        key = (f, g, h)
        if key not in self.done:
            v = min(self.nodes[x][0] for x in key)
            low, high = (self.ite(*[self.nodes[x][side] if self.nodes[x][0] == v else x for x in key]) for side in (1, 2))
            self.done[key] = self.node(v, low, high)
        return self.done[key]

    def no(self, a: int) -> int:
        return self.ite(a, 0, 1)

    def all(self, *xs: int) -> int:
        out = 1
        for x in xs:
            out = self.ite(out, x, 0)
        return out

    def any(self, *xs: int) -> int:
        out = 0
        for x in xs:
            out = self.ite(out, 1, x)
        return out

    def same(self, a: int, b: int) -> int:
        return self.ite(a, b, self.no(b))

    def example(self, f: int) -> dict[int, bool]:
        """Values of some variables under which f, which isn't false, holds."""
        out = {}
        while f > 1:
            v, low, high = self.nodes[f]
            out[v] = high != 0
            f = high or low
        return out
