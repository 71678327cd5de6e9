"""Front-coded sorted runs and their merge by a loser tree that never compares a known prefix again."""

from __future__ import annotations

from collections.abc import Iterator


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix; the first ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = a[len(a) - n :], b[len(b) - n :]
    if x == y:
        return n
    differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
    return n - (differ.bit_length() + 7) // 8


def front_code(ordered: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(prefix shared with the one before, the other bytes) of each of a sorted list."""
    shared, tails, before = [], [], b""
    for s in ordered:
        n = common_prefix(before, s)
        shared.append(n)
        tails.append(s[n:])
        before = s
    return shared, tails


class Run:
    """Reads a front-coded run: ``head`` is the current string, ``shared`` what it shares with the one before."""

    __slots__ = ("shared_all", "tails", "at", "head", "shared")

    def __init__(self, shared: list[int], tails: list[bytes]) -> None:
        self.shared_all, self.tails, self.at, self.head, self.shared = shared, tails, -1, b"", 0

    def step(self) -> bool:
        self.at += 1
        if self.at == len(self.tails):
            return False
        self.shared = self.shared_all[self.at]
        self.head = self.head[: self.shared] + self.tails[self.at]
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, index in the run, prefix shared with the string put out before, string), in sorted order.

    Each head carries the length of the prefix it shares with the last winner. Of two heads the one that
    shares more is the smaller, without looking at a byte; only equal lengths are compared, and from there on.
    """
    runs = [r for r in runs]
    live = [r.step() for r in runs]
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    known = [0] * len(runs)  # prefix shared with the last winner, or with the head it lost to
    heads = [r.head for r in runs]
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then the one it shares with the winner."""
        if b < 0 or not live[b]:
            return a, b
        if a < 0 or not live[a]:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(heads[a], heads[b], known[a])
        if heads[a][n : n + 1] <= heads[b][n : n + 1]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = [k if k < len(runs) else -1 for k in range(size)]
    at = size
    while at > 1:
        at //= 2
        nxt = []
        for k in range(at):
            won, lost = play(winners[2 * k], winners[2 * k + 1])
            losers[at + k] = lost
            nxt.append(won)
        winners = nxt
    best = winners[0]
    while best >= 0 and live[best]:
        run = runs[best]
        yield best, run.at, known[best], heads[best]
        live[best] = run.step()
        known[best], heads[best] = run.shared, run.head
        node = (best + size) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
