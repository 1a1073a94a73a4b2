"""Sorted suffix runs, front-coded, and a loser tree that merges them without comparing a known prefix again."""

from __future__ import annotations

import numpy as np


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, known to be at least `at`."""
    n = min(len(a), len(b))
    while at < n:
        to = min(n, at + 16)
        if a[at:to] == b[at:to]:
            at = to
            continue
        while a[at] == b[at]:
            at += 1
        break
    return at


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted strings as shared-prefix lengths, lengths of the rest (both uint16) and the rests."""
    lcp, rest, last = [], [], b""
    for s in strings:
        k = common(last, s, 0)
        lcp.append(k)
        rest.append(s[k:])
        last = s
    return np.array(lcp, "<u2").tobytes(), np.array([len(r) for r in rest], "<u2").tobytes(), b"".join(rest)


def decode(lcp: bytes, size: bytes, rest: bytes) -> tuple[list[bytes], list[int]]:
    shared, out, at, last = np.frombuffer(lcp, "<u2").tolist(), [], 0, b""
    for k, n in zip(shared, np.frombuffer(size, "<u2").tolist(), strict=True):
        last = last[:k] + rest[at : at + n]
        at += n
        out.append(last)
    return out, shared


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, each with its common prefixes with the string before.

    Returns (run, position) in sorted order, ties by run, and each one's common prefix with the one before it.
    Every head carries its common prefix with what its place in the tree last lost to. The longer of two such prefixes
    wins unseen; only where they are equal are the strings read, and only from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[] for _ in range(k - len(runs))]
    shared = [r[1] for r in runs] + [[] for _ in range(k - len(runs))]
    at = [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in strings]
    know = [0 if s else -1 for s in strings]  # -1: the run has ended and loses to all

    def winner(a: int, b: int) -> int:
        if know[a] != know[b]:
            return a if know[a] > know[b] else b
        if know[a] < 0:
            return min(a, b)
        x, y = head[a], head[b]
        n = common(x, y, know[a])
        first = a < b if n == len(x) == len(y) else n == len(x) or (n < len(y) and x[n] < y[n])
        know[b if first else a] = n
        return a if first else b

    tree = [0] * k  # the loser at each inner node

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        w = winner(a, b)
        tree[node] = b if w == a else a
        return w

    top, order, prefixes = build(1) if k > 1 else 0, [], []
    while know[top] >= 0:
        order.append((top, at[top]))
        prefixes.append(know[top])
        i = at[top] = at[top] + 1
        if i < len(strings[top]):
            head[top], know[top] = strings[top][i], shared[top][i]
        else:
            head[top], know[top] = None, -1
        node = (top + k) // 2
        while node:
            w = winner(top, tree[node])
            if w != top:
                tree[node], top = top, w
            node //= 2
    return order, prefixes
