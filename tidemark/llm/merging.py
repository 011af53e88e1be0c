"""Sorted runs of fixed-width strings: front coding, and a k-way merge that never compares a known prefix again."""

from __future__ import annotations

import numpy as np

END = object()


def common_prefix(rows: np.ndarray, step: int = 4096) -> np.ndarray:
    """Length of the prefix each row of a byte matrix shares with the row before it; 0 for the first.  Compares ``step`` rows at a time."""
    out = np.zeros(len(rows), dtype=np.int64)
    for a in range(1, len(rows), step):
        now = rows[a:a + step]
        unlike = now != rows[a - 1:a - 1 + len(now)]
        out[a:a + step] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), rows.shape[1])
    return out


def front_coded(rows: np.ndarray, prefix: np.ndarray) -> bytes:
    """The bytes of each sorted row from its shared prefix on, one after the other."""
    return rows[np.arange(rows.shape[1])[None, :] >= prefix[:, None]].tobytes()


class Run:
    """A front-coded run, read row by row: ``row`` is the current string and ``prefix`` what it shares with the one before."""

    def __init__(self, data: bytes, prefix: np.ndarray, width: int) -> None:
        self.data, self.prefixes, self.width = data, prefix.tolist(), width
        self.at, self.place, self.row, self.prefix = -1, 0, b"", 0

    def advance(self) -> bool:
        self.at += 1
        if self.at >= len(self.prefixes):
            self.row = None
            return False
        self.prefix = self.prefixes[self.at]
        end = self.place + self.width - self.prefix
        self.row = self.row[:self.prefix] + self.data[self.place:end]
        self.place = end
        return True


def _mismatch(a: bytes, b: bytes, start: int, width: int) -> int:
    x, y = a[start:], b[start:]
    if x == y:
        return width
    return width - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def merged(runs: list[Run], width: int) -> tuple[list[int], list[int], list[int]]:
    """Run and row number of every string in sorted order, and the prefix it shares with the one before.

    A loser tree: each inner node holds the run that lost there and the prefix its string shares with the string that beat it, which is
    the last one put out on that path.  Of two candidates the one that shares more with the last output is smaller; only where
    both share the same are bytes compared, and only behind that prefix.
    """
    k = 1
    while k < len(runs):
        k *= 2
    shared = [0] * k
    for r in range(k):
        if r < len(runs):
            runs[r].advance()
            shared[r] = 0
    rows: list[bytes | None] = [runs[r].row if r < len(runs) else None for r in range(k)]
    loser, lost = [0] * k, [0] * k

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; both ``shared`` values refer to the same string, and the loser's is brought up to the winner."""
        x, y = rows[a], rows[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        at = _mismatch(x, y, shared[a], width)
        win, lose = (a, b) if at == width or x[at] < y[at] else (b, a)
        shared[lose] = at
        return win, lose

    winners = [0] * (2 * k)
    for r in range(k):
        winners[k + r] = r
    for node in range(k - 1, 0, -1):
        win, lose = duel(winners[2 * node], winners[2 * node + 1])
        winners[node], loser[node], lost[node] = win, lose, shared[lose]
    top = winners[1] if k > 1 else 0
    out_run, out_row, out_prefix = [], [], []
    while rows[top] is not None:
        run = runs[top]
        out_run.append(top)
        out_row.append(run.at)
        out_prefix.append(shared[top])
        run.advance()
        rows[top] = run.row
        shared[top] = run.prefix
        node = (k + top) // 2
        while node:
            other = loser[node]
            shared[other] = lost[node]
            win, lose = duel(top, other)
            loser[node], lost[node] = lose, shared[lose]
            top = win
            node //= 2
    return out_run, out_row, out_prefix
