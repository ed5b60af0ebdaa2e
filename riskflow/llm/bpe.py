"""Byte-pair merges on symbol sequences, and when two neighbouring pieces stay apart.

``Merges.run`` is the plain reference procedure (best rank first, leftmost on ties); the token
counter and the SentencePiece lattice ask it only about pairs of pieces and remember the answers.
"""

from __future__ import annotations


class Merges:
    """rank(left + right) or None; symbols are bytes or strings of one kind."""

    def __init__(self, rank):
        self.rank = rank
        self._apart: dict = {}

    def run(self, symbols: list) -> list:
        parts = list(symbols)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a, b, split) -> bool:
        """Whether merging the symbols of a + b ends with exactly a, b (a None: whether b stands alone)."""
        key = (a, b)
        got = self._apart.get(key)
        if got is None:
            if len(self._apart) > 4_000_000:
                self._apart.clear()
            symbols = split(b) if a is None else split(a) + split(b)
            got = self._apart[key] = self.run(symbols) == ([b] if a is None else [a, b])
        return got
