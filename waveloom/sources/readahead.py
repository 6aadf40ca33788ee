"""Small reads of a file served from larger ones."""

from __future__ import annotations

LEAST, MOST = 1 << 16, 1 << 20  # bytes of one read ahead


class ReadAhead:
    """``read_at`` of a random-access file with one buffer.

    Reads that go on close behind the last one double what is read ahead, up to MOST; a jump over data that nobody asks for sets it
    back to LEAST, so walking over the headers of large segments does not fetch their data.
    """

    def __init__(self, file, least: int = LEAST, most: int = MOST):
        self.file, self.least, self.most = file, least, most
        self.at, self.held, self.ahead = 0, b"", least

    def read_at(self, n: int, pos: int) -> bytes:
        lo = pos - self.at
        if 0 <= lo and lo + n <= len(self.held):
            return self.held[lo:lo + n]
        near = 0 <= lo <= len(self.held) + self.least
        self.ahead = min(self.most, 2 * self.ahead) if near else self.least
        if n >= self.ahead:
            return self.file.read_at(n, pos)
        self.at, self.held = pos, self.file.read_at(self.ahead, pos)
        return self.held[:n]

    def close(self) -> None:
        self.file.close()
