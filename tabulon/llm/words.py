"""Words and other pieces of Arrow text columns by position and hash, without an object for each.

A word is a run of bytes other than ASCII white space.  Pieces of up to 16 bytes are hashed from two
unaligned 64-bit reads each, longer ones one by one; equal pieces have equal hashes in every process.
"""
from __future__ import annotations

from collections.abc import Iterator

#: Odd multipliers of the hashes.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(x):
    """A scrambled copy of 64-bit numbers (one to one)."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(MIX[3])
    x ^= x >> np.uint64(29)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column):
    """The bytes of all texts of an Arrow string column (nulls: none) and 16 of padding; where each text starts and the last one ends."""
    import numpy as np
    import pyarrow as pa

    n = len(column)
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[offs[0] : offs[-1]] if n and buffers[2] is not None else np.zeros(0, np.uint8)
    data = np.zeros(len(raw) + 16, np.uint8)
    data[: len(raw)] = raw
    return data, offs - offs[0]


class Pieces:
    """Pieces of texts: data, the texts' bytes with padding; start and end of each piece there; first, the number of
    pieces before each text and in all; hash of each piece."""

    def __init__(self, data, start, end, first):
        import numpy as np
        import xxhash

        self.data, self.start, self.end, self.first = data, start, end, first
        size = end - start
        self.low, self.more = self.read(0), np.flatnonzero(size > 8)
        self.high = self.read(8, self.more)
        h = mixed((self.low + np.uint64(MIX[4]) * size.astype(np.uint64)) * np.uint64(MIX[0]))
        h[self.more] = mixed(h[self.more] + np.uint64(MIX[5]) * self.high)
        text = data.data
        for k in np.flatnonzero(size > 16).tolist():
            h[k] = xxhash.xxh3_64_intdigest(text[start[k] : end[k]])
        self.hash = h

    def read(self, skip: int, some=slice(None)):
        """Up to eight bytes of each piece after the first skip, as numbers."""
        import numpy as np

        at, left = self.start[some] + skip, self.end[some] - self.start[some] - skip
        words = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        keep = np.append((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        return words[np.where(left > 0, at, 0)] & keep[np.clip(left, 0, 8)]

    def runs(self, span: int):
        """Hashes of the runs of span pieces (six at most) that begin at each (the last ones of a text run on into the next text)."""
        import numpy as np

        n = max(0, len(self.hash) - span + 1)
        x = np.zeros(n, np.uint64)
        for j in range(span):
            x += self.hash[j : j + n] * np.uint64(MIX[j])
        return mixed(x)

    def spaced(self):
        """The pieces of all texts joined by one space each, and where each piece starts and ends there."""
        import numpy as np

        size = self.end - self.start
        start = np.cumsum(size + 1) - size - 1
        at = np.repeat(self.start - start, size + 1)
        at += np.arange(len(at))
        line = self.data[at] if len(at) else self.data[:0]
        line[start + size] = 32
        return line.tobytes(), start, start + size

    def numbered(self):
        """A number for each piece, and the first place of each number; equal numbers, equal pieces."""
        import numpy as np
        import pandas as pd

        codes, _ = pd.factorize(self.hash)
        size, text = self.end - self.start, self.data.data
        first = firsts(codes)
        like = first[codes] if len(codes) else codes
        same = bool(((size == size[like]) & (self.low == self.low[like])).all())
        if same and len(self.more):
            high = np.zeros(len(size), np.uint64)
            high[self.more] = self.high
            same = bool((self.high == high[like[self.more]]).all())
            long = self.more[(size[self.more] > 16) & (like[self.more] != self.more)]
            same = same and all(text[i:j] == text[u:v] for i, j, u, v in zip(*(x.tolist() for x in (self.start[long], self.end[long], self.start[like[long]], self.end[like[long]]))))
        if not same:
            codes = pd.factorize(np.array([*self.bytes(), None], object)[:-1])[0]
            first = firsts(codes)
        return codes, first

    def bytes(self, some=None) -> list[bytes]:
        """The pieces at the places some (all if None)."""
        raw = self.data.tobytes()
        start, end = (self.start, self.end) if some is None else (self.start[some], self.end[some])
        return [raw[i:j] for i, j in zip(start.tolist(), end.tolist())]


def firsts(codes):
    """The first place of each of the numbers 0, 1, 2 ..."""
    import numpy as np

    out = np.empty(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


class Words(Pieces):
    """The words of a text column; with lower, A to Z count as a to z."""

    def __init__(self, column, lower: bool = False):
        import numpy as np

        data, offs = text_bytes(column)
        raw = data[: offs[-1]]
        if lower:
            raw[(raw >= 65) & (raw <= 90)] |= 32
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= edge[1:-1] | ~solid[:-1]
        stop[:-1] &= edge[1:-1] | ~solid[1:]
        start = np.flatnonzero(begin)
        self.texts = offs
        super().__init__(data, start, np.flatnonzero(stop) + 1, np.searchsorted(start, offs))


def laid_out(values: list[bytes], codes, ends, width: int) -> Iterator[bytes]:
    """Between each two neighbouring ends, the values of the codes there, joined; all are multiples of width long."""
    import numpy as np

    units = np.frombuffer(b"".join(values), f"<u{width}")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
    starts, sizes = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    after = np.cumsum(sizes)
    kind = np.int32 if max(len(units), int(after[-1]) if len(after) else 0) < 1 << 31 else np.int64
    at = np.repeat((starts - (after - sizes)).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    out = units[at]
    bounds = np.append(0, after)[ends].tolist()
    return (out[i:j].tobytes() for i, j in zip(bounds, bounds[1:]))
