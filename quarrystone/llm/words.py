"""Words and word n-grams of Arrow text columns as numpy arrays of 64-bit hashes.

Tasks read whole Arrow batches without making a Python string of each word:
bytes are classed by a table, a word is a run of word bytes, and its hash is a
polynomial over its bytes, taken from one running sum over the buffer. All sums
are modulo 2^64; the bytes' values and the base are fixed, so hashes are the
same in every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _fixed(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")


BASE = np.uint64(_fixed("base") | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
GRAM = np.uint64(_fixed("gram") | 1)
VALUES = np.array([_fixed(f"byte{i}") for i in range(256)], dtype=np.uint64)

#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def _class(words: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(words)] = True
    return table


#: Digits, letters and all bytes of non-ASCII characters.
ALNUM = _class(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
#: All but ASCII white space.
NONSPACE = ~_class(bytes([32, *range(9, 14)]))

#: Bytes of a run of whole texts.
MOST = 1 << 20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        # Runs of whole texts have 2^20 bytes: those are met without twice as many powers.
        size = MOST + 2 if n <= MOST + 2 else 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits (a finaliser of 64-bit hashes)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unmixed(h: np.ndarray) -> np.ndarray:
    """The hash that ``mixed`` made ``h`` of."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


class Words:
    """The words of some texts.

    buf: the texts' bytes, joined; at: where each text starts (one more at the
    end); starts, ends: of each word in ``buf``; first: the number of the first
    word of each text (one more at the end).
    """

    def __init__(self, buf: np.ndarray, at: np.ndarray, letters: np.ndarray, fold: np.ndarray = LOWER):
        self.buf, self.at = buf, at
        n = len(buf)
        if n == 0:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
            self.first = np.zeros(len(at), dtype=np.int64)
            self.sums = np.zeros(1, dtype=np.uint64)
            self.down = np.ones(1, dtype=np.uint64)
            return
        inside = letters[buf]
        cut = np.zeros(n + 1, dtype=bool)
        cut[at] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        over = inside.copy()
        over[:-1] &= ~inside[1:] | cut[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(over) + 1
        self.first = np.searchsorted(self.starts, at)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(VALUES[fold][buf] * up[:n], out=self.sums[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans (equal for equal folded bytes)."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self) -> np.ndarray:
        """For each word, how many words of its text there are from it on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, whole buffer; check ``room() >= k``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = h[:n].copy()
    for i in range(1, k):
        total = total * GRAM + h[i : i + n]
    return mixed(total)


def text_array(column: pa.Array) -> pa.Array:
    """A string column with 64-bit offsets and no nulls."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def pieces(column: pa.Array, most: int = MOST) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, last row + 1, bytes, offsets.

    A longer text is a run of its own.
    """
    column = text_array(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
