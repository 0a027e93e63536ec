"""64-bit hashes of the words of whole texts, computed for many texts at once over their UTF-8 bytes.

A word's hash is a polynomial in its bytes modulo 2 ** 64, from running sums over the buffer, with mixed bits; so time and
memory follow the bytes, whatever the number of distinct words.

Defined cases: a null or empty text, or one of separators alone, has no words; texts of any length are hashed whole, in slices that
end between words; lone surrogates are hashed as they are encoded; words of one text are in order, repeated ones each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Bytes that are hashed at a time; texts above it are taken alone, in slices.
CHUNK = 1 << 20
_P = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2 ** 64
_U = np.uint64

#: White space between words: 0x20 and 0x09-0x0D (fixed by the contracts).
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: White space and ASCII marks.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit of h over all bits of the result, one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


class Words:
    """Cuts and hashes words: runs of bytes outside `separators`, A-Z in lower case unless `fold` is off."""

    def __init__(self, separators: bytes = SPACES, fold: bool = True):
        self._lower = np.arange(1, 257, dtype=np.uint64)
        self._lower[ord("A") : ord("Z") + 1] += 32 * fold
        self._inside = np.ones(256, dtype=bool)
        self._inside[list(separators)] = False
        self._powers = _powers(_P, 4096)
        self._inverse = _powers(pow(_P, -1, 1 << 64), 4096)

    def _grow(self, n: int) -> None:
        if n > len(self._powers):
            self._powers, self._inverse = _powers(_P, 2 * n), _powers(pow(_P, -1, 1 << 64), 2 * n)

    def _hash(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of a buffer."""
        return self.located(data)[:2]

    def located(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of the words of a buffer."""
        inside = self._inside[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.uint64), starts, ends
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self._lower[data] * self._powers[: len(data)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self._inverse[starts]
            h += (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
        return mix(h), starts, ends

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The hashes of the words of each text, in order; none for a null or empty text."""
        out: list[np.ndarray] = []
        batch: list[bytes] = []
        size = 0
        for t in texts:
            b = t.encode("utf-8", "surrogatepass") if t else b""
            if size + len(b) > CHUNK and batch:
                out += self._batch(batch)
                batch, size = [], 0
            batch.append(b)
            size += len(b) + 1
        return out + self._batch(batch) if batch else out

    def _batch(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > 2 * CHUNK:
            return [self._long(texts[0])]
        h, starts = self._hash(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
        ends = np.cumsum([len(b) + 1 for b in texts])
        return np.split(h, np.searchsorted(starts, ends[:-1]))

    def _long(self, text: bytes) -> np.ndarray:
        """One very long text, in slices that end between words."""
        data = np.frombuffer(text, np.uint8)
        parts, at = [], 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            while end < len(data) and self._inside[data[end]]:  # to the end of the word that is cut
                step = np.flatnonzero(~self._inside[data[end : end + 4096]])
                end += int(step[0]) if len(step) else min(4096, len(data) - end)
            parts.append(self._hash(data[at:end])[0])
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * _U(step)
            done += more
            step = step * step % (1 << 64)
    return out


_ODD = [_U(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(16)]


def grams(words: np.ndarray, n: int, gap: int = 0) -> np.ndarray:
    """Hashes of the runs of n words; with gap > 0, of the pairs (n = 2) of words with so many words between."""
    reach = n + gap - 1
    count = len(words) - reach
    if count <= 0:
        return np.empty(0, np.uint64)
    steps = [0, gap + 1] if gap else range(n)
    with np.errstate(over="ignore"):
        h = np.full(count, 0x632BE59BD9B4E019 * (n + 16 * gap) % (1 << 64), np.uint64)
        for j, at in enumerate(steps):
            h += words[at : at + count] * _ODD[j]
    return mix(h)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct runs of n words, sorted; fewer words make one shingle of them all, none make none."""
    if not len(words):
        return words
    return np.unique(grams(words, min(n, len(words))))


def batches(frames: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The frames in smaller ones, which bounds what a task holds beside its input."""
    for pdf in frames:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]
