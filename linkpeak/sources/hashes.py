"""MD5 of many short texts at once: the draws of generators.py where each row meets a long list."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURN = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_PLACE = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_A, _B, _C, _D, _ALL = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xFFFFFFFF
_CONST, _LEFT, _RIGHT = ([np.array(x, dtype=np.uint32) for x in xs] for xs in (_K, _TURN, [32 - t for t in _TURN]))
#: A text of more bytes takes a second block of MD5; texts that are hashed at once; how many times those that are wanted go on to be compared in full.
MOST, AT_ONCE, SPARE = 55, 32768, 16


class Tails:
    """Texts that many others are continued by."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.many = texts, len(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        # Neighbours are of one length, so that most words of their blocks are one number.
        self.pieces = np.array_split(np.argsort(lengths, kind="stable"), -(-self.many // AT_ONCE)) if self.many else []
        self._blocks: dict[int, list[np.ndarray]] = {}
        self._kept: np.ndarray | None = None

    def draws(self, head: bytes) -> np.ndarray:
        """For each tail the first 52 bits of the MD5 of head and tail, as generators.draw() has them."""
        out = np.empty(self.many, dtype=np.uint64)
        for at, block in zip(self.pieces, self._placed(len(head)), strict=True):
            words = _words(_started([head]), block)
            high, low = ((_registers(words, len(at), steps, self._space(len(at))) + np.uint32(x)).byteswap() for steps, x in ((61, _A), (64, _B)))
            out[at] = (high.astype(np.uint64) << np.uint64(20)) | (low >> np.uint32(12)).astype(np.uint64)
        return out

    def firsts(self, heads: list[bytes], wanted: list[int]) -> list[list[tuple[int, int]]]:
        """For each head the wanted number of smallest draws() and their places, in order; of equal ones the first place.

        The last steps and the other registers are left out for all but some texts that start with zeros, of which there are
        enough nearly always; heads where there are not are looked at in full."""
        found: list[list[int]] = [[] for _ in heads]
        bits = int(math.log2(max(self.many // (SPARE * max(wanted, default=1)), 1)))
        zeros = np.uint32(int.from_bytes((_ALL << (32 - bits) & _ALL).to_bytes(4, "big"), "little"))
        by_length: dict[int, list[int]] = {}
        for i, head in enumerate(heads):
            by_length.setdefault(len(head), []).append(i)
        for length, same in by_length.items() if bits else ():
            for at, block in zip(self.pieces, self._placed(length), strict=True):
                step = max(1, AT_ONCE // len(at))
                for start in range(0, len(same), step):
                    some = same[start : start + step]
                    pairs = len(some) * len(at)
                    last = _registers(_words(_started([heads[i] for i in some]), block), pairs, 61, self._space(pairs))
                    last += np.uint32(_A)
                    last &= zeros
                    for hit in np.flatnonzero(last == 0).tolist():
                        found[some[hit // len(at)]].append(int(at[hit % len(at)]))
        out = []
        for head, n, near in zip(heads, wanted, found, strict=True):
            if len(near) < min(n, self.many):
                h = self.draws(head)
                near = np.argsort(h, kind="stable")[:n].tolist()
            out.append(sorted((int(hashlib.md5(head + self.texts[i], usedforsecurity=False).hexdigest()[:13], 16), i) for i in near)[:n])
        return out

    def _space(self, many: int) -> np.ndarray:
        """Rows to work in: new ones for each head would cost as much as the hashes."""
        if self._kept is None or self._kept.shape[1] < many:
            self._kept = np.empty((7, many), dtype=np.uint32)
        return self._kept

    def _placed(self, start: int) -> list[np.ndarray]:
        """By piece the blocks of 16 words of the tails, if these start there, with the end and the length of the texts."""
        if start not in self._blocks:
            if self.many and start + max(map(len, self.texts)) > MOST:
                raise ValueError(f"texts to draw by may have {MOST} bytes, not {start + max(map(len, self.texts))}")
            self._blocks[start] = []
            for at in self.pieces:
                raw = b"".join((bytes(start) + self.texts[i] + b"\x80").ljust(56, b"\0") + (8 * (start + len(self.texts[i]))).to_bytes(8, "little") for i in at)
                self._blocks[start].append(np.ascontiguousarray(np.frombuffer(raw, dtype="<u4").reshape(len(at), 16).T))
        return self._blocks[start]


def _started(heads: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(head.ljust(64, b"\0") for head in heads), dtype="<u4").reshape(len(heads), 16).T


def _words(heads: np.ndarray, tails: np.ndarray) -> list:
    """The 16 words of each head before each tail, one number where all have the same."""
    out = []
    for head, tail in zip(heads, tails, strict=True):
        if (head == head[0]).all() and (tail == tail[0]).all():
            out.append(int(head[0] | tail[0]))
        else:
            out.append((head[:, None] | tail[None, :]).ravel())
    return out


def _registers(words: list, many: int, steps: int, space: np.ndarray) -> np.ndarray:
    """The register that is written last, after some steps of MD5. space: seven rows to work in."""
    a, b, c, d, first = _A, _B, _C, _D, 0
    # What comes before the first words that differ is found once for all.
    while isinstance(words[first], int) and first < 15:
        x = ((d ^ (b & (c ^ d))) + a + _K[first] + words[first]) & _ALL
        a, b, c, d, first = d, ((x << _TURN[first] | x >> (32 - _TURN[first])) + b) & _ALL, b, c, first + 1
    f, g, both = space[4:, :many]
    for row, x in zip(space, (a, b, c, d), strict=False):
        row[:many] = x
    a, b, c, d = space[:4, :many]
    for i in range(first, steps):
        if i < 32:
            # x picks y or z, bit by bit.
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif i < 48:
            # Two of the three are those of the next step.
            if i % 2 == 0:
                np.bitwise_xor(b, c, out=both)
                np.bitwise_xor(both, d, out=f)
            else:
                np.bitwise_xor(b, both, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[_PLACE[i]]
        if isinstance(word, int):
            np.add(f, np.array((_K[i] + word) & _ALL, dtype=np.uint32), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, _CONST[i], out=f)
        np.left_shift(f, _LEFT[i], out=g)
        np.right_shift(f, _RIGHT[i], out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        # The oldest array is written over in the next step.
        a, b, c, d, f = d, f, b, c, a
    return b
