"""Uniform draws from md5 digests, of whole columns at once: many keys against one ending."""

from __future__ import annotations

import math

import numpy as np

# Fixed values of RFC 1321: start of the state, additions, shifts and the word that each step reads.
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_READ = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *(7 * k % 16 for k in range(16))]


class Keys:
    """``n`` keys of ``length`` bytes each, one after the other in ``data``, as columns of 32-bit words."""

    def __init__(self, data: bytes, n: int, length: int):
        self.n, self.length = n, length
        padded = np.zeros((n, length + -length % 4), np.uint8)
        padded[:, :length] = np.frombuffer(data, np.uint8).reshape(n, length)
        self.words = list(np.ascontiguousarray(padded.view("<u4").T))

    def md5(self, ending: bytes) -> list[np.ndarray]:
        """The four words of the digest of each key followed by ``ending``. What all keys share stays a number."""
        odd, size = self.length % 4, self.length + len(ending)
        shared = bytes(odd) + ending + b"\x80" + bytes(-(size + 9) % 64) + (8 * size).to_bytes(8, "little")
        words = [int(x) for x in np.frombuffer(shared, "<u4")]
        words = [*self.words[:-1], self.words[-1] | np.uint32(words[0]), *words[1:]] if odd else [*self.words, *words]
        state = [np.full(self.n, x, np.uint32) for x in _STATE]
        for first in range(0, len(words), 16):
            a, b, c, d = state
            for k in range(64):
                if k < 16:
                    mixed = c ^ d
                    mixed &= b
                    mixed ^= d
                elif k < 32:
                    mixed = b ^ c
                    mixed &= d
                    mixed ^= c
                elif k < 48:
                    mixed = b ^ c
                    mixed ^= d
                else:
                    mixed = ~d
                    mixed |= b
                    mixed ^= c
                word = words[first + _READ[k]]
                mixed += a
                if isinstance(word, int):
                    mixed += (word + _ADDED[k]) & 0xFFFFFFFF
                else:
                    mixed += word
                    mixed += _ADDED[k]
                high = mixed >> (32 - _SHIFTS[k])
                mixed <<= _SHIFTS[k]
                mixed |= high
                mixed += b
                a, b, c, d = d, mixed, b, c
            state = [x + y for x, y in zip(state, (a, b, c, d))]
        return state

    def uniform(self, ending: bytes) -> np.ndarray:
        """Numbers above 0 and below 1 from the first 13 hexadecimal digits of the digests."""
        first, second, *_ = self.md5(ending)
        return (first.byteswap() * float(1 << 20) + (second.byteswap() >> 12) + 0.5) / float(1 << 52)
