"""SHA-256 whose state can be stored and taken up again by another process.

hashlib keeps its state to itself. Blocks are compressed by the OpenSSL library that Python's own
hashlib is built on; where that can't be loaded, by plain Python, which is a few hundred times
slower and gives the same. A state holds eight words, the length so far, and the bytes that don't fill a block.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
from functools import cache
from math import isqrt

BLOCK = 64
MASK = 0xFFFFFFFF


def _primes(n: int) -> list[int]:
    found: list[int] = []
    number = 2
    while len(found) < n:
        if all(number % p for p in found):
            found.append(number)
        number += 1
    return found


def _cube_root(number: int) -> int:
    low, high = 0, 1 << (number.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= number else (low, middle - 1)
    return low


#: The standard's constants: fractions of the roots of the first primes.
START = tuple(isqrt(p << 64) & MASK for p in _primes(8))
ROUNDS = tuple(_cube_root(p << 96) & MASK for p in _primes(64))


def _turned(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & MASK


def _compress_plainly(words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
    for at in range(0, len(data), BLOCK):
        w = list(struct.unpack_from(">16I", data, at))
        for i in range(16, 64):
            x, y = w[i - 15], w[i - 2]
            w.append((w[i - 16] + w[i - 7] + (_turned(x, 7) ^ _turned(x, 18) ^ x >> 3) + (_turned(y, 17) ^ _turned(y, 19) ^ y >> 10)) & MASK)
        a, b, c, d, e, f, g, h = words
        for k, x in zip(ROUNDS, w, strict=True):
            one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (e & f ^ ~e & g) + k + x
            two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = (one + two) & MASK, a, b, c, (d + one) & MASK, e, f, g
        words = tuple((x + y) & MASK for x, y in zip(words, (a, b, c, d, e, f, g, h), strict=True))
    return words


@cache
def _library() -> ctypes.CDLL | None:
    """OpenSSL's library, if its SHA-256 gives the state that plain Python gives."""
    for name in ("libcrypto.so.3", "libcrypto.so.1.1", ctypes.util.find_library("crypto")):
        try:
            found = ctypes.CDLL(name) if name else None
        except OSError:
            continue
        if found is not None and hasattr(found, "SHA256_Update"):
            found.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
            if _compress_by(found, START, bytes(range(BLOCK))) == _compress_plainly(START, bytes(range(BLOCK))):
                return found
    return None


def _compress_by(library: ctypes.CDLL, words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
    """By SHA256_Update on a context of eight words, two of length, a block, and the numbers of its bytes and of the digest's."""
    context = (ctypes.c_uint32 * 28)(*words, *[0] * 19, 32)
    library.SHA256_Update(context, data, len(data))
    return tuple(context[:8])


class Sha256:
    """A digest in the making."""

    def __init__(self, state: bytes | None = None, plain: bool = False):
        """state: what state() gave; None: nothing hashed yet. plain: without the library."""
        self.library = None if plain else _library()
        if state is None:
            self.words, self.length, self.tail = START, 0, b""
        else:
            *words, self.length = struct.unpack_from(">8IQ", state)
            self.words, self.tail = tuple(words), state[40:]

    def update(self, data: bytes) -> None:
        self.length += len(data)
        if len(self.tail) + len(data) < BLOCK:
            self.tail += data
            return
        data = self.tail + data
        whole = len(data) - len(data) % BLOCK
        self.tail = data[whole:]
        self._compress(data[:whole])

    def _compress(self, data: bytes) -> None:
        self.words = _compress_by(self.library, self.words, data) if self.library else _compress_plainly(self.words, data)

    def state(self) -> bytes:
        return struct.pack(">8IQ", *self.words, self.length) + self.tail

    def hexdigest(self) -> str:
        """Of all so far; more may follow."""
        end = Sha256(self.state(), plain=self.library is None)
        end._compress(self.tail + b"\x80" + bytes((55 - self.length) % BLOCK) + struct.pack(">Q", 8 * self.length))
        return struct.pack(">8I", *end.words).hex()
