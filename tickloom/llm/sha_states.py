"""SHA-256 over many messages at once, with states that can be kept and taken up again.

A state is what the hash has after whole blocks of 64 bytes: eight words. Digests are
written into parents as 64 hexadecimal digits, one block each, so the state before any child
is eight words too.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: Fractions of the square and cube roots of the first primes, as the standard has them.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_FOUR = np.arange(1 << 16, dtype=np.uint32)
#: Four hexadecimal digits of every 16 bits, as a big-endian word.
_HEX = _DIGITS[_FOUR >> 12] << 24 | _DIGITS[_FOUR >> 8 & 15] << 16 | _DIGITS[_FOUR >> 4 & 15] << 8 | _DIGITS[_FOUR & 15]


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> by) | (x << (32 - by))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) each."""
    w = [block[i] for i in range(16)]
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> 3)) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> 10)))
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + w[i] + _ROUNDS[i]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def fresh(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The block (16, n) that 64 hexadecimal digits of each digest (8, n) fill."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2] = _HEX[digests >> 16]
    out[1::2] = _HEX[digests & 0xFFFF]
    return out


def close(state: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """Digests (8, n) of messages of so many whole blocks."""
    end = np.zeros((16, state.shape[1]), np.uint32)
    end[0] = 0x80000000
    bits = np.broadcast_to(np.asarray(blocks, np.uint64) * np.uint64(512), state.shape[1:])
    end[14], end[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(state, end)


def pack(words: np.ndarray) -> bytes:
    """(8, n) words as n times 32 bytes."""
    return words.T.astype(">u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").reshape(-1, 8).T.astype(np.uint32)
