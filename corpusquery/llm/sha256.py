"""SHA-256 over many messages at once, with states that can be kept and resumed.

Messages here are whole blocks of 64 bytes, such as digests written as hex
text, so a state is eight words and nothing else.
"""

from __future__ import annotations

import math

import numpy as np

# Messages that are worked on together; their words stay in the processor's cache.
LANES = 4096


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
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= x else (low, middle - 1)
    return low


# The standard's constants: fractions of the roots of the first primes.
_WORD = (1 << 32) - 1
INITIAL = np.array([math.isqrt(p << 64) & _WORD for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & _WORD for p in _primes(64)], np.uint32)

_HEX = np.array([[ord(c) for c in f"{b:02x}"] for b in range(256)], np.uint8)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _rounds(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        small = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
        large = _turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))
        w.append(w[t - 16] + small + w[t - 7] + large)
    a, b, c, d, e, f, g, h = state
    for k, word in zip(ROUND, w):
        picked = g ^ (e & (f ^ g))
        first = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + picked + (word + k)
        most = (a & b) | (c & (a | b))
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + most
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States ``(n, 8)`` after one more block ``(n, 16)`` of each message."""
    out = np.empty_like(states)
    for at in range(0, len(states), LANES):
        part = slice(at, at + LANES)
        out[part] = _rounds(np.ascontiguousarray(states[part].T), np.ascontiguousarray(blocks[part].T)).T
    return out


def start(n: int) -> np.ndarray:
    """The state before anything is hashed, for ``n`` messages."""
    return np.repeat(INITIAL[None, :], n, axis=0)


def finish(states: np.ndarray, n_blocks: np.ndarray | int) -> np.ndarray:
    """Digests ``(n, 8)`` of messages of so many whole blocks."""
    tail = np.zeros((len(states), 16), np.uint32)
    tail[:, 0] = 1 << 31
    bits = np.broadcast_to(np.asarray(n_blocks, np.uint64) * np.uint64(512), len(states))
    tail[:, 14], tail[:, 15] = bits >> np.uint64(32), bits & np.uint64(_WORD)
    return absorb(states, tail)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests as the blocks that their lower-case hex text fills."""
    octets = digests.astype(">u4").view(np.uint8).reshape(len(digests), 32)
    return _HEX[octets].reshape(len(digests), 64).view(">u4").astype(np.uint32)


def from_bytes(data: bytes | memoryview) -> np.ndarray:
    """Digests from their bytes, back to back."""
    return np.frombuffer(data, ">u4").astype(np.uint32).reshape(-1, 8)


def to_bytes(digests: np.ndarray) -> bytes:
    return digests.astype(">u4").tobytes()
