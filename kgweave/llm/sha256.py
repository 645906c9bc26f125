"""SHA-256 over many messages at once, with states that can be kept, copied and resumed.

A state is the eight words after a whole number of 64-byte blocks, so it fits a column of 32 bytes. All functions
work on numpy arrays with one lane for each message. Constants follow FIPS 180-4: the fractional parts of the
square and cube roots of the first primes, computed here in integers.
"""

from __future__ import annotations

import math

import numpy as np

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]


def _cube_root(n: int) -> int:
    x = 1 << -(-n.bit_length() // 3)
    while (y := (2 * x + n // (x * x)) // 3) < x:
        x = y
    return x


START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES], np.uint32)
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint16)
#: Lanes worked on together: a word of all of them stays in the cache.
LANES = 4096


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _lanes(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    w = [np.ascontiguousarray(words[:, i]) for i in range(16)]
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + w[i - 7] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    own = [np.ascontiguousarray(state[:, i]) for i in range(8)]
    a, b, c, d, e, f, g, h = own
    for k, x in zip(_ROUND, w):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + k + x
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return np.stack([x + y for x, y in zip(own, (a, b, c, d, e, f, g, h))], 1)


def absorb(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states ``(n, 8)`` after one more block of sixteen words each ``(n, 16)``."""
    return np.concatenate([_lanes(state[i : i + LANES], words[i : i + LANES]) for i in range(0, len(state), LANES)]) if len(state) else state


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests ``(n, 32)`` of bytes as text in lower-case hex: a block of sixteen words each."""
    return _HEX[digests].view(np.uint8).reshape(-1, 64).view(">u4").astype(np.uint32)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests ``(n, 32)`` of messages of so many whole blocks, given their states."""
    pad = np.zeros((len(state), 16), np.uint32)
    pad[:, 0] = 0x80000000
    pad[:, 15] = np.asarray(blocks, np.uint32) * np.uint32(512)
    return to_bytes(absorb(state, pad))


def to_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.astype(">u4")).view(np.uint8).reshape(-1, 32)


def from_bytes(raw: np.ndarray) -> np.ndarray:
    """States ``(n, 8)`` from ``(n, 32)`` bytes."""
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).reshape(-1, 8)


def start(n: int) -> np.ndarray:
    return np.tile(START, (n, 1))


def hex_bytes(digests: np.ndarray) -> bytes:
    """All digests as hex text, 64 bytes each."""
    return _HEX[digests].tobytes()


def hex_strings(digests: np.ndarray) -> list[str]:
    raw = hex_bytes(digests).decode()
    return [raw[i : i + 64] for i in range(0, len(raw), 64)]
