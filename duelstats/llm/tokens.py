"""Small helpers for text in Arrow functions: bounded per-worker tables of token hashes."""

from __future__ import annotations

import numpy as np
import xxhash

REMEMBERED = 300_000


class Hashes(dict):
    """Token to 64-bit hash, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[token] = xxhash.xxh64_intdigest(token)
        return made


def hashed(tokens: list[str], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of MurmurHash3; its constants are fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
