"""Immutable fingerprint filters over 64-bit keys, built by peeling a random 3-uniform hypergraph.

A sealed set of n distinct keys takes about 1.23 n slots of 16 bits. A key of the set
is always found; another key is found with probability 2**-16. All steps are numpy passes over
whole arrays: peeling removes every slot of degree one in a round, and within a
round no chosen slot touches another chosen key, so the assignment runs backwards
round by round without a loop over keys.
"""

from __future__ import annotations

import numpy as np

FINGERPRINT_BITS = 16
SLOTS_PER_KEY = 1.23
SPARE_SLOTS = 36
MAX_SEEDS = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over keys and seed; wraps around as uint64 does."""
    x = keys.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _places(keys: np.ndarray, seed: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots, one in each block, and the fingerprint of every key."""
    h = mix(keys, seed)
    places = np.empty((3, len(keys)), dtype=np.int64)
    for i, part in enumerate((h, mix(h, 101), mix(h, 202))):
        places[i] = ((part >> np.uint64(32)) * np.uint64(block) >> np.uint64(32)).astype(np.int64) + i * block
    return places, (h & np.uint64(0xFFFF)).astype(np.uint16)


def _peel(places: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(keys, their slots) round by round, or None if a core stays that can't be peeled."""
    n = places.shape[1]
    degree = np.bincount(places.ravel(), minlength=slots)
    owner = np.bincount(places.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=slots)
    rounds, left, look = [], n, np.flatnonzero(degree == 1)
    while len(look):
        keys, first = np.unique(owner[look].astype(np.int64), return_index=True)
        rounds.append((keys, look[first]))
        left -= len(keys)
        touched = places[:, keys].ravel()
        np.subtract.at(degree, touched, 1)
        np.subtract.at(owner, touched, np.tile(keys.astype(np.float64), 3))
        touched = np.unique(touched)
        look = touched[degree[touched] == 1]
    return rounds if left == 0 else None


class FingerprintFilter:
    """One sealed generation. ``keys`` must be distinct; an empty set finds nothing."""

    def __init__(self, seed: int, block: int, prints: np.ndarray):
        self.seed, self.block, self.prints = seed, block, prints

    @classmethod
    def build(cls, keys: np.ndarray) -> FingerprintFilter:
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        if not len(keys):
            return cls(0, 0, np.zeros(0, dtype=np.uint16))
        block = int(np.ceil(SLOTS_PER_KEY * len(keys) + SPARE_SLOTS)) // 3 + 1
        for seed in range(MAX_SEEDS):
            places, marks = _places(keys, seed, block)
            rounds = _peel(places, 3 * block)
            if rounds is not None:
                break
        else:
            raise ValueError("keys repeat: no seed gives a peelable graph")
        prints = np.zeros(3 * block, dtype=np.uint16)
        for who, slot in reversed(rounds):
            at = places[:, who]
            prints[slot] = marks[who] ^ prints[at[0]] ^ prints[at[1]] ^ prints[at[2]]
        return cls(seed, block, prints)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        if not self.block or not len(keys):
            return np.zeros(len(keys), dtype=bool)
        at, marks = _places(keys, self.seed, self.block)
        return (self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]]) == marks

    def to_bytes(self) -> bytes:
        return self.prints.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, seed: int, block: int, raw: bytes) -> FingerprintFilter:
        return cls(seed, block, np.frombuffer(raw, dtype="<u2").astype(np.uint16))


def wrong_rate(generations: int, bits: int = FINGERPRINT_BITS) -> float:
    """Chance that a new key is taken for an old one after probing so many generations."""
    return 1.0 - (1.0 - 2.0**-bits) ** generations
