"""Weights of resamples for many keys at once: md5 in numpy, the numbers that estimate.poisson_weight() gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed values of MD5: shifts by round, additive constants, the start.
SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
CONSTANTS = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
#: Keys of a block: its arrays stay in a core's cache.
BLOCK = 8192


def md5_first(words: list, n: int) -> np.ndarray:
    """The first words of the digests of n padded messages, given as words, each an array or the number that all messages have there."""
    state = [np.full(n, v, dtype=np.uint32) for v in START]
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for block in range(0, len(words), 16):
        a, b, c, d = (v.copy() for v in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word = words[block + (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
            np.add(f, a, out=f)
            if isinstance(word, np.ndarray):
                np.add(f, word, out=f), np.add(f, np.uint32(CONSTANTS[i]), out=f)
            else:
                np.add(f, np.uint32((CONSTANTS[i] + word) % 2**32), out=f)
            s = SHIFTS[i // 16][i % 4]
            np.left_shift(f, np.uint32(s), out=g), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, g, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        for v, x in zip(state, (a, b, c, d)):
            v += x
    return state[0]


def _padded(rest: bytes, length: int, skip: int) -> list[int]:
    """The words of a message of some length from the byte ``skip`` (a multiple of 4) on, where ``rest`` begins, with MD5's padding."""
    whole = (length + 8) // 64 * 64 + 64
    tail = (rest + b"\x80").ljust(whole - skip - 8, b"\0") + (8 * length).to_bytes(8, "little")
    return np.frombuffer(tail, "<u4").tolist()


def poisson_weights(keys: list[str | None], resamples: int, seed: int = 7) -> Iterator[np.ndarray]:
    """For each resample from 1 on, how often it draws each key: Poisson(1) numbers, at most 8, of the md5 of "key#resample|seed" (of "resample|seed" for a missing key)."""
    prefixes = [b"" if k is None else k.encode() + b"#" for k in keys]
    lengths = np.array([len(p) for p in prefixes], dtype=np.int64)
    cuts, cdf, p = [], 0.0, float(np.exp(-1))
    for n in range(8):
        cdf += p
        cuts.append(np.uint32(min(np.ceil(cdf * 16**7), 2**32 - 1)))
        p /= n + 1
    parts = []  # keys of a length: (places, words that are theirs alone, what they have of the next word)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        for i in range(0, len(places), BLOCK):
            own = places[i : i + BLOCK]
            size = int(length) // 4 * 4 + 4
            table = np.frombuffer(b"".join(prefixes[j].ljust(size, b"\0") for j in own), "<u4").reshape(len(own), -1)
            parts.append((own, int(length), [np.ascontiguousarray(c) for c in table.T]))
    for b in range(1, resamples + 1):
        out = np.empty(len(keys))
        for own, length, table in parts:
            rest, full = f"{b}|{seed}".encode(), length // 4 * 4
            shared = _padded(b"\0" * (length - full) + rest, length + len(rest), full)
            words = [*table[:-1], table[-1] | np.uint32(shared[0]), *shared[1:]]
            number = md5_first(words, len(own)).byteswap() >> np.uint32(4)
            drawn = np.zeros(len(own), dtype=np.uint8)
            for cut in cuts:
                drawn += number >= cut
            out[own] = drawn
        yield out
