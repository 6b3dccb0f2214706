"""Hashing the words of many texts at once, with numpy over their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as a run
of such characters. It stands as two independent 64-bit lanes, each by tabulation: the sum
of one random number for every (place, byte) of the word, mixed with its length, so two
different words agree in a lane with a chance of 2**-64 whatever they have in common; words
of more than ``PLACES`` bytes are hashed by BLAKE2b, one by one. A window's hash combines its
words' hashes pairwise, level by level, with a non-linear mix after each step, so no
arithmetic relation between words carries over to windows. Lanes stay apart: two different
windows agree in both with a chance of about 2**-128.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype="uint8")
LOWER[65:91] += 32
#: bytes of a word that have numbers of their own
PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, in place on a copy."""
    x = x + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def _numbers(lane: int) -> np.ndarray:
    """A lane's random numbers, by place * 256 + byte."""
    return np.random.default_rng([20, lane]).integers(0, 2**64, PLACES * 256, "uint64")


def _lanes(texts: list[bytes], lower: bool, lanes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", "uint8")
    if lower:
        raw = LOWER[raw]
    space = SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    place = np.zeros(len(raw), "int32")
    place[starts] = starts
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(raw), dtype="int32"), place, out=place)
    np.minimum(place, PLACES - 1, out=place)
    place <<= 8
    place |= raw
    lengths, out = ends - starts, []
    long = np.flatnonzero(lengths > PLACES).tolist()
    digests = [hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=16).digest() for k in long]
    for lane in lanes:
        value = _numbers(lane)[place]
        first = value[starts]
        sums = np.cumsum(value, out=value)
        h = mix((sums[ends - 1] - sums[starts] + first) ^ (lengths.astype("uint64") * _GOLDEN))
        if long:
            h[long] = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)[:, lane]
        out.append(h)
    sizes = np.fromiter(map(len, texts), "int64", len(texts)) + 1
    return out, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def word_lanes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both lanes of all words, one text after another, and where each text's words begin (one more entry than texts)."""
    (a, b), at = _lanes(texts, lower, (0, 1))
    return a, b, at


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As word_lanes, the first lane alone."""
    (a,), at = _lanes(texts, lower, (0,))
    return a, at


def grouped(texts: list[bytes], most: int = 400_000):
    """Ranges of ``texts`` of about ``most`` bytes: small enough for the processor's caches."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t) + 1
        if held >= most:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def all_word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, for any amount of text, with bounded scratch memory."""
    hashes, offsets, total = [], [np.zeros(1, "int64")], 0
    for lo, hi in grouped(texts):
        h, o = word_hashes(texts[lo:hi], lower)
        hashes.append(h)
        offsets.append(o[1:] + total)
        total += len(h)
    return np.concatenate(hashes) if hashes else np.empty(0, "uint64"), np.concatenate(offsets)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of sequences ``a`` followed by sequences ``b``."""
    return mix(a * _LEFT + b * _RIGHT)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive words, from one lane of the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, "uint64")
    power, span, whole, covered = words, 1, None, 0  # hashes of windows of ``span`` and ``covered`` words
    while True:
        if size & span:
            whole = power if whole is None else _joined(whole[:n], power[covered : covered + n])
            covered += span
        if covered == size:
            return mix(whole[:n])
        power = _joined(power[:-span], power[span:])
        span *= 2


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for integers far faster than numpy's unique, which hashes them."""
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
