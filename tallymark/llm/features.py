"""Hashed word and character n-grams of whole texts, many at a time in numpy.

Features of a text: words, pairs of words next to each other, and runs of three
and four bytes, each hashed to a bucket.  Words are separated by white space;
case is kept.  Texts past ``PIECE_BYTES`` go through in pieces that are cut at
white space, so memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

PIECE_BYTES = 1 << 18
GROUP_BYTES = 1 << 18
CHAR_ORDERS = (3, 4)

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _powers(n: int = 2 * (PIECE_BYTES + GROUP_BYTES) + 1) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's step and of its inverse, modulo 2**64; made where texts are hashed, never on the driver."""
    up, down = np.full(n, _STEP), np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Bucket of each hash; features of different kinds are hashed apart."""
    h = (h ^ (h >> np.uint64(29))) * _PRIME + np.uint64(kind * 0x2545F4914F6CDD1D % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * _PRIME
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def pieces(texts: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(index, piece) of every text; only long ones have several."""
    for i, text in enumerate(texts):
        start = 0
        while len(text) - start > PIECE_BYTES:
            cut = max(text.rfind(b" ", start + 1, start + PIECE_BYTES), text.rfind(b"\n", start + 1, start + PIECE_BYTES))
            cut = cut if cut > 0 else start + PIECE_BYTES
            yield i, text[start:cut]
            start = cut
        yield i, text[start:]


def groups(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Pieces in groups of about ``GROUP_BYTES``, with the index of each piece's text."""
    owner: list[int] = []
    group: list[bytes] = []
    size = 0
    for i, piece in pieces(texts):
        if group and size + len(piece) > GROUP_BYTES:
            yield np.array(owner), group
            owner, group, size = [], [], 0
        owner.append(i)
        group.append(piece)
        size += len(piece)
    if group:
        yield np.array(owner), group


def buckets(group: list[bytes], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: (index of the piece, bucket) of every occurrence."""
    raw = np.frombuffer(b"\n".join([*group, b""]), np.uint8)
    lengths = np.array([len(p) + 1 for p in group])
    piece = np.repeat(np.arange(len(group), dtype=np.int32), lengths)
    wide = raw.astype(np.uint64) + np.uint64(1)
    for kind, n in enumerate(CHAR_ORDERS):
        if len(raw) <= n:
            continue
        h = wide[: len(raw) - n].copy()
        for k in range(1, n):
            h = h * _STEP + wide[k : len(raw) - n + k]
        # a run must end before the line end that parts its piece from the next
        whole = piece[: len(raw) - n] == piece[n:]
        yield piece[: len(raw) - n][whole], _mixed(h[whole], kind + 1, bits)
    blank = _SPACE[raw]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(first):
        return
    last = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
    up, down = _powers()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * up[: len(raw)], dtype=np.uint64)])
    words = (total[last + 1] - total[first]) * down[first]
    yield piece[first], _mixed(words, 11, bits)
    same = piece[first[:-1]] == piece[first[1:]]
    pairs = words[:-1] * _STEP + words[1:] * np.uint64(3)
    pairs[words[:-1] == words[1:]] = 0  # a word said twice is one feature, whatever the word
    yield piece[first[:-1]][same], _mixed(pairs[same], 12, bits)


def counted(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one whole text and how often each occurs."""
    total = np.zeros(1 << bits, np.int32) if len(text) > PIECE_BYTES else None
    found = []
    for _, group in groups([text]):
        found = [b for _, b in buckets(group, bits)]
        if total is not None:
            total += np.bincount(np.concatenate([np.zeros(0, np.int32), *found]), minlength=1 << bits).astype(np.int32)
    if total is not None:
        keys = np.flatnonzero(total)
        return keys.astype(np.int32), total[keys]
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *found]), return_counts=True)
    return keys.astype(np.int32), counts.astype(np.int32)


def mean_weights(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean weight over every text's features; a text without features has 0."""
    bits = len(weights).bit_length() - 1
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
    for owner, group in groups(texts):
        for piece, bucket in buckets(group, bits):
            sums += np.bincount(owner[piece], weights[bucket], len(texts))[: len(texts)]
            counts += np.bincount(owner[piece], minlength=len(texts))
    return sums / np.maximum(counts, 1)
