"""Word shingle sets of texts as sorted arrays of 64-bit hashes (numpy, whole batches at a time).

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text after lower-casing A-Z.
A word's hash sums random 64-bit values of its bytes times powers of an odd base, modulo 2**64, and is
then mixed; a shingle's hash mixes a weighted sum of its word hashes.  Two different shingles of a pair
of texts get one hash with probability below n*m / 2**64 for n and m shingles.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_SEGMENT = 1 << 19
_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | _U(1)
_BASE = 0x5851F42D4C957F2D
del _rng


def _powers(n: int, have: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(have[0]) < n:
        p = np.full(1 << (n - 1).bit_length(), _BASE, np.uint64)
        p[0] = 1
        have[0] = np.multiply.accumulate(p)
    return have[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _hash_segment(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    inside = _IS_WORD[a]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    n = ends - starts
    at = np.flatnonzero(inside)
    within = at - np.repeat(starts, n)
    v = _BYTE[a[at]] * _powers(int(n.max()))[within]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    return mix(np.add.reduceat(v, first) + n.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def word_hashes(text: str) -> np.ndarray:
    """The hashes of a text's words in order.  Long texts are read in segments cut between words."""
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(raw) <= _SEGMENT:
        return _hash_segment(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _SEGMENT)
        while end < len(raw) and _IS_WORD[raw[end]]:
            end += 1
        out.append(_hash_segment(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The set of a text's shingles, sorted.  Fewer words than a shingle has: the whole sequence is one."""
    if not len(words):
        return words
    k = min(size, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h += words[i : len(words) - k + 1 + i] * _STEP[i]
    return np.unique(mix(h))


def sets(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """For each text its sorted set.  Short texts are hashed together: numpy's cost per call counts."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    batch: list[int] = []
    room = _SEGMENT

    def flush() -> None:
        nonlocal batch, room
        if batch:
            raws = [texts[i].encode("utf-8", "surrogatepass").translate(_LOWER) for i in batch]  # type: ignore[union-attr]
            joined = b" ".join(raws)
            a = np.frombuffer(joined, np.uint8)
            inside = _IS_WORD[a]
            begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
            words = _hash_segment(joined)
            bounds = np.searchsorted(begins, np.cumsum([0] + [len(r) + 1 for r in raws]))
            for j, i in enumerate(batch):
                out[i] = shingle_hashes(words[bounds[j] : bounds[j + 1]], size)
        batch, room = [], _SEGMENT

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > _SEGMENT // 8:
            out[i] = shingle_hashes(word_hashes(t), size)
            continue
        if len(t) > room:
            flush()
        batch.append(i)
        room -= len(t)
    flush()
    return out
