"""Token ids of whole texts by a public tokenizer file, with each distinct stretch of text encoded once.

The tokenizer splits a text before its merges: at white space, and wherever an ASCII letter, an ASCII digit and other
printable ASCII meet, but for apostrophes (contractions) and non-ASCII characters (any class).  A stretch
between such places has the same ids alone as in its text, so a text's ids are those of its stretches in a row.
Texts that hold "<|" (special tokens span classes) go to the tokenizer whole, and so do all texts where the file's own rules
(read from it) are not these.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from pathloom.llm.shingles import _BYTE, _powers, mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0 space, 1 letter, 2 digit, 3 other ASCII, 4 joins both sides (apostrophe, control characters, non-ASCII)
_KIND = np.full(256, 4, np.uint8)
for _b in range(33, 127):
    _KIND[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 3
_KIND[ord("'")] = 4
for _b in (32, 9, 10, 11, 12, 13):
    _KIND[_b] = 0
#: Stretches of a generation kept between batches, and the longest that is kept.
CACHE, LONG = 220_000, 64


def splits_so(path: str) -> bool:
    """Whether the file normalises by NFC, white space and lower case, and then splits at white space and between letters,
    digits and other characters: what makes stretches independent."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    norm = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])]
    pre = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    rule = pre[0].get("pattern", {}).get("Regex", "")
    special = [t["content"] for t in file.get("added_tokens", [])]
    classes = (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+")
    return norm == ["NFC", "Replace", "Lowercase"] and pre[0].get("type") == "Split" and all(c in rule for c in classes) and all(t.startswith("<|") for t in special)


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 and so on, length of them, one run after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length - begin, length)


class Known:
    """Ids of stretches by their 64-bit hashes (which tell stretches of a batch apart, too): some 20 bytes a stretch."""

    def __init__(self) -> None:
        self.keys, self.ids = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.begin, self.length = np.empty(0, np.uint32), np.empty(0, np.uint16)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are here, and which ones are."""
        k = np.searchsorted(self.keys, h)
        there = np.zeros(len(h), bool)
        inside = k < len(self.keys)
        there[inside] = self.keys[k[inside]] == h[inside]
        return k[there], there

    def add(self, h: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Ascending hashes that are not here."""
        at = np.searchsorted(self.keys, h)
        begin = len(self.ids) + np.cumsum(length) - length
        self.keys, self.begin, self.length = (np.insert(x, at, y.astype(x.dtype)) for x, y in ((self.keys, h), (self.begin, begin), (self.length, length)))
        self.ids = np.concatenate((self.ids, ids))


def stretch_hashes(a: np.ndarray, kind: np.ndarray, starts: np.ndarray, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of bytes of each stretch; so many bytes at once, since each takes some 60 on its way."""
    ends = np.append(starts[1:], len(a))
    hashes, counts, i = [], [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        inside = np.flatnonzero(kind[lo:hi])
        first = np.searchsorted(inside, starts[i:j] - lo)
        n = np.diff(np.append(first, len(inside)))
        within = np.arange(len(inside)) - np.repeat(first, n)
        hashes.append(mix(np.add.reduceat(_BYTE[a[lo:hi][inside]] * _powers(int(n.max()))[within], first) + n.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
        counts.append(n)
        i = j
    return np.concatenate(hashes), np.concatenate(counts)


class Encoder:
    """encode(texts) gives all ids in one array and the bounds of each text's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        marks = [(i, t.content) for i, t in sorted(self.tok.get_added_tokens_decoder().items()) if t.content.startswith("<|") and not t.normalized]
        self.splits = splits_so(path) and bool(marks)
        self.mark = marks[0] if marks else None  # a special token, which no stretch holds, parts stretches in one call
        # When a generation is full, the one before it goes; what was used in the meantime has moved on, so that frequent
        # stretches stay and the many rare ones leave.
        self.known, self.before = Known(), Known()

    def _plain(self, texts: list[str], step: int = 2000) -> list[bytes]:
        return [array("I", e.ids).tobytes() for i in range(0, len(texts), step) for e in self.tok.encode_batch_fast(texts[i : i + step], add_special_tokens=False)]

    def _short(self, stretches: list[str], step: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches in a row and the number of each one's, many to a call: the tokenizer cuts a text at special
        tokens before all else."""
        number, mark = self.mark
        flat, length = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(stretches), step):
            ids = np.array(self.tok.encode_batch_fast([mark.join(stretches[i : i + step])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.concatenate(([-1], np.flatnonzero(ids == number), [len(ids)]))
            flat.append(ids[ids != number])
            length.append(np.diff(cut) - 1)
        return np.concatenate(flat), np.concatenate(length)

    def _ids(self, h: np.ndarray, n: np.ndarray, stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, length) for distinct stretches by ascending hashes h and lengths n in bytes; stretches(i) gives some as text."""
        known, before = self.known, self.before
        begin, length = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        k, there = known.find(h)
        begin[there], length[there] = known.begin[k], known.length[k]
        rest = np.flatnonzero(~there)
        k, there = before.find(h[rest])
        moved, todo = rest[there], rest[~there]
        begin[moved], length[moved] = before.begin[k], before.length[k]
        begin[moved] += len(known.ids)
        new, length[todo] = self._short(stretches(todo))
        begin[todo] = len(known.ids) + len(before.ids) + np.cumsum(length[todo]) - length[todo]
        ids = np.concatenate((known.ids, before.ids, new))
        keep = np.sort(np.concatenate((moved, todo[n[todo] <= LONG])))
        if len(keep):
            known.add(h[keep], ids[ragged(begin[keep], length[keep])], length[keep])
        if len(known.keys) > CACHE:
            self.before, self.known = known, Known()
        return ids, begin, length

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        special = [i for i, t in enumerate(texts) if t and (not self.splits or "<|" in t)]
        whole = {i: np.frombuffer(ids, np.uint32) for i, ids in zip(special, self._plain([texts[i] for i in special]))} if special else {}
        raws = [b"" if not t or i in whole else t.encode("utf-8", "surrogatepass").translate(_LOWER) for i, t in enumerate(texts)]
        joined = b" ".join(raws) + b" "
        a = np.frombuffer(joined, np.uint8)
        kind = _KIND[a]
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        starts = np.flatnonzero((kind > 0) & ((before == 0) | ((kind != before) & (kind < 4) & (before < 4))))
        if len(starts):
            h, n = stretch_hashes(a, kind, starts)
            h, at, unit = np.unique(h, return_index=True, return_inverse=True)
            s, k = starts[at], n[at]
            cut = lambda i: [joined[x : x + y].decode("utf-8", "surrogatepass") for x, y in zip(s[i].tolist(), k[i].tolist())]
            flat, begin, length = self._ids(h, k, cut)
            per = length[unit]
            ends = np.cumsum(per)
            out = flat[ragged(begin[unit], per)]
            doc = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
            bounds = np.concatenate(([0], ends))[doc]
        else:
            out, bounds = np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if whole:
            parts = [whole.get(i, out[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            bounds = np.cumsum([0] + [len(p) for p in parts])
            out = np.concatenate(parts)
        return out.astype(np.uint32), bounds


def pieces_of(text: str, most: int = 1 << 20) -> list[str]:
    """A long text in parts that end at a space or line end, so that their ids in a row are the text's."""
    out, at = [], 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if cut <= at:
            nearest = [c for c in (text.find(" ", at + most), text.find("\n", at + most)) if c >= 0]
            if not nearest:
                break
            cut = min(nearest)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def ids_of_long(e: Encoder, text: str) -> np.ndarray:
    if "<|" in text or not e.splits:
        return e.encode([text])[0]
    return np.concatenate([e.encode([p])[0] for p in pieces_of(text)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
