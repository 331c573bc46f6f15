"""Secrets: a keyword automaton finds where to look, anchored patterns match only there, checksums decide.

Base spans follow fixed rules per kind: assignments of long values to telling names, access key ids, long hexadecimal
runs.  The method adds tokens whose format carries its own check: platform tokens that end in the base-62
CRC-32 of their body, three-part signed tokens whose header decodes, and private keys whose body is a well-formed DER sequence.

Of all kinds only hexadecimal runs have no keyword: the base rule names none, and every 16 characters of the class are one.
They are found by a single pass of their own.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import column
from pathloom.llm.minhash import _chunks

KINDS = ("assign", "access", "hex", "token", "signed", "key")
BASE = KINDS[:3]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Keyword (lower case) and the kind it may begin.
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "token", "gho_": "token", "ghu_": "token", "ghs_": "token", "ghr_": "token", "npm_": "token",
    "eyj": "signed", "-----begin ": "key",
}
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
#: A signed token starts where its run of characters does: one attempt a run.
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}")
_KEY = re.compile(r"-----BEGIN ((?:[A-Z]+ ){0,3}PRIVATE KEY)-----([A-Za-z0-9+/=\s]{32,}+)-----END \1-----")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(width, "0")


def valid(kind: str, m: re.Match) -> bool:
    """Whether the checksum or structure that the format carries holds.  What cannot be decoded, however long or deeply nested, does not."""
    x = m[0]
    if kind == "token":
        return x[-6:] == base62(zlib.crc32(x[4:-6].encode()))
    try:
        if kind == "signed":
            head = x.partition(".")[0]
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        der = base64.b64decode("".join(m[2].split()), validate=True)
    except (ValueError, binascii.Error, TypeError, RecursionError):
        return False
    if len(der) < 8 or der[0] != 0x30:
        return False
    n = der[1] if der[1] < 128 else int.from_bytes(der[2 : 2 + der[1] - 128], "big")
    return n + 2 + (der[1] - 128 if der[1] >= 128 else 0) == len(der)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


_found = _automaton()


def spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans by start, then kind as listed; code points.  Per kind the leftmost, without overlaps."""
    low = t.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    out, last = [], dict.fromkeys(KINDS, 0)
    for s, kind in sorted((end + 1 - n, kind) for end, (n, kind) in _found.iter(low)):
        if s < last[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(t, s):
                last[kind] = m.end()
                if m.end(1) - m.start(1) >= 12:
                    out.append((kind, s, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(t, s):
                last[kind] = m.end()
                if m.end() - s >= 18:
                    out.append((kind, s, m.end()))
        elif m := {"token": _TOKEN, "signed": _SIGNED, "key": _KEY}[kind].match(t, s):
            if valid(kind, m):
                last[kind] = m.end()
                out.append((kind, s, m.end()))
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(t)]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = lambda found: ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    for whole in batches:
        for b in _chunks(whole, 1 << 23):
            out = []
            for t in b.column(1).to_pylist():
                every = spans(t) if t else []
                base = [x for x in every if x[0] in BASE]
                n = [sum(k == x[0] for x in base) for k in BASE]
                out.append((*n, hashlib.sha256(text(base).encode()).hexdigest(), text(every)))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, base counts by kind, digest of the base spans, all spans.

    Null and empty texts have no spans; texts of any length are read whole, patterns in time linear in them.  Repeated rows and
    rows that share an id are each scanned for themselves, and a null id is returned as it is.  An empty table gives no
    rows.  Other columns, whatever their names, are neither read nor returned.
    """
    base = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(_finder, f"id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string").withColumnRenamed("id", id_col)
