"""Personal data: exact base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans follow fixed rules per kind.  The method labels the candidate tokens of a document (tokens with digits, '@' or
a word 'at'/'dot' form around it): node potentials come from a log-linear model of the token's shape and its neighbours, transition
potentials join each candidate to the next one, and both are trained here; tokens of one document with the same or similar key (the same digits, or the same local part) are joined by
skip edges of set strength whatever lies between them, and loopy max-product messages make their labels agree.  A candidate that ends with an entity label and
overlaps no base span of its kind is added as a span.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import column
from pathloom.llm.minhash import _chunks

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts at the first digit of a run: earlier starts in the run match whenever later ones do.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    """Found from each '@': what stands before it goes back to the start of its run or the end of the last match."""
    out, last, at = [], 0, t.find("@")
    while at >= 0:
        s = at
        while s > last and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            last = m.end()
        at = t.find("@", max(at + 1, last))
    return out


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points."""
    out = [("email", s, e) for s, e in _emails(t)] if "@" in t else []
    if not _DIGITS.search(t):
        return out
    for m in _IP.finditer(t):
        if all(len(p) <= 3 or not p[: len(p) - 3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- the random field

LABELS = ("none", *KINDS)
#: Candidates: a stretch of digits with separators, an address with '@', or one written out with "at" and "dot".
_CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)*|\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){5,24}"
)
_LENGTHS = (6, 9, 13, 16, 20)
#: Strength of a skip edge between equal and between similar keys, and the gain over "none" a span needs.
SAME, SIMILAR, GAIN = 8.0, 6.0, 0.0
#: Score of an observed label, the change below which messages rest, and rounds at most where loops keep them from resting.
SURE, REST, ROUNDS = 1e6, 1e-6, 1000


def features(t: str, s: int, e: int) -> list[str]:
    """What the node model sees of a candidate: its shape and the words beside it."""
    x = t[s:e]
    digits = sum("0" <= c <= "9" for c in x)
    dots = x.count(".")
    before = re.findall(r"[^\W\d_]+", t[max(0, s - 24) : s].lower())[-1:]
    return [
        "bias",
        f"digits{sum(digits >= k for k in _LENGTHS)}",
        f"dots{min(dots, 4)}",
        "plus" if x[0] == "+" else "noplus",
        "paren" if "(" in x else "noparen",
        "at" if "@" in x or "(at)" in x or "[at]" in x else "noat",
        "letters" if any(c.isalpha() for c in x) else "noletters",
        "luhn" if 13 <= digits <= 19 and luhn("".join(c for c in x if "0" <= c <= "9")) else "noluhn",
        "quads" if dots == 3 and all(p.isdigit() and int(p[:4]) <= 255 for p in x.split(".")) else "noquads",
        "before_" + before[0] if before and len(before[0]) > 2 else "before_",
    ]


def key_of(x: str) -> str:
    """Equal keys: the same entity written differently.  Zeros that lead to a country or into a network are no part of a number."""
    y = x.lower().replace("(at)", "@").replace("[at]", "@").replace("(dot)", ".").replace("[dot]", ".").replace(" ", "")
    return y if "@" in y else "".join(c for c in y if "0" <= c <= "9").lstrip("0")


Weights = dict[str, list[float]]


def fit(rows: list[tuple[list[str], int]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-3) -> Weights:
    """Multinomial logistic regression (averaged over gradient steps on all rows): features to labels.

    The labels of the neighbours are features too, with one weight for a pair of labels from either side: the pseudo-likelihood of
    a chain, whose transition potentials are the rows "after_...".
    """
    names = {f for fs, _ in rows for f in fs}
    sides = [[f"{side}_{k}" for k in LABELS] for side in ("after", "next")]
    tied = any(f in names for side in sides for f in side)
    names = sorted(names.union(*sides) if tied else names)
    at = {f: i for i, f in enumerate(names)}
    w = np.zeros((len(names), len(LABELS)))
    if not rows:
        return {}
    x = [np.array([at[f] for f in fs]) for fs, _ in rows]
    flat, owner = np.concatenate(x), np.repeat(np.arange(len(x)), [len(r) for r in x])
    y = np.array([k for _, k in rows])
    for _ in range(rounds * 10):
        z = np.zeros((len(x), len(LABELS)))
        np.add.at(z, owner, w[flat])
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        g = np.zeros_like(w)
        np.add.at(g, flat, z[owner])
        w -= rate * (g / max(1, len(x)) * len(LABELS) + decay * w)
        if tied:
            a, b = ([at[f] for f in side] for side in sides)
            w[a] = (w[a] + w[b].T) / 2
            w[b] = w[a].T
    return {f: w[i].tolist() for f, i in at.items()}


def messages(node: np.ndarray, edges: list[tuple[int, int, float]], steps: list[tuple[int, int]] | tuple = (), factor: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Max-product beliefs, when messages rest, of a field with node scores, edges that reward equal labels by their strength, and
    steps (from, to) with the scores `factor` of a pair of labels."""
    if not edges and not steps:
        return node
    pairs = [(a, b) for a, b, _ in edges] + list(steps)
    src = np.array([i for a, b in pairs for i in (a, b)])
    dst = np.array([i for a, b in pairs for i in (b, a)])
    force = np.repeat([s for *_, s in edges], 2)[:, None]
    back = np.arange(len(src)) ^ 1
    n = 2 * len(edges)
    m = np.zeros((len(src), node.shape[1]))
    for _ in range(rounds):
        belief = node.copy()
        np.add.at(belief, dst, m)
        out = belief[src] - m[back]
        new = np.empty_like(m)
        if n:
            new[:n] = np.maximum(out[:n] + force, out[:n].max(1, keepdims=True))
        if steps:
            for k in range(node.shape[1]):
                new[n::2, k] = (out[n::2] + factor[:, k]).max(1)
                new[n + 1 :: 2, k] = (out[n + 1 :: 2] + factor[k]).max(1)
        new -= new.max(1, keepdims=True)
        if np.abs(new - m).max() <= REST:
            break
        m = 0.5 * m + 0.5 * new
    belief = node.copy()
    np.add.at(belief, dst, m)
    return belief


@dataclass
class Field:
    """The random field of a text: candidates, which of them no base span covers, scores of all variables (hubs follow the
    candidates), edges that reward equal labels, and steps between neighbours with their scores."""

    found: list[tuple[int, int]]
    free: list[int]
    node: np.ndarray
    edges: list[tuple[int, int, float]]
    steps: list[tuple[int, int]]
    factor: np.ndarray


def field_of(t: str, base: list[tuple[str, int, int]], model: Weights) -> Field | None:
    """The field of a text, None where nothing is to be decided.  Candidates that a base span covers are observed with its label."""
    if not model or not (_DIGITS.search(t) or "@" in t or "(at)" in t or "[at]" in t):
        return None
    found = [(m.start(), m.end()) for m in _CANDIDATE.finditer(t)]
    if not found:
        return None
    node = np.array([np.sum([model.get(f, [0.0] * len(LABELS)) for f in features(t, s, e)], axis=0) for s, e in found])
    free, seen = [], {}
    by_start = sorted((a, b, k) for k, a, b in base)
    reach = np.maximum.accumulate([b for _, b, _ in by_start]) if by_start else np.empty(0)
    for i, (s, e) in enumerate(found):
        # Base spans that begin before the candidate's end, back to where none reaches it any more.
        over, at = [], bisect.bisect_left(by_start, (e,)) - 1
        while at >= 0 and reach[at] > s:
            if by_start[at][1] > s:
                over.append(LABELS.index(by_start[at][2]))
            at -= 1
        if over:
            node[i] = -SURE
            node[i, min(over)] = SURE
            seen[i] = min(over)
        else:
            free.append(i)
    if not free:
        return None
    keys = [key_of(t[s:e]) for s, e in found]
    groups: dict[str, list[int]] = defaultdict(list)
    for i, k in enumerate(keys):
        groups[k].append(i)
    # An edge to an observed mention is a score of the free one: it is the same for each of them, however many there are.
    known = {k: {seen[i] for i in g if i in seen} for k, g in groups.items()}
    # Similar keys: each number with all that are ends of it, and each address with the local part it shares.
    near = [(k, k[c:]) for k in groups if "@" not in k for c in range(1, len(k) - 6) if k[c:] in groups]
    locals_: dict[str, list[str]] = defaultdict(list)
    for k in groups:
        locals_[k.partition("@")[0]].append(k)
    shared = [g for g in locals_.values() if len(g) > 1]
    alike: dict[str, set[int]] = defaultdict(set)
    for a, b in near:
        alike[a] |= known[b]
        alike[b] |= known[a]
    for g in shared:
        of_all = set().union(*(known[k] for k in g))
        for k in g:
            alike[k] |= of_all
    for i in free:
        for k in known[keys[i]] | alike.get(keys[i], set()):
            node[i, k] += SAME if k in known[keys[i]] else SIMILAR
    # Free mentions of a key share one variable, and those of similar keys are joined.
    open_ = {k: [i for i in g if i not in seen] for k, g in groups.items()}
    hub = {k: len(found) + n for n, k in enumerate(k for k, g in open_.items() if g)}
    edges = [(i, hub[k], SAME) for k, g in open_.items() for i in g if len(g) > 1 or k in alike]
    edges += [(hub[a], hub[b], SIMILAR) for a, b in near if a in hub and b in hub]
    edges += [(hub[k], len(found) + len(hub) + n, SIMILAR) for n, g in enumerate(shared) for k in g if k in hub]
    node = np.concatenate([node, np.zeros((len(hub) + len(shared), len(LABELS)))])
    factor = np.array([model.get(f"after_{k}", [0.0] * len(LABELS)) for k in LABELS])
    return Field(found, free, node, edges, [(i, i + 1) for i in range(len(found) - 1)] if factor.any() else [], factor)


def added(t: str, base: list[tuple[str, int, int]], model: Weights) -> list[tuple[str, int, int]]:
    """Spans the field labels beyond the base ones.  Ties go to "none"."""
    f = field_of(t, base, model)
    if f is None:
        return []
    belief = messages(f.node, f.edges, f.steps, f.factor)
    out = []
    for i in f.free:
        k = int(belief[i].argmax())
        if k and belief[i, k] - belief[i, 0] > GAIN:
            out.append((LABELS[k], *f.found[i]))
    return out


def training_rows(t: str) -> list[tuple[list[str], int]]:
    """Candidates with the kind of the base span that equals them, or none: weak labels."""
    base = {(s, e): k for k, s, e in base_spans(t)}
    touched = list(base)
    rows = []
    for m in _CANDIDATE.finditer(t):
        kind = base.get((m.start(), m.end()))
        if kind or not any(s < m.end() and m.start() < e for s, e in touched):
            rows.append((features(t, m.start(), m.end()), LABELS.index(kind) if kind else 0))
    for (a, k), (b, j) in zip(rows, rows[1:]):
        a.append(f"next_{LABELS[j]}")
        b.append(f"after_{LABELS[k]}")
    return rows


#: Documents whose candidates train the node model at most, taken by hash, and candidates of one document.
SAMPLE, PER_TEXT = 4000, 50


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Weights:
    """Weights from the candidates of at most `sample` distinct rows with digits or addresses, taken by hash.  Of rows that
    share id and text, however many, one trains; candidates, not texts, come to the driver, PER_TEXT of a text at most."""
    rows = docs.select(F.coalesce(F.xxhash64(column(id_col)), F.lit(0)).alias("h"), column(text_col).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    rows = rows.withColumn("k", F.xxhash64("text"))
    few = rows.select("h", "k").distinct().orderBy("h", "k").limit(sample)
    few = docs.sparkSession.createDataFrame(few.collect(), "h long, k long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()  # at most `sample`
        for whole in batches:
            for b in _chunks(whole, 1 << 23, 2):
                out = []
                for h, k, t in zip(*(c.to_pylist() for c in b.columns)):
                    if (h, k) not in done:
                        done.add((h, k))
                        out.append((h, k, [{"f": f, "y": y} for f, y in training_rows(t)[:PER_TEXT]]))
                cols = list(zip(*out)) if out else [()] * 3
                kind = pa.list_(pa.struct([("f", pa.list_(pa.string())), ("y", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), kind))], ["h", "k", "rows"])

    some = rows.select("h", "k", "text").join(F.broadcast(few), ["h", "k"])
    some = some.mapInArrow(run, "h long, k long, rows array<struct<f:array<string>,y:int>>").groupBy("h", "k").agg(F.first("rows").alias("rows"))
    return fit([(x["f"], x["y"]) for r in some.orderBy("h", "k").collect() for x in r["rows"]])


def _finder(model: Weights):
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _chunks(whole, 1 << 23):
                out = []
                for t in b.column(1).to_pylist():
                    base = base_spans(t) if t else []
                    every = sorted({*base, *(added(t, base, model) if t else ())}, key=lambda x: (order[x[0]], x[1], x[2]))
                    n = [sum(k == x[0] for x in base) for k in KINDS]
                    text = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                    out.append((*n, hashlib.sha256(text(base).encode()).hexdigest(), text(every)))
                cols = list(zip(*out)) if out else [()] * 6
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, base counts by kind, digest of the base spans, all spans.

    Null and empty texts have no spans; texts of any length are read whole.  Repeated rows and rows that share an id are each
    searched for themselves, and a null id is returned as it is.  An empty table gives no rows.  Other columns, whatever their
    names, are neither read nor returned.
    """
    base = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(_finder(model), f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string").withColumnRenamed("id", id_col)
