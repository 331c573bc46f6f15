"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text recognises every substring of it.  A text is parsed, from left to
right, into longest matches; a language's cost is its number of phrases times the bits that point at one (the logarithm of its
automaton's text length), by character.  The cheapest language wins, the first by code point among equals.

Texts are parsed whole, as sequences of lower-cased letters with one mark for each run of other characters.  So that one
table lookup steps many places at once, stretches of STRETCH symbols are parsed side by side, each as if a phrase began
there; then the phrase that runs over a stretch's end is followed into the next one until both parses begin a phrase at
the same place, from where on they are the same.  The phrases are those of a parse without stretches.

Each language has its own letters, as many as its text holds: the frequent ones have columns in a table, the others are
looked up by state and letter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import column, held_out, passages
from pathloom.llm.minhash import _chunks

#: Characters of training text: of all languages together, of one at most and at least; documents of one language at most,
#: and characters of one document at most (passages spread over all of it, where it is longer).
TOTAL, EACH, LEAST, DOCS, LONGEST = 240_000, 60_000, 10_000, 60, 5_000
STRETCH = 2048
#: Columns of a language's table at most, and bytes of all tables, which make columns fewer where there are many languages.
COLUMNS, TABLE_BYTES = 64, 1 << 27
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case (0 for what is no letter)."""
    is_letter, low = np.zeros(0x110000, bool), np.zeros(0x110000, np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha():
            is_letter[c], x = True, ch.lower()
            low[c] = ord(x) if len(x) == 1 else c
    is_letter[0x30000:0x33480] = True
    low[0x30000:0x33480] = np.arange(0x30000, 0x33480)
    return is_letter, low


def plain(text: str) -> np.ndarray:
    """Lower-case letters as code points; 0 for each run of anything else."""
    x = _letters()[1][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return x[(x != 0) | np.concatenate(([True], x[:-1] != 0))] if len(x) else x


def transitions(s: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of s: for each state, its steps by symbol.  State 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def table_of(nxt: list[dict[int, int]], symbols: int) -> np.ndarray:
    """The steps on symbols below `symbols`, state by symbol; -1: none."""
    table = np.full((len(nxt), symbols), -1, np.int32)
    for i, d in enumerate(nxt):
        for c, j in d.items():
            if c < symbols:
                table[i, c] = j
    return table


def automaton(s: list[int], symbols: int) -> np.ndarray:
    return table_of(transitions(s), symbols)


class Parser:
    """One language's automaton.  Symbols: the language's letters by falling frequency, those from `wide - 1` on by lookup."""

    def __init__(self, text: np.ndarray, letters: int, wide: int):
        seen = Counter(text.tolist())
        order = sorted(seen, key=lambda c: (-seen[c], c))
        rank = np.full(letters, len(order), np.int64)  # a letter of other languages: no step has it
        rank[order] = np.arange(len(order))
        self.wide = wide
        self.column = np.minimum(rank, wide - 1).astype(np.uint8)
        nxt = transitions(rank[text].tolist())
        self.table = table_of(nxt, wide)
        self.table[:, wide - 1] = -1
        self.table = self.table.ravel()
        # Symbols from wide - 1 on: sorted (state, letter) keys and where they lead.
        rest = sorted((i << 32 | order[c], j) for i, d in enumerate(nxt) for c, j in d.items() if c >= wide - 1)
        self.keys = np.array([k for k, _ in rest], np.int64)
        self.to = np.array([j for _, j in rest], np.int32)

    def rare(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) << 32 | letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def step(self, state: int, letter: int) -> int:
        c = int(self.column[letter])
        if c < self.wide - 1:
            return int(self.table[state * self.wide + c])
        return int(self.rare(np.array([state]), np.array([letter]))[0]) if len(self.keys) else -1

    def phrases(self, letters: np.ndarray, lanes: list[list[int]], begin: np.ndarray, size: np.ndarray, active: np.ndarray) -> list[int]:
        """Phrases of each text.  letters: all texts in a row; lanes: of each text; lanes begin at `begin`, the longest first."""
        column = self.column[letters]
        starts = np.zeros(len(letters), bool)
        state = np.zeros(len(begin), np.int32)
        root = np.maximum(self.table[: self.wide], 0)
        for t, n in enumerate(active.tolist()):
            at = begin[:n] + t
            c = column[at]
            now = state[:n]
            go = self.table[now * self.wide + c]
            if len(self.keys) and len(r := np.flatnonzero(c == self.wide - 1)):
                go[r] = self.rare(now[r], letters[at[r]])
            stuck = np.flatnonzero(go < 0)
            new = root[c[stuck]]
            if len(self.keys) and len(r := np.flatnonzero(c[stuck] == self.wide - 1)):
                new[r] = np.maximum(self.rare(np.zeros(len(r), np.int64), letters[at[stuck[r]]]), 0)
            starts[at[stuck]] = True
            starts[at[now == 0]] = True
            go[stuck] = new
            state[:n] = go
        out = []
        for own in lanes:
            total, carry = 0, 0
            for k in own:
                a, z = int(begin[k]), int(begin[k] + size[k])
                while carry and a < z:  # the phrase of the lane before goes on here
                    go = self.step(carry, int(letters[a]))
                    if go < 0:
                        if starts[a]:
                            break
                        total += 1
                        go = max(0, self.step(0, int(letters[a])))
                    carry = go
                    a += 1
                if a < z:  # both begin a phrase here, or nothing was carried in
                    total += int(np.count_nonzero(starts[a:z]))
                    carry = int(state[k])
            out.append(total)
        return out


class Model:
    """Parsers by language, built where they are used from the bounded training texts."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        parts = {k: plain(texts[k]) for k in self.langs}
        known = np.unique(np.concatenate([np.zeros(1, np.uint32), *parts.values()]))
        self.letter = np.full(0x110000, len(known), np.int32)  # the last: letters never seen in training
        self.letter[known] = np.arange(len(known))
        states = 2 * sum(map(len, parts.values())) + 1
        wide = max(8, min(COLUMNS, TABLE_BYTES // (4 * states)))
        self.parsers, self.bits = [], []
        for k in self.langs:
            own = self.letter[parts[k]]
            self.parsers.append(Parser(own, len(known) + 1, min(wide, len(np.unique(own)) + 1)))
            self.bits.append(math.log2(max(2, len(own))))

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits a character, by text and language."""
        plains = [self.letter[plain(t)] for t in texts]
        letters = np.concatenate(plains) if plains else np.empty(0, np.int32)
        first = np.cumsum([0] + [len(p) for p in plains])
        every = [(i, a) for i, p in enumerate(plains) for a in range(0, len(p), STRETCH)]
        size = np.array([min(STRETCH, len(plains[i]) - a) for i, a in every], np.int64)
        order = np.argsort(-size, kind="stable")
        begin, place = np.array([first[i] + a for i, a in every], np.int64)[order], np.argsort(order)
        size = size[order]
        lanes: list[list[int]] = [[] for _ in texts]
        for (i, _), k in zip(every, place.tolist()):
            lanes[i].append(k)
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size.max(initial=0)) + 1))
        chars = np.maximum(1, np.diff(first))
        out = np.zeros((len(texts), len(self.langs)))
        for k, parser in enumerate(self.parsers):
            out[:, k] = np.array(parser.phrases(letters, lanes, begin, size, active)) * self.bits[k] / chars
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        is_letter = _letters()[0]
        ok = [i for i, t in enumerate(texts) if t and bool(is_letter[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any())]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs or not ok:
            return out
        cost = self.costs([texts[i] for i in ok])  # type: ignore[misc]
        best = cost.argmin(1)
        second = np.partition(cost, 1, axis=1)[:, 1] if len(self.langs) > 1 else np.full(len(ok), np.inf)
        for j, i in enumerate(ok):
            b = cost[j, best[j]]
            out[i] = (self.langs[best[j]], float(1 - b / second[j]) if second[j] > 0 else 0.0)
        return out


@lru_cache(maxsize=2)
def _built(texts: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(texts))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """The training text of each language: documents that are not held out, by hash of the id, up to the bounds.

    Only ids and languages are ranked; the texts of the few chosen are fetched by a broadcast of at most DOCS ids a language.
    Null ids and languages and empty texts do not train; of rows that share id and language the least text does.  Texts
    longer than LONGEST give passages from their whole length.  An empty table gives no languages.
    """
    known = docs.select(column(id_col).alias("_id"), column(lang_col).cast("string").alias("_l"), column(text_col).cast("string").alias("_t"))
    known = known.filter(F.col("_l").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")) & (F.col("_t") != ""))
    order = W.partitionBy("_l").orderBy(F.xxhash64("_id"), "_id")
    few = known.select("_id", "_l").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= DOCS)
    few = docs.sparkSession.createDataFrame(few.collect(), few.schema)
    rows = known.join(F.broadcast(few), ["_id", "_l"]).select("_l", "_r", passages(F.col("_t"), LONGEST).alias("t")).groupBy("_l", "_r").agg(F.min("t").alias("t"))
    rows = rows.orderBy("_l", "_r").collect()
    room = max(LEAST, min(EACH, TOTAL // max(1, len({r["_l"] for r in rows}))))
    out: dict[str, list[str]] = {}
    for r in rows:
        own = out.setdefault(r["_l"], [])
        if sum(map(len, own)) + len(r["t"]) <= room:
            own.append(r["t"])
    return {k: "\n".join(v) for k, v in out.items()}


def _predictor(texts: dict[str, str]):
    key = tuple(sorted(texts.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _built(key)
        for whole in batches:
            for b in _chunks(whole, 1 << 22):
                got = model.predict(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score (the part by which the best cost is below the next).

    Null and empty texts and texts without a letter are "und" with score 0, and so are all where no language was learned.
    Texts of any length are parsed whole.  Of languages with equal costs the first by code point is named.  Repeated rows
    are judged each for itself; a null id is returned and not held out.  An empty table gives no rows.  Other columns,
    whatever their names, are neither read nor returned.
    """
    base = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_predictor(texts), f"id {base.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
