"""Toxicity by a weighted finite-state pattern grammar.

Classes of words are the grammar's alphabet: insults (stems with weights learned from labelled rows), and fixed lists of
targets, threats, negations and words that report speech, in the four languages of the corpus.  One transducer a pattern
reads a clause's classes and passes them on marked: negation and target mark what stands near them, reported speech all
that follows it, threat and insult turn what is marked into emissions with a weight.  The five are composed into one
transducer, once; a clause is one walk over its table.  A document's score weighs what its clauses emit against what a
clean text of its length would hold (a Poisson log-likelihood ratio), through a logistic curve fitted on the same rows;
beyond CLIP either way the evidence counts as CLIP, where the curve is flat.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import column, give_back, held_out, passages
from pathloom.llm.minhash import _chunks

THRESHOLD = 0.7
#: Labelled rows that train at most, taken by hash, and characters of one (of a longer one, passages spread over all of it);
#: stems at most; a stem's least toxic documents and log rate ratio.
SAMPLE, LONGEST, STEMS, LEAST, RATIO = 6000, 20_000, 80, 5, 1.0
CLIP = 8.0
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]")
_ENDS = (".", "!", "?", ";", ":", "\n")
# Fixed lists: English, German, French, Spanish.  Stems of insults are learned, in whatever language.
TARGETS = frozenset(
    """you your yours yourself u he him his she her they them their people these those
    du dich dir dein deine deiner euch euer ihr ihm ihn ihnen
    tu toi ton tes vous votre vos lui leur
    ti tu tus usted ustedes vosotros""".split()
)
THREATS = ("kill", "hurt", "destroy", "murder", "beat", "stab", "shoot")
THREAT_FORMS = frozenset(f"{v}{e}" for v in THREATS for e in ("", "s", "ing")) | frozenset("töten umbringen erschießen verprügeln tuer assassiner frapper matar asesinar golpear".split())
NEGATIONS = frozenset(
    """not no never neither nor isn't aren't wasn't don't doesn't didn't won't nobody nothing
    nicht kein keine keinen nie niemals nichts niemand ne pas jamais rien personne nunca jamás nada nadie tampoco""".split()
)
REPORTS = frozenset(
    """said says say wrote writes called calls quoted quotes claimed claims asked told reported according
    sagte sagt schrieb nannte zitierte behauptete fragte laut dit écrit écrivit appela cita affirma demanda selon
    dijo dice escribió llamó citó afirmó preguntó según""".split()
)
PLAIN, AIMED, NEGATED, REPORTED = "plain", "aimed", "negated", "reported"
#: What a state makes of an insult's weight.
FACTOR = {PLAIN: 1.0, AIMED: 1.3, NEGATED: 0.4, REPORTED: 0.5}
THREAT_WEIGHT = 2.5
#: Steps a negation and a target hold.
NEAR = 4
CLASSES = ("", "insult", "threat", "target", "negation", "report")


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: step(state, symbol) gives the next state and the symbol passed on."""

    start: Hashable
    step: Callable[[Hashable, Hashable], tuple[Hashable, Hashable]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one passes on, the other reads."""

        def step(state: tuple, symbol: Hashable) -> tuple:
            a, between = self.step(state[0], symbol)
            b, out = other.step(state[1], between)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: tuple) -> tuple[list[list[int]], list[list]]:
        """All states that can be reached, numbered from the start: next state and output by state and symbol."""
        number, todo, go, out = {self.start: 0}, [self.start], [], []
        for state in todo:
            steps = [self.step(state, x) for x in symbols]
            for to, _ in steps:
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
            go.append([number[to] for to, _ in steps])
            out.append([x for _, x in steps])
        return go, out


def _near(kind: str, mark: str) -> Transducer:
    """Marks the symbols of which `kind` stands at most NEAR steps before.  A symbol is (class, marks)."""

    def step(left: int, symbol: tuple) -> tuple:
        out = (symbol[0], symbol[1] | {mark}) if left else symbol
        return (NEAR if symbol[0] == kind else max(0, left - 1)), out

    return Transducer(0, step)


def _from(kind: str, mark: str) -> Transducer:
    """Marks all symbols after one of `kind`."""
    return Transducer(False, lambda seen, symbol: (seen or symbol[0] == kind, (symbol[0], symbol[1] | {mark}) if seen else symbol))


def _state(kind: str, marks: frozenset) -> str:
    return REPORTED if REPORTED in marks else NEGATED if NEGATED in marks else AIMED if AIMED in marks or kind == "threat" else PLAIN


def _threat() -> Transducer:
    """Turns a threat with a target near before it, or the target that comes near after it, into an emission ("threat", state)."""

    def step(open_: tuple | None, symbol: tuple) -> tuple:
        kind, marks = symbol
        if kind == "threat" and AIMED not in marks:
            return (_state(kind, marks), NEAR), symbol
        out = ("emit", _state(kind, marks)) if kind == "threat" else symbol
        if kind == "target" and open_:
            return None, ("emit", open_[0])
        return ((open_[0], open_[1] - 1) if open_ and open_[1] > 1 else None), out

    return Transducer(None, step)


def _insult() -> Transducer:
    """Ends the cascade: (state, weight) of an emission, (state, None) of an insult, whose weight is its word's, None of all else."""

    def step(_: None, symbol: tuple) -> tuple:
        if symbol[0] == "emit":
            return None, (symbol[1], THREAT_WEIGHT)
        return None, (_state("insult", symbol[1]), None) if symbol[0] == "insult" else None

    return Transducer(None, step)


#: The grammar: its table of states and classes, composed once.
_GRAMMAR = reduce(Transducer.then, (_near("negation", NEGATED), _near("target", AIMED), _from("report", REPORTED), _threat(), _insult()))
_GO, _OUT = _GRAMMAR.table(tuple((k, frozenset()) for k in CLASSES))
_CLASS = {k: i for i, k in enumerate(CLASSES)}


def compose(classes: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """A walk of the composed transducers over a clause's (class, weight) symbols: (state, weight) for each emission.

    Negation and target hold for NEAR steps, reported speech to the clause's end; a threat emits only if a target is near on
    either side.
    """
    out, at = [], 0
    for kind, w in classes:
        k = _CLASS[kind]
        if got := _OUT[at][k]:
            out.append((got[0], w if got[1] is None else got[1]))
        at = _GO[at][k]
    return out


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)  # "word$" whole, or the start of a word; log rate ratio
    excess: float = 0.0  # emissions a word of toxic over clean text
    a: float = 1.0
    b: float = -2.0
    _auto: ahocorasick.Automaton | None = None

    def __getstate__(self):
        return {**self.__dict__, "_auto": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for s in {*(x.rstrip("$") for x in self.stems), *THREAT_FORMS}:
                self._auto.add_word(s, len(s))
            self._auto.make_automaton()
        return self._auto

    def weight(self, word: str) -> float | None:
        w = self.stems.get(word + "$")
        if w is not None:
            return w
        return next((self.stems[word[:k]] for k in range(min(len(word), 10), 2, -1) if word[:k] in self.stems), None)

    def classes(self, clause: str) -> list[tuple[str, float]]:
        out = []
        for word in _TOKEN.findall(clause):
            w = self.weight(word)
            if w is not None:
                out.append(("insult", w))
            else:
                kind = "target" if word in TARGETS else "threat" if word in THREAT_FORMS else "negation" if word in NEGATIONS else "report" if word in REPORTS else ""
                out.append((kind, 0.0))
        return out

    def evidence(self, text: str) -> float:
        """What the clauses with a keyword emit, less what the length makes likely."""
        low = text.lower()
        total, done = 0.0, 0
        for end, n in self.automaton().iter(low):
            s = end + 1 - n
            if s < done or (s and low[s - 1].isalpha()):
                continue
            # The whole clause: a report word holds from wherever it stands to the clause's end.
            before = max(done, 1 + max(low.rfind(c, done, s) for c in _ENDS))
            after = _CLAUSE.search(low, end + 1)
            stop = after.start() if after else len(low)
            total += sum(FACTOR[state] * w for state, w in compose(self.classes(low[before:stop])))
            done = stop
        return total - self.excess * len(text.split())

    def score(self, text: str | None) -> float:
        x = self.a * max(-CLIP, min(CLIP, self.evidence(text or ""))) + self.b
        return 1 / (1 + math.exp(-x))


def _stems_of(word: str) -> Iterator[str]:
    yield word + "$"
    yield from (word[:k] for k in range(4, min(len(word), 10) + 1))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Stems by log rate ratio of toxic to clean words, then the logistic curve, on the same bounded rows."""
    by_word: list[Counter] = [Counter(), Counter()]
    total = [1, 1]
    for text, y in rows:
        tokens = Counter(_TOKEN.findall(text.lower()))
        n = sum(tokens.values())
        total[y] += n
        most = 2 + n // 50  # one word repeated over a text is one observation
        by_word[y].update({w: min(c, most) for w, c in tokens.items()})
    uses: list[Counter] = [Counter(), Counter()]
    for w, c in by_word[1].items():
        for s in _stems_of(w):
            uses[1][s] += c
    often = {s for s, c in uses[1].items() if c >= LEAST}
    for w, c in by_word[0].items():
        for s in _stems_of(w):
            if s in often:
                uses[0][s] += c
    del by_word
    rate = lambda s, y: (uses[y][s] + 0.5) / total[y]
    maybe = {s for s in often if math.log(rate(s, 1) / rate(s, 0)) >= RATIO}
    docs: list[Counter] = [Counter(), Counter()]
    for text, y in rows:
        docs[y].update({s for w in set(_TOKEN.findall(text.lower())) for s in _stems_of(w) if s in maybe})
    odds = lambda d, k: (d + 0.5) / (k + 1)
    n1 = sum(y for _, y in rows)
    ranked = []
    for s, d in docs[1].items():
        if d < LEAST:
            continue
        ratio = min(math.log(rate(s, 1) / rate(s, 0)), math.log(odds(d, n1) / odds(docs[0][s], len(rows) - n1)) + 1.0)
        if ratio >= RATIO:
            ranked.append((ratio * math.sqrt(d), s.endswith("$"), len(s), s, ratio))
    model = Model()
    if not n1 or n1 == len(rows):
        return model
    for value, _, _, s, ratio in sorted(ranked, reverse=True):
        if len(model.stems) >= STEMS or value < 8.0:
            break
        bare = s.rstrip("$")
        if not any(bare.startswith(o) or o.rstrip("$").startswith(bare) for o in model.stems):
            model.stems[s] = min(ratio, 5.0)
    raw = np.array([model.evidence(t) for t, _ in rows])
    n = np.array([len(t.split()) for t, _ in rows], float)
    y = np.array([k for _, k in rows], float)
    # The excess is the one of a few that separates best; then Newton steps for the curve.
    best = None
    for excess in (0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.12):
        x = np.clip(raw - excess * n, -CLIP, CLIP)
        a, b = 0.5, -2.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum()])
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -0.5, 0.5)
        loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
        if best is None or loss < best[0]:
            best = (loss, excess, float(a), float(b))
    _, model.excess, model.a, model.b = best
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """From labelled rows that are not held out; of a document's labels the highest counts, of rows that share an id the least text.

    Null ids and labels do not train; a null text counts as empty.  No labels, or labels of one kind only, give a model that finds
    nothing.  Texts longer than LONGEST train by passages from their whole length.
    """
    known = labels.select(column(id_col).alias("_id"), column(label_col).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(column(id_col).alias("_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("_w"))
    rows = texts.join(F.broadcast(known), "_id").select("_id", "_y", passages(F.col("_w"), LONGEST).alias("_t")).groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    model = fit([(r["_t"], r["_y"]) for r in rows.orderBy(F.xxhash64("_id"), "_id").collect()])
    give_back()  # the driver's memory is bounded, too
    return model


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _chunks(whole, 1 << 21):
                scores = [model.score(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted (score >= THRESHOLD, so that a tie counts as toxic).

    Null texts score as empty ones, texts of any length are read whole.  Repeated rows are scored each for itself; a null id is
    returned and not held out.  An empty table gives no rows.  Other columns, whatever their names, are neither read nor
    returned.
    """
    base = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_scorer(model), f"id {base.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score stays below the threshold, whole, with all columns whatever their names and types.

    Only texts go to Python and only marks come back; rows stay where they are.  Null texts score as empty ones, and repeated
    rows each for itself.
    """

    def clean(texts: pa.Array) -> pa.Array:
        out: list[bool] = []
        for b in _chunks(pa.RecordBatch.from_arrays([texts], ["text"]), 1 << 21, 0):
            out += [model.score(t) < THRESHOLD for t in b.column(0).to_pylist()]
        return pa.array(out, pa.bool_())

    return docs.filter(F.arrow_udf(clean, "boolean")(column(text_col).cast("string")))
