"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes (insult, threat, target, negation, reported speech, other). Four
transducers are composed into one machine that runs over a clause:

* negation moves an insult or threat in its scope to a class of its own;
* reported speech does so for the rest of the clause;
* the target transducer joins an insult or threat with a word for a person near it;
* the scorer gives each match its kind and weight.

What is scored are the matches of clauses, not words: a document's features are the
weights of its matched clauses by kind, and a logistic model, fitted on a bounded sample
of labelled documents, makes a score from them. The insult lexicon has a fixed
part, and stems learned from the sample (beginnings of words that are significantly more frequent in
documents labelled 1), weighted by their log-odds.

Defined results: null and empty texts have no match and get the model's base rate; without
labels of both kinds, the fixed lexicon and fixed weights are used; rows that repeat are each
scored; columns other than doc_id and text are never read for a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.labelled import sample

#: Labelled documents that are learned from, at most, and stems that are kept.
TRAINING, STEMS = 8000, 400
STEM_MIN, STEM_MAX = 4, 8
THRESHOLD = 0.3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Classes that transducers add.
NEG_INSULT, NEG_THREAT, SAID_INSULT, SAID_THREAT, AIMED_INSULT, AIMED_THREAT = range(6, 12)

INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown imbecile crétin connard ordure minable idioot dummkopf abschaum versager arschloch estúpido imbécil escoria basura".split()
THREATS = "kill murder hurt destroy stab strangle beat burn tuer détruire frapper töten umbringen zerstören matar destruir golpear".split()
TARGETS = "you your you're yourself he she they him her them his their these those this people tu toi vous votre ton ils elles eux du dich dir ihr euch sie diese tú usted ustedes ellos ellas te ti vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't without nor hardly pas jamais aucun sans non nicht kein keine keinen nie niemals ohne nunca jamás sin tampoco ningún".split()
REPORTS = "said says say wrote writes called claimed claims quoted quote reported according alleged dit écrit selon déclaré appelé sagte sagt schrieb laut zitierte nannte dijo dice escribió según llamó".split()

_TOKEN = re.compile(r"\w+(?:['’]\w+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
NEGATION_SCOPE, TARGET_SCOPE = 4, 6


# ---------------------------------------------------------------- transducers


@dataclass(frozen=True)
class Transducer:
    """Deterministic, from classes to classes: step(state, class) -> (state, class, weight). States are small tuples."""

    start: tuple
    step: object = field(compare=False)

    def then(self, other: Transducer) -> Transducer:
        """This one's output is the other's input; weights multiply."""

        def step(state: tuple, symbol: int) -> tuple:
            mine, out, weight = self.step(state[0], symbol)
            theirs, out, more = other.step(state[1], out)
            return (mine, theirs), out, weight * more

        return Transducer((self.start, other.start), step)


def _negation(state: tuple, symbol: int) -> tuple:
    left = state[0]
    if symbol == NEGATION:
        return (NEGATION_SCOPE,), OTHER, 1.0
    out = {INSULT: NEG_INSULT, THREAT: NEG_THREAT}.get(symbol, symbol) if left else symbol
    return (max(0, left - 1),), out, 1.0


def _reported(state: tuple, symbol: int) -> tuple:
    if symbol == REPORT:
        return (1,), OTHER, 1.0
    return state, ({INSULT: SAID_INSULT, THREAT: SAID_THREAT}.get(symbol, symbol) if state[0] else symbol), 1.0


def _target(state: tuple, symbol: int) -> tuple:
    left = state[0]
    if symbol == TARGET:
        return (TARGET_SCOPE,), OTHER, 1.0
    out = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}.get(symbol, symbol) if left else symbol
    return (max(0, left - 1),), out, 1.0


#: Kinds of match, and how much of a word's weight each keeps before the model weighs the kinds.
KINDS = (INSULT, AIMED_INSULT, NEG_INSULT, SAID_INSULT, THREAT, AIMED_THREAT, NEG_THREAT, SAID_THREAT)
_KEPT = {INSULT: 1.0, AIMED_INSULT: 1.25, NEG_INSULT: 0.4, SAID_INSULT: 0.4, THREAT: 0.1, AIMED_THREAT: 1.0, NEG_THREAT: 0.1, SAID_THREAT: 0.1}


def _scorer(state: tuple, symbol: int) -> tuple:
    return state, symbol, _KEPT.get(symbol, 0.0)


GRAMMAR = Transducer((0,), _negation).then(Transducer((0,), _reported)).then(Transducer((0,), _target)).then(Transducer((), _scorer))


@lru_cache(maxsize=1 << 16)
def _arc(state: tuple, symbol: int) -> tuple:
    return GRAMMAR.step(state, symbol)


def run_clause(symbols: list[int], weights: list[float]) -> list[tuple[int, float]]:
    """(kind, weight) of the matches of a clause. A target may also follow its insult: the clause is read both ways, the heavier reading counts."""

    def read(order: Iterator[int]) -> dict[int, tuple[int, float]]:
        state, out = GRAMMAR.start, {}
        for i in order:
            state, kind, kept = _arc(state, symbols[i])
            if kept:
                out[i] = (kind, kept * weights[i])
        return out

    ahead = read(range(len(symbols)))
    back = {}
    if TARGET in symbols and any(k in (INSULT, THREAT) for k, _ in ahead.values()):
        back = read(range(len(symbols) - 1, -1, -1))
    out = []
    for i, (kind, weight) in ahead.items():
        if kind in (INSULT, THREAT) and i in back and back[i][0] in (AIMED_INSULT, AIMED_THREAT):
            kind, weight = back[i]
        out.append((kind, weight))
    return out


# ---------------------------------------------------------------- lexicon


def stems_in(text: str) -> set[str]:
    out = set()
    for word in set(_TOKEN.findall(text.lower())):
        for n in range(STEM_MIN, min(STEM_MAX, len(word)) + 1):
            out.add(word[:n])
    return out


def learn_stems(counts: dict[str, tuple[int, int]], positive: int, negative: int) -> dict[str, float]:
    """Stem -> log-odds, of those whose frequency in positive documents is far from chance.

    Of stems that begin each other, the most significant stays (the longest of equals).
    """
    base = positive / max(1, positive + negative)
    least = max(8.5, math.log(max(2, len(counts))))
    found = []
    for stem, (p, n) in counts.items():
        share = p / (p + n)
        if p < 4 or share < 0.6 or share <= base:
            continue
        gain = p * math.log(share / base) + (n * math.log((1 - share) / (1 - base)) if n else 0.0)
        if gain >= least:
            found.append((-gain, -len(stem), stem, math.log((p + 0.5) / (positive + 1)) - math.log((n + 0.5) / (negative + 1))))
    chosen: dict[str, float] = {}
    for _, _, stem, weight in sorted(found):
        if len(chosen) < STEMS and not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            chosen[stem] = weight
    return chosen


def needed(stems: dict[str, float], docs: list[list[int]]) -> dict[str, float]:
    """Of stems in order, those found in at least two positive documents that no stem before them explains.

    Words that only keep company with an insult (as in copies of one document) go by this. `docs` has the
    positions of the stems in each positive document, a list for each different one.
    """
    holders: dict[int, list[int]] = {}
    for d, found in enumerate(docs):
        for k in found:
            holders.setdefault(k, []).append(d)
    explained = [False] * len(docs)
    kept = {}
    for k, (stem, weight) in enumerate(stems.items()):
        new = [d for d in holders.get(k, []) if not explained[d]]
        if len(new) >= 2:
            kept[stem] = weight
            for d in new:
                explained[d] = True
    return kept


class Lexicon:
    """Words to classes: whole words of the fixed lists, and stems that begin words."""

    def __init__(self, stems: dict[str, float]) -> None:
        import ahocorasick

        self.words: dict[str, tuple[int, float]] = {}
        for symbol, words in ((TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS), (INSULT, INSULTS)):
            for w in words:
                self.words[w] = (symbol, 3.0)
        self.stems = stems
        self.sizes = sorted({len(s) for s in stems})
        self.scan = ahocorasick.Automaton()
        for w in [*INSULTS, *THREATS, *stems]:
            self.scan.add_word(w, len(w))
        self.scan.make_automaton()

    def read(self, word: str) -> tuple[int, float]:
        if word in self.words:
            known = self.words[word]
            if known[0] != INSULT:
                return known
        for n in self.sizes:
            if (w := self.stems.get(word[:n])) is not None and len(word) >= n:
                return INSULT, w
        return self.words.get(word, (OTHER, 0.0))

    def matches(self, text: str) -> list[tuple[int, float]]:
        """(kind, weight) of all matched clauses of a text."""
        text = text.lower()
        out, done = [], -1
        for end, size in self.scan.iter(text):
            start = end - size + 1
            if start < done or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
                continue
            # The clause around the hit.
            a = max(text.rfind(c, max(done, 0), start) for c in ".!?;:\n") + 1
            stop = _CLAUSE_END.search(text, end + 1)
            b = stop.start() if stop else len(text)
            a = max(a, done)
            words = _TOKEN.findall(text, a, b)
            read = [self.read(w.replace("’", "'")) for w in words]
            out += run_clause([r[0] for r in read], [r[1] for r in read])
            done = b
        return out


FEATURES = len(KINDS) + 3


def features(matches: list[tuple[int, float]], size: int) -> list[float]:
    """By kind, the matched weight (saturating); then the heaviest match, the number of matches, and matches for the length."""
    totals = [0.0] * len(KINDS)
    for kind, weight in matches:
        totals[KINDS.index(kind)] += weight
    top = max((w for _, w in matches), default=0.0)
    return [math.log1p(t) for t in totals] + [top / 4, math.log1p(len(matches)), math.log1p(1000 * len(matches) / (size + 200))]


# ---------------------------------------------------------------- model


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    weights: tuple[float, ...]
    bias: float


#: Where nothing can be learned: aimed insults and threats count, negated and reported ones hardly.
DEFAULT = Model({}, (1.5, 2.0, 0.2, 0.2, 0.3, 2.0, 0.1, 0.1, 1.0, 0.5, 0.2), -3.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method on the log-loss."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(design.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-6
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + penalty * w
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, limit: int = TRAINING) -> Model:
    """Learn stems and weights from at most `limit` labelled documents; `allowed` is a condition on labels' rows."""
    train = sample(docs, labels, "toxic", allowed, limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        total = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(stems_in(text or ""))
                total[y] += 1
        # A stem that is in one of the labelled-0 documents and none of the others can't be chosen.
        stems = list(seen[1])
        negative = [s for s in seen[0] if s not in seen[1]]
        names = ["", *stems, *negative]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([total[1], *(seen[1][s] for s in stems), *[0] * len(negative)], pa.int64()), pa.array([total[0], *(seen[0][s] for s in stems), *(seen[0][s] for s in negative)], pa.int64())], names=["stem", "p", "n"])

    sums = train.mapInArrow(count, "stem string, p long, n long").groupBy("stem").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # Bounded by the sample: stems in at least four of its positive documents, mostly there.
    rows = sums.where("stem = '' or (p >= 4 and p >= 0.6 * (p + n))").collect()
    total = next(((r.p, r.n) for r in rows if r.stem == ""), (0, 0))
    if not total[0] or not total[1]:
        return DEFAULT
    stems = learn_stems({r.stem: (r.p, r.n) for r in rows if r.stem}, *total)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {s: k for k, s in enumerate(stems)}
        for batch in batches:
            found = [sorted(order[s] for s in stems_in(t or "") if s in order) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["found"])

    holds = train.where("y = 1").mapInArrow(locate, "found array<int>").distinct().collect()  # at most `limit` rows
    stems = needed(stems, sorted(r.found for r in holds))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            x = [features(lexicon.matches(t or ""), len(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    found = train.mapInArrow(measure, "x array<double>, y int").collect()  # at most `limit` rows
    x, y = np.array([r.x for r in found]), np.array([r.y for r in found], float)
    order = np.lexsort((*x.T, y))
    weights, bias = fit_logistic(x[order], y[order])
    return Model(stems, tuple(map(float, weights)), bias)


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of `doc_id, text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(model.stems), np.array(model.weights)
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                z = float(np.dot(features(found, len(text)), w)) + model.bias if (found := lexicon.matches(text)) else model.bias
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            s = np.array(out, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(df: DataFrame, model: Model) -> DataFrame:
    """The rows of `df` whose text isn't predicted toxic."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(model.stems), np.array(model.weights)
        least = math.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            keep = []
            for text in batch.column(at):
                text = text.as_py() or ""
                found = lexicon.matches(text)
                keep.append((float(np.dot(features(found, len(text)), w)) if found else 0.0) + model.bias < least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
