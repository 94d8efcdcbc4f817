"""Document quality by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of PASSAGE words. Each passage is encoded from measured
features (case, symbols, digits, word lengths, repetition within the passage and within the
document, ...) by a small tanh layer; gated attention, learned from the document labels
alone, weighs the passages, and the weighted sum is scored.

The model is fitted on the driver, on at most TRAINING labelled documents chosen by hash
(those of more than LONGEST passages are left out of the fit, never of the scoring).

Defined results: null and empty texts are one empty passage and get a score like any other;
without labels of both kinds every document scores 0.5; repeated rows are each
scored; columns other than doc_id and text are never read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import Multipliers, Words, mix, text_chunks
from cloakframe.llm.labelled import sample

PASSAGE = 64
TRAINING, LONGEST = 4000, 400
HIDDEN, GATE = 16, 8
THRESHOLD = 0.3

_BY = Multipliers(61)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-\""]] = True
_CLASSES = (
    lambda d: (d >= 65) & (d <= 90),
    lambda d: (d >= 97) & (d <= 122),
    lambda d: (d >= 48) & (d <= 57),
    lambda d: _SYMBOL[d],
    lambda d: d >= 128,
    lambda d: (d == 46) | (d == 44),
    lambda d: d == 10,
)
FEATURES = len(_CLASSES) + 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text and one past the last). Every text has a passage."""
    words = Words(data, offsets, _BY, lower=False)
    n = len(offsets) - 1
    each = np.maximum(1, -(-words.counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(each)])
    x = np.zeros((first[-1], FEATURES))
    if not len(words.start):
        return x, first
    inside = np.arange(len(words.start)) - words.first[:-1][words.doc]
    passage = first[:-1][words.doc] + inside // PASSAGE
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    rows = passage[begins]
    lo, hi = words.start[begins], np.append(words.start[begins[1:]], offsets[-1])
    last = words.end[np.append(begins[1:], len(passage)) - 1]
    hi = np.where(np.append(words.doc[begins[1:]] != words.doc[begins[:-1]], True), last, hi)
    size = np.maximum(1, hi - lo).astype(float)
    for k, of in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(of(data))])
        x[rows, k] = (total[hi] - total[lo]) / size
    k = len(_CLASSES)
    count = np.bincount(passage, minlength=len(x)).astype(float)
    full = np.maximum(1, count)
    lens = (words.end - words.start).astype(float)
    x[:, k] = np.bincount(passage, lens, len(x)) / full / 10
    x[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(passage, lens * lens, len(x)) / full - (x[:, k] * 10) ** 2)) / 10
    salt = mix(passage.astype(np.uint64) + np.uint64(7))
    _, once = np.unique(words.hash ^ salt, return_index=True)
    x[:, k + 2] = np.bincount(passage[once], minlength=len(x)) / full
    salt = mix(words.doc.astype(np.uint64) + np.uint64(11))
    _, once = np.unique(words.hash ^ salt, return_index=True)
    x[:, k + 3] = np.bincount(passage[once], minlength=len(x)) / full
    if len(words.hash) > 1:
        pair = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:]) ^ salt[:-1]
        _, once = np.unique(pair, return_index=True)
        x[:, k + 4] = np.bincount(passage[once], minlength=len(x)) / full
    x[:, k + 5] = count / PASSAGE
    x[:, k + 6] = np.log1p(words.counts)[np.repeat(np.arange(n), each)] / 8
    return x, first


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parameters: tuple[np.ndarray, ...]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """Scores of the bags, with what the gradients need."""
        w, b, v, u, a, c, c0 = self.parameters
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(z @ w + b)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        logit = (tv * su) @ a
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        top = np.maximum.reduceat(logit, first[:-1])
        e = np.exp(logit - top[bag])
        attention = e / np.add.reduceat(e, first[:-1])[bag]
        rep = np.add.reduceat(h * attention[:, None], first[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(rep @ c + c0[0], -30, 30)))
        return p, rep, attention, h, tv, su, z, bag


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.02) -> Model:
    """Adam on the log-loss, all bags at once."""
    r = np.random.Generator(np.random.PCG64(5))
    shapes = ((x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,))
    p = [r.normal(size=s) / np.sqrt(s[0]) if len(s) > 1 or s[0] > 1 else np.zeros(s) for s in shapes]
    p[1][:] = 0
    scale = x.std(0)
    mean, scale = x.mean(0), np.where(scale > 1e-6, scale, 1.0)
    m1, m2 = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for t in range(1, rounds + 1):
        w, b, v, u, a, c, c0 = p
        score, rep, attention, h, tv, su, z, bag = Model(mean, scale, tuple(p)).forward(x, first)
        g = (score - y) / len(y)
        grep = g[:, None] * c
        gh = attention[:, None] * grep[bag]
        # Attention: d logit_k = a_k (grep.h_k - sum_j a_j grep.h_j).
        along = (h * grep[bag]).sum(1)
        glogit = attention * (along - np.add.reduceat(attention * along, first[:-1])[bag])
        gate = glogit[:, None] * a
        gv, gu = gate * su * (1 - tv**2), gate * tv * su * (1 - su)
        gh = (gh + gv @ v.T + gu @ u.T) * (1 - h**2)
        grads = [z.T @ gh, gh.sum(0), h.T @ gv, h.T @ gu, (tv * su).T @ glogit, rep.T @ g, np.array([g.sum()])]
        for k, grad in enumerate(grads):
            grad = grad + 1e-4 * p[k] * (p[k].ndim > 1 or k == 5)
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad**2
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, tuple(p))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, limit: int = TRAINING, rounds: int = 300) -> Model | None:
    """Learn from at most `limit` documents; `allowed` is a condition on labels' rows. None without both labels."""
    chosen = sample(docs, labels, "quality", allowed, limit)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                x, first = passages(data, offsets)
                fits = np.diff(first) <= LONGEST
                bags = [x[a:b].astype("<f4").tobytes() for a, b, ok in zip(first[:-1], first[1:], fits, strict=True) if ok]
                yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column(1).slice(lo, hi - lo).filter(pa.array(fits))], names=["x", "y"])

    rows = sorted(((bytes(r.x), r.y) for r in chosen.mapInArrow(measure, "x binary, y int").collect()), key=lambda r: (r[1], r[0]))
    if len({y for _, y in rows}) < 2:
        return None
    bags = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for x, _ in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags).astype(float), first, np.array([y for _, y in rows], float), rounds)


def score(df: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) for each row of `doc_id, text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                s = model.forward(*passages(data, offsets))[0] if model else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
