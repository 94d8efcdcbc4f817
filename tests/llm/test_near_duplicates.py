"""MinHash and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from cloakframe.llm import minhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def brute_repeats(docs):
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, texts = [], []

    def words(n):
        return [r.choice(vocabulary) for _ in range(n)]

    passage = words(70)
    for i in range(120):
        kind = i % 8
        if kind < 3 or not texts:
            t = words(r.randint(1, 160))
        elif kind == 3:
            t = list(r.choice(texts))
        elif kind in (4, 5):
            t = list(r.choice(texts))
            for _ in range(r.randint(1, 6)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
        elif kind == 6:
            t = words(30) + passage[r.randint(0, 10) :] + words(20)
        else:
            t = words(12) * 9
        texts.append(t)
        docs.append((i * 3 + 1, "".join(w + r.choice([" ", "  ", "\n", "\t"]) for w in t)))
    docs += [(1000, ""), (1001, None), (1002, " \n "), (1003, "one TWO three"), (1004, "One two  three"), (1005, "x"), (1006, "ÄÖ x ä"), (1007, "long" * 9000 + " a" * 3000)]
    chain = words(100)
    for i in range(25):  # a chain of links whose ends are far apart
        docs.append((2000 + i, " ".join(chain[i * 2 :] + [f"z{j}" for j in range(i * 2)])))
    r.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_components_match_brute_force(docs):
    rows, df = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.components(df).collect()}
    assert got == brute_components(rows)


def test_short_near_copies_match_brute_force(spark):
    r = random.Random(6)
    docs = []
    for i in range(240):  # pairs of 3 of 4, 4 of 5, 6 of 8, 9 of 12, 12 of 16 and 17 of 20 shingles
        small, large = [(3, 4), (4, 5), (6, 8), (9, 12), (12, 16), (17, 20)][i % 6]
        t = [f"p{i}x{r.randrange(10**6)}" for _ in range(large + 4)]
        docs += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(t[: small + 4]))]
    want = brute_components(docs)
    assert all(want[2 * i + 1][1] == 2 * i for i in range(240))
    r.shuffle(docs)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


@pytest.mark.parametrize(("small", "large"), [(3, 4), (4, 5), (6, 8), (9, 12), (12, 16), (30, 40)])
def test_estimates_of_small_sets(small, large):
    x = np.random.default_rng(large).integers(0, 1 << 64, (400, large), np.uint64)
    some = minhash.packed(x[:, :small].ravel(), np.arange(0, 400 * small + 1, small))
    every = minhash.packed(x.ravel(), np.arange(0, 400 * large + 1, large))
    estimates = 1 - 2 * np.bitwise_count((some ^ every).view(np.uint64)).sum(1, dtype=int) / minhash.KEPT
    assert estimates.min() >= small / large - minhash.MARGIN and estimates.max() <= small / large + minhash.MARGIN


def test_components_of_odd_tables(spark):
    odd = spark.createDataFrame([(1, "a b c d e f", 7), (1, "a b c d e f", 7), (2, "a b c d e f", 8), (None, "a b c d e f", 9)], "doc_id long, text string, bands int")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in minhash.components(odd).collect())
    assert got == [(False, 1, 1, True), (False, 2, 1, False), (True, None, None, True)]
    assert minhash.keep_one(odd).count() == 3
    assert minhash.components(odd.limit(0)).collect() == []


def test_repeats_match_brute_force(docs):
    rows, df = docs
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(df).collect()}
    assert got == brute_repeats(rows)


def test_repeats_in_odd_tables(spark):
    text = " ".join(f"v{i}" for i in range(60))
    odd = spark.createDataFrame([(1, text, "p"), (1, text, "q"), (2, "a\n" + text + "  z", "r"), (None, text, "s"), (3, None, "t")], "doc_id long, text string, key string")
    got = sorted((r.key, r.text, r.n_words, r.n_removed) for r in substrings.remove_repeats(odd).collect())
    assert got == [("p", text, 60, 0), ("q", text, 60, 0), ("r", "a\nz", 62, 60), ("s", text, 60, 0), ("t", None, 0, 0)]
    assert substrings.remove_repeats(odd.limit(0)).collect() == []


def test_repeats_keep_columns_of_any_name(spark):
    words = " ".join(f"w{i}" for i in range(60))
    own = {n: f"own {n}" for n in ("_doc", "_key", "_spans", "n_words", "n_removed", "anchor", "start")}
    rows = spark.createDataFrame([{"doc_id": i, "text": t, **own} for i, t in enumerate([words, f"new {words} end", None, ""])])
    out = {r.doc_id: r.asDict() for r in substrings.remove_repeats(rows, counts=None).collect()}
    assert [out[i]["text"] for i in range(4)] == [words, "new end", None, ""]
    assert all({k: r[k] for k in own} == own for r in out.values())
    with pytest.raises(ValueError):
        substrings.remove_repeats(rows)
