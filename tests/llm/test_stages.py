"""The pipeline's stages after the learned one, each against brute force on what its predecessor kept."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from cloakframe.llm import packing
from test_near_duplicates import WORD, brute_components, brute_repeats


def corpus():
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    lay = lambda w, first: "\n".join(" ".join(x) for x in [w[:first], *(w[i : i + 12] for i in range(first, len(w), 12))])
    passage, docs = words(60), []
    for i in range(8):
        base = words(60)
        near = [*base[:-1], "changed"]
        docs += [(3 * i, lay(base, 12) + "\nRead more"), (3 * i + 1, lay([*near, "Read", "more"], 6)), (3 * i + 2, lay([*words(24), *passage, *words(24)], 3 + 3 * (i % 4)))]
    return docs


def brute_lines(docs):
    seen, out = [], {}
    for d, t in sorted(docs.items()):
        kept = []
        for line in t.split("\n"):
            s = frozenset(WORD.findall(line.lower()))
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            seen += [s] if s else []
        out[d] = "\n".join(kept)
    return out


def test_stages_match_brute_force(spark):
    def run(k, docs):
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
        return corpus_pipeline.STAGES[k][1](spark, df, "").collect()

    docs = dict(corpus())
    lined = {r.doc_id: r.text for r in run(1, docs)}
    assert lined == brute_lines(docs) and lined != docs
    kept = {r.doc_id: r.text for r in run(2, lined)}
    assert kept == {d: lined[d] for d, (_, c) in brute_components(list(lined.items())).items() if c == d} and len(kept) < len(lined)
    cut = {r.doc_id: r.text for r in run(3, kept)}
    want = brute_repeats(list(kept.items()))
    assert {d: hashlib.sha256(" ".join(WORD.findall(t)).encode()).hexdigest() for d, t in cut.items()} == {d: w[2] for d, w in want.items()}
    assert any(gone for _, gone, _ in want.values())
    sizes = {}
    for r in run(4, cut):
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    tokens = packing.byte_tokens(packing.default_tokenizer()).library
    assert sizes == {d: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for d, t in cut.items()}
