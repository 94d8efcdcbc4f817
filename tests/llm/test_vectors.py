"""Lattice hashing and rotated codes against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from cloakframe.llm import lattice, rotated_codes

NAN = float("nan")


def rows():
    r = np.random.default_rng(5)
    out = []
    for i in range(500):
        if i % 4 == 0 or i < 8:
            v = r.normal(size=24)
        elif i % 4 == 1:
            v = np.array(out[r.integers(len(out))][1])
        else:
            v = np.array(out[r.integers(len(out))][1])
            v = v / np.linalg.norm(v) + r.normal(size=24) * 0.25 / np.sqrt(24) * r.integers(1, 4)
        out.append((i * 5, [float(x) for x in np.float32(v)]))
    centre = r.normal(size=24)
    out += [(10_000 + i, [float(x) for x in centre + 0.02 * r.normal(size=24)]) for i in range(700)]  # more than one block
    out += [(20_000, None), (20_100, [0.0] * 24), (20_200, [NAN] + [1.0] * 23), (20_300, [None] + [1.0] * 23), (20_400, []), (20_500, [1.0, 2.0]), (20_501, [2.0, 4.0]), (20_600, [float("inf")] * 24)]
    return out


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def table(spark):
    data = rows()
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)


def test_links_match_brute_force(table):
    data, df = table
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    parent, links = {i: i for i, _ in data}, {i: 0 for i, _ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    use = [(i, np.array(np.float32(v), np.float64)) for i, v in data if good(v)]
    for n, (i, a) in enumerate(use):
        for j, b in use[n + 1 :]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert set(got) == set(links)
    assert all(got[i][0] <= links[i] for i in links)
    assert sum(got[i][0] for i in links) >= 0.995 * sum(links.values())
    assert sum(got[i][1] == find(i) for i in links) >= 0.995 * len(links)
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_links_of_odd_tables(spark):
    odd = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (2, [1.0, 2.0], 3), (None, [1.0, 2.0], 4)], "vec_id long, embedding array<float>, weight int")
    assert sorted(tuple(r) for r in lattice.near_duplicates(odd).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert lattice.near_duplicates(odd.limit(0)).collect() == []


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_vectors_are_not_dealt_to_every_cell(spark):
    r = np.random.default_rng(8)
    centre = r.normal(size=64)
    data = [(i, [float(x) for x in (centre + 0.02 * r.normal(size=64) if i < 1500 else r.normal(size=64))]) for i in range(3000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3).cache()
    assert df.count() == 3000
    before = shuffled(spark)
    got = lattice.near_duplicates(df).collect()
    assert shuffled(spark) - before < 4 * 3000 * 64 * 4
    assert all(tuple(x) == ((x.vec_id, 1499, 0, x.vec_id == 0) if x.vec_id < 1500 else (x.vec_id, 0, x.vec_id, True)) for x in got)


@pytest.mark.parametrize("block", [100, 230])
def test_components_in_rounds_of_blocks(spark, table, monkeypatch, block):
    data, df = table
    want = sorted(tuple(r) for r in lattice.near_duplicates(df).collect())
    monkeypatch.setattr(lattice, "BLOCK", block)
    assert sorted(tuple(r) for r in lattice.near_duplicates(df).collect()) == want


def test_smaller_cells_find_the_same(spark, table, monkeypatch):
    data, df = table
    want = {r.vec_id: tuple(r) for r in lattice.near_duplicates(df).collect()}
    for most, tier in lattice.TIERS[1:3]:
        monkeypatch.setattr(lattice, "TIERS", [(None, tier)])
        got = {r.vec_id: tuple(r) for r in lattice.near_duplicates(df).collect()}
        assert set(got) == set(want) and sum(got[i] == want[i] for i in want) >= 0.995 * len(want)


def test_e8_points():
    y = np.random.default_rng(1).normal(size=(2000, 8)) * 2
    p = lattice.nearest_e8(y)
    assert (p.sum(1) % 2 == 0).all() and (np.abs(y - p) ** 2).sum(1).max() <= 1 + 1e-9
    for v in lattice.shortest():
        assert (((y - p) ** 2).sum(1) <= ((y - p - v) ** 2).sum(1) + 1e-9).all()


def test_nearest_match_brute_force(table):
    data, df = table
    got = {}
    for r in rotated_codes.search(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    use = [(i, np.array(np.float32(v), np.float64)) for i, v in data if good(v)]
    want = {}
    for i, q in use:
        if i % 100 == 0:
            near = sorted((float(rotated_codes.exact(x[None], q[None])[0]), j) for j, x in use if j != i and len(x) == len(q))[:10]
            if near:
                want[i] = [(n + 1, j, s) for n, (s, j) in enumerate(near)]
    assert set(got) == set(want)
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert sum(got[q] == want[q] for q in want) >= 0.97 * len(want)


def test_nearest_in_odd_tables(spark):
    odd = spark.createDataFrame([(100, [1.0, 2.0], 1), (100, [1.0, 2.0], 2), (2, [1.0, 2.0], 3), (None, [1.0, 2.0], 4)], "vec_id long, embedding array<float>, rank int")
    assert [tuple(r) for r in rotated_codes.search(odd, odd.where("vec_id % 100 = 0")).collect()] == [(100, 1, 2, 0.0)]
    assert rotated_codes.search(odd.limit(0), odd.limit(0)).collect() == []
