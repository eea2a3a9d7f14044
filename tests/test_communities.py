"""Communities against a plain multilevel version, one node after the other, and their connectedness."""

import random

import numpy as np
import pytest

from skarn.operators import graph as N
from skarn.plans import adapters as A
from skarn.plans.storage import written


def plain_multilevel(w, gamma, seed):
    """Moves of single nodes until none gains, contraction, again."""
    rng = random.Random(seed)
    k = {i: sum(x.values()) for i, x in w.items()}
    m2, adj, member = sum(k.values()), {i: {j: x for j, x in n.items() if j != i} for i, n in w.items()}, {i: [i] for i in w}
    while True:
        comm, total, moved, ever = {i: i for i in adj}, dict(k), True, False
        while moved:
            moved = False
            for i in sorted(adj, key=lambda _: rng.random()):
                c = comm[i]
                total[c] -= k[i]
                to = {c: 0.0}
                for j, x in adj[i].items():
                    to[comm[j]] = to.get(comm[j], 0.0) + x
                best = max(to, key=lambda d: (round(to[d] - gamma * k[i] * total[d] / m2, 12), d == c))
                comm[i] = best
                total[best] += k[i]
                moved, ever = moved or best != c, ever or best != c
        if not ever:
            return {v: c for c, vs in member.items() for v in vs}
        nk, nm, na = {}, {}, {}
        for i, c in comm.items():
            nk[c] = nk.get(c, 0) + k[i]
            nm.setdefault(c, []).extend(member[i])
            na.setdefault(c, {})
        for i, n in adj.items():
            for j, x in n.items():
                if comm[i] != comm[j]:
                    na[comm[i]][comm[j]] = na[comm[i]].get(comm[j], 0) + x
        adj, k, member = na, nk, nm


def quality(w, comm, gamma):
    m2, d, inside = sum(sum(n.values()) for n in w.values()), {}, 0.0
    for i, n in w.items():
        for j, x in n.items():
            d[comm[i]] = d.get(comm[i], 0) + x
            inside += x * (comm[i] == comm[j])
    return inside / m2 - gamma * sum((x / m2) ** 2 for x in d.values())


def connected(w, members):
    seen, todo = set(), [next(iter(members))]
    while todo:
        i = todo.pop()
        if i not in seen:
            seen.add(i)
            todo += [j for j in w[i] if j in members]
    return seen == members


def table(spark, pairs):
    return spark.createDataFrame([r for i, j, x in pairs for r in ((i, j, x), (j, i, x))], "i string, j string, weight double")


def graphs(spark, sf_dir):
    rng = np.random.default_rng(1)
    planted = [(f"n{a}", f"n{b}", 1.0) for a in range(200) for b in range(a) if rng.random() < (0.3 if a % 5 == b % 5 else 0.02)]
    ring = [(f"r{c}_{a}", f"r{c}_{b}", 1.0) for c in range(30) for a in range(5) for b in range(a)] + [(f"r{c}_0", f"r{(c + 1) % 30}_1", 1.0) for c in range(30)]
    yield "planted", table(spark, planted)
    yield "ring", table(spark, ring)
    yield "neighbours", N.connectivities(N.knn(A.embeddings(spark, sf_dir), 15))


@pytest.mark.parametrize("block_edges", [200_000, 700])
def test_modularity_is_that_of_a_plain_version_and_communities_are_connected(spark, sf_dir, monkeypatch, block_edges):
    """One block, and many blocks that don't see each other's moves in a round."""
    monkeypatch.setattr(N, "BLOCK_EDGES", block_edges)
    for name, edges in graphs(spark, sf_dir):
        edges = written(edges)
        w: dict = {}
        for i, j, x in edges.select("i", "j", "weight").collect():
            w.setdefault(i, {})[j] = x
        got = {r["cell_id"]: r["community"] for r in N.communities(edges, 1.0).collect()}
        want = np.mean([quality(w, plain_multilevel(w, 1.0, seed), 1.0) for seed in range(3)])
        assert got.keys() == w.keys() and quality(w, got, 1.0) >= want - (0.001 if block_edges > 1000 else 0.01), name
        for c in set(got.values()):
            members = {i for i, x in got.items() if x == c}
            assert min(members) == c and connected(w, members), (name, c)


def test_separate_graphs_and_odd_edges(spark):
    """Graphs of their own weight are solved as if alone; loops, repeated and weightless edges don't count; far groups stay apart."""
    one = [("a1", "a2", 1.0), ("a2", "a3", 1.0), ("a1", "a3", 1.0), ("a3", "a4", 0.1), ("a4", "a5", 1.0), ("a5", "a6", 1.0), ("a4", "a6", 1.0)]
    many = [(f"b{c}{x}", f"b{c}{y}", 5.0) for c in range(8) for x in range(4) for y in range(x)] + [(f"b{c}0", f"b{c + 1}0", 0.5) for c in range(7)]
    edges = table(spark, one + many).unionByName(spark.createDataFrame([("a1", "a1", 9.0), ("a1", "a2", 1.0), ("a1", "b00", 0.0)], "i string, j string, weight double"))
    groups = spark.createDataFrame([(x, x[0]) for x in {i for e in one + many for i in e[:2]}], "i string, g string")
    got = {r["cell_id"]: r["community"] for r in N.communities(edges, 1.0, groups=groups).collect()}
    alone = {r["cell_id"]: r["community"] for r in N.communities(table(spark, one), 1.0).collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == alone == {"a1": "a1", "a2": "a1", "a3": "a1", "a4": "a4", "a5": "a4", "a6": "a4"}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {x: f"{x[:2]}0" for x in got if x[0] == "b"}
    assert N.communities(edges.where("false")).collect() == []


def test_graphs_of_their_own_are_cut_as_if_alone(spark, monkeypatch):
    """Two noisy graphs of some 600 edges and one of some 1,200, together over a block: each is cut only if it is over a block itself, and one that isn't has the communities that it has alone."""
    rng = np.random.default_rng(5)
    graphs = {g: [(f"{g}{a:03}", f"{g}{b:03}", float(rng.uniform(0.5, 1))) for a in range(60) for b in range(a) if rng.random() < p] for g, p in zip("abc", (0.16, 0.17, 0.34), strict=True)}
    small, other, large = (2 * len(e) for e in graphs.values())
    edges = written(table(spark, [e for x in graphs.values() for e in x]))
    groups = edges.select("i").distinct().selectExpr("i", "left(i, 1) as g")
    asked, settle = [], N._in_blocks
    monkeypatch.setattr(N, "_in_blocks", lambda *a: asked.append(a[4:]) or settle(*a))
    found = lambda e, g=None: {r["cell_id"]: r["community"] for r in N.communities(e, 1.0, groups=g).collect()}
    alone = found(table(spark, graphs["a"]))
    for most in (700, 1_300):
        assert max(small, other) < 700 < large < 1_300 < small + other + large
        monkeypatch.setattr(N, "BLOCK_EDGES", most)
        asked.clear()
        assert {k: v for k, v in found(edges, groups).items() if k[0] == "a"} == alone
        assert all(within or whole == [True] for within, *whole in asked) == (most > large)  # where no graph is cut, no node is sent beside its block


def test_a_block_ends_where_no_node_gains():
    """Packed lists, a block of 300 nodes that knows 60 others by their communities alone: those stand still, and afterwards no move of a node of the block gains."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, own = 360, 300
    w = np.triu(np.where(rng.random((n, n)) < np.where(np.arange(n)[:, None] % 6 == np.arange(n) % 6, 0.2, 0.02), rng.uniform(0.5, 1, (n, n)), 0), 1)
    w = w + w.T
    k, c = w.sum(1), np.where(np.arange(n) < own, np.arange(n), own + np.arange(n) % 6)
    size, count = np.bincount(c, k, minlength=n), np.bincount(c, minlength=n)
    rows = [{"i": i, "c": int(c[i]), "d": size[c[i]], "n": int(count[c[i]]), "k": k[i] if i < own else None, "two_m": k.sum() if i < own else None,
             "js": np.flatnonzero(w[i]).tolist() if i < own else None, "ws": w[i][w[i] > 0].tolist() if i < own else None} for i in rng.permutation(n).tolist()]
    got = N._settle(pa.Table.from_pylist(rows), 1.0, False).to_pylist()
    assert [r["i"] for r in got] == list(range(own)) and all(r["moved"] == (r["c"] != r["i"]) for r in got)
    c[:own] = [r["c"] for r in got]
    size, count = np.bincount(c, k, minlength=n), np.bincount(c, minlength=n)
    for i in range(own):
        gain = np.bincount(c, w[i], minlength=n) / k[i] - (size - np.where(np.arange(n) == c[i], k[i], 0)) / k.sum()
        near = np.unique(c[w[i] > 0])
        assert gain[near].max() <= gain[c[i]] + 1e-9
    assert len(set(c.tolist())) < 30
