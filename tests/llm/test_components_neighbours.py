import numpy as np
import pytest

from quillmere.llm import components, neighbours


def groups_of(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {(x, root(x)) for x in list(parent)}


def matches(spark, rows):
    # extra columns whose names the operator uses itself
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "file_id long, similar_files array<long>, vertex long, a long")


CASES = {
    "star and chain": [(1, [k]) for k in range(2, 40)] + [(k, [k + 1]) for k in range(100, 180)] + [(500, [499])],
    "chain longer than the frontier rounds": [(k, [k + 1]) for k in range(30)],
    "hub with a tail, least id at the end": [(50, [k]) for k in range(60, 90)] + [(60, [5]), (5, [4]), (4, [3]), (3, [2]), (2, [1])],
    "nulls, repeats, self links, both directions": [(None, [1]), (7, None), (8, []), (9, [9]), (3, [4, None]), (4, [3]), (3, [4]), (-2, [3])],
}


@pytest.mark.parametrize("name", CASES)
def test_groups_against_union_find(spark, name):
    rows = CASES[name]
    got = components.found(spark, matches(spark, rows)).collect()
    edges = [(a, b) for a, bs in rows if a is not None for b in bs or [] if b is not None and b != a]
    assert sorted(map(tuple, got)) == sorted(groups_of(edges))


def test_random_graphs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), [int(b)]) for a, b in rng.integers(0, 150, (130, 2))]
    got = components.found(spark, matches(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(groups_of([(a, b) for a, (b,) in rows if a != b]))


def test_no_links_and_singletons(spark):
    assert components.found(spark, matches(spark, [])).count() == 0
    alone = components.groups(spark, matches(spark, [(5, None), (6, [6]), (1, [2]), (9, [])])).collect()
    assert sorted(map(tuple, alone)) == [(1, 1), (2, 1), (5, 5), (6, 6), (9, 9)]


def brute(vectors, k, least):
    names = sorted(vectors)
    x = np.array([vectors[n] for n in names], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    found = set()
    for i, n in enumerate(names):
        others = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-round(s[i, j], 9), names[j]))[:k]
        found |= {(n, names[j]) for j in others if s[i, j] >= least}
    return found


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y") for r in rows], "checksum string, embedding array<double>, id string, code binary")


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, 64))
    return {f"c{k:04d}": [float(v) for v in centres[k % len(centres)] + 0.15 * rng.normal(size=64)] for k in range(n)}


def test_neighbours_against_brute_force(spark):
    vectors = clustered(400)
    got = {(r["key"], r["neighbour"]) for r in neighbours.neighbours(table(spark, list(vectors.items())), 5, 0.9, leaf=32).collect()}
    want = brute(vectors, 5, 0.9)
    assert not got - want and len(got & want) >= 0.95 * len(want)


def test_without_threshold_small_sets_are_exact(spark):
    vectors = clustered(60, 1)
    got = {(r["key"], r["neighbour"]) for r in neighbours.neighbours(table(spark, list(vectors.items())), 3).collect()}
    assert got == brute(vectors, 3, -2)


def test_invalid_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    v = [float(x) for x in rng.normal(size=64)]
    w = [float(x) for x in rng.normal(size=64)]
    bad = [("null", None), ("short", v[:10]), ("zero", [0.0] * 64), ("nan", [float("nan")] + v[1:]), ("hole", [None] + v[1:]), (None, v), ("inf", [float("inf")] + v[1:])]
    copies = [(f"k{j}", v) for j in range(9)]
    rows = bad + copies + copies[:3] + [("scaled", [4 * x for x in v]), ("other", w)]
    got = {tuple(r) for r in neighbours.found(table(spark, rows)).collect()}
    names = sorted([k for k, _ in copies] + ["scaled"])
    want = set()
    for n in names:
        want |= {(min(n, m), max(n, m)) for m in [x for x in names if x != n][:5]}
    assert got == want
    assert neighbours.found(table(spark, bad)).count() == 0
    assert neighbours.found(table(spark, [])).count() == 0


def test_a_key_with_several_vectors_loses_no_neighbour(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=64)
    near = lambda: [float(x) for x in base + 0.01 * rng.normal(size=64)]
    rows = [("k000", near()) for _ in range(8)] + [(f"n{j}", near()) for j in range(4)] + [("a", near()), ("a", near())]
    got = neighbours.neighbours(table(spark, rows), 3).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in got} == {k: 3 for k in ("k000", "a", "n0", "n1", "n2", "n3")}


def test_dense_vectors_give_few_candidates():
    rng = np.random.default_rng(9)
    n = neighbours.INNER + 2000
    x = rng.normal(size=64) + 0.02 * rng.normal(size=(n, 64))
    short = np.rint(x * (127 / np.abs(x).max(1))[:, None]).astype(np.int8)
    for tags in (np.arange(n) * 2 + 1, np.arange(n) * 2 + (np.arange(n) % 3 > 0)):
        pairs = np.concatenate([np.stack(p) for p in neighbours._leaf_pairs(tags, short, 5, 0.9)], 1)
        most = neighbours.INNER_LEAVES * neighbours.SPARE * 5
        assert pairs.shape[1] <= most * n and (pairs[0] != pairs[1]).all()
        assert set(np.unique(pairs[0])) == set(range(n)) and set(pairs[1]) <= set((tags >> 1)[tags % 2 == 1])


def test_best_against_all_cosines():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(5000, 16)).astype(np.float32)
    ids = np.arange(5000)
    a, b = neighbours._best(ids[::50], x[::50], ids, x, 4, -np.inf)
    s = x[::50] @ x.T
    s[np.arange(100), ids[::50]] = -np.inf
    want = {(i * 50, int(j)) for i in range(100) for j in np.argsort(-s[i])[:4]}
    assert set(zip(a.tolist(), b.tolist())) == want
