import math

import numpy as np

from chainage.llm import negatives as N

ROWS = "vec_id long, embedding array<double>, label int, rank int, positive_id long"


def plain(rows, every=100, n_pos=5, n_neg=10):
    """rows: (vec_id, vector, label). The contract told again."""
    e = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        e[(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v))] = True
    out = []
    for a in e:
        if a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2], strict=True)), b) for b in e if b != a]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for p, pos in [s for s in scored if s[1][1] == a[1]][:n_pos]:
            fit = [s for s in scored if s[1][1] != a[1] and 30 * p <= 100 * s[0] <= 90 * p][:n_neg]
            out += [(a[0], pos[0], k, neg[0], p, n) for k, (n, neg) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], ROWS)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in N.mine(df, **how).collect())


def vectors(rng, n, dim, labels=4):
    return [(i, [float(x) for x in rng.normal(size=dim)], int(rng.integers(labels))) for i in range(n)]


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = vectors(rng, 900, 8)
    want = plain(rows, 20)
    assert len(want) > 1500 and run(spark, rows, every=20) == want
    # many groups and blocks of anchors give the same
    monkeypatch.setattr(N, "GROUP_ROWS", 37)
    assert run(spark, rows, every=20) == want


def test_ties_and_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    hot = [0.5, 0.25, -0.125]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.integers(-2, 3, 3) / 4], i % 5) for i in range(400)]
    assert run(spark, rows, every=50) == plain(rows, 50)


def test_defined_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (None, [1.0, 1.0], 2), (8, [0.7, 0.1], None), (100, [0.0, 0.0], 1), (9, [-1.0, 0.1], 2)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows + rows[:3] + [(2, [0.25, 0.5], 2), (0, [0.9, 0.5], 1)]) == plain(rows + [(2, [0.25, 0.5], 2), (0, [0.9, 0.5], 1)])
    other = [(10, [1.0, 2.0, 3.0], 1), (11, [1e300, 1.0], 1)]
    assert run(spark, rows + other) == plain(rows)
    large = [(i, [x * 1e5 for x in v], label) for i, v, label in vectors(np.random.default_rng(3), 60, 4)]
    assert run(spark, large, every=20) == plain(large, 20)
    assert run(spark, []) == [] and run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == plain([(0, [], 1), (1, [], 1), (2, [], 2)])


def test_bounds_prune_but_lose_nothing():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 6)) * 400
    x = np.rint(np.repeat(centres, 200, axis=0) + rng.normal(size=(8000, 6)) * 10).astype(np.int64)
    label, ids = rng.integers(0, 3, 8000), rng.permutation(8000)
    tree = N.build(x.astype(np.float64), label)
    assert sorted(tree.order.tolist()) == list(range(8000))
    q = x[::400]
    own = label[::400]
    scores = q @ x.T
    low, high = np.quantile(scores, 0.6, axis=1).astype(np.int64), np.quantile(scores, 0.7, axis=1).astype(np.int64)
    s, row, score, visited = N.search(tree, x, ids, label, N.Search(q, own, low, high, np.arange(0, 8000, 400)), 10, False)
    leaves = (tree.left < 0).sum()
    assert visited < 0.7 * leaves * len(q)
    for k in range(len(q)):
        fit = [j for j in range(8000) if label[j] != own[k] and low[k] <= scores[k, j] <= high[k]]
        want = sorted(fit, key=lambda j: (-scores[k, j], ids[j]))[:10]
        assert row[s == k].tolist() == want and score[s == k].tolist() == scores[k, want].tolist()
