import numpy as np

from chainage.llm.neighbours import near_distance, nearest, probes

ROWS = "vec_id long, embedding array<float>, label int, rank int, score double"


def plain(vectors, top=5, every=50):
    ids = np.array([i for i, _ in vectors])
    v = np.array([x for _, x in vectors], np.float32).astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        cos = (v @ v[q]) / (n * n[q])
        rows = [k for k in np.lexsort((ids, -np.round(cos, 12))) if ids[k] != ids[q]][:top]
        out[int(ids[q])] = [(int(ids[k]), cos[k]) for k in rows]
    return out


def run(spark, vectors, **how):
    df = spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 0, 1, 0.5) for i, x in vectors], ROWS)
    out = {}
    for r in sorted(nearest(df, **how).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, x) for i, x in enumerate(rng.normal(size=(1500, 16)))]
    got, want = run(spark, vectors, every=10), plain(vectors, every=10)
    assert recall(got, want) >= 0.95
    score = {q: dict(w) for q, w in plain(vectors, top=1500, every=10).items()}
    assert all(abs(s - score[q][i]) < 1e-12 for q, w in got.items() for i, s in w)


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8)
    vectors = [(i, hot if i % 3 == 0 else rng.normal(size=8)) for i in range(600)]
    got, want = run(spark, vectors), plain(vectors)
    for q in want:
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i in range(0, 600, 3) if i != q][:5]
    assert recall(got, want) >= 0.95


def test_unusable_vectors_and_small_tables(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1, 0]), (1, [1, 1]), (2, [0, 0]), (3, [nan, 1]), (4, [inf, 1]), (5, None), (6, [None, 1]), (7, [1, 2, 3]), (50, [0, 1]), (8, [-1, 0])]
    got = run(spark, vectors)
    assert set(got) == {0, 50}
    assert [i for i, _ in got[0]] == [1, 50, 8] and [i for i, _ in got[50]][0] == 1
    df = spark.createDataFrame([(None, [1.0, 0.0], 0, 0, 0.0)], ROWS)
    assert nearest(df).count() == 0 and nearest(df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert run(spark, [(0, [1.0, 2.0])]) == {}


def test_large_buckets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(8)
    dense = rng.normal(size=8)
    vectors = [(i, dense + rng.normal(size=8) * 0.01 if i % 2 else rng.normal(size=8)) for i in range(800)]
    want, whole = plain(vectors), run(spark, vectors)
    monkeypatch.setattr("chainage.llm.neighbours.PART_ROWS", 30)
    split = run(spark, vectors)
    assert split == whole and recall(split, want) >= 0.95


def test_probes_descend():
    rng = np.random.default_rng(1)
    point = rng.normal(size=3)
    cells = probes(point, 1.0, 1.0, 0.9)
    assert (cells[0] == np.floor(point)).all() or len(cells) > 1
    assert len({tuple(c) for c in cells.tolist()}) == len(cells)
    assert len(probes(point, 1.0, 1.0, 0.5)) < len(cells)
    assert 0 < near_distance(rng.normal(size=(100, 4)), 5) <= 1.5


def test_ties_of_parallel_vectors(spark):
    """Multiples by powers of two are different vectors of one cosine: the smallest ids win."""
    rng = np.random.default_rng(6)
    line = rng.normal(size=8).astype(np.float32)
    vectors = [(i, line * np.float32(2.0 ** (i % 31 - 15)) if i % 3 == 0 else rng.normal(size=8)) for i in range(400)]
    got = run(spark, vectors)
    for q in (0, 150, 300):
        assert [i for i, _ in got[q]] == [i for i in range(0, 400, 3) if i != q][:5]
    # one bucket, everything collinear
    same = [(i, line * np.float32(2.0 ** (i % 60 - 30))) for i in range(240)]
    got = run(spark, same)
    assert all([i for i, _ in got[q]] == [i for i in range(7) if i != q][:5] for q in got) and set(got) == {0, 50, 100, 150, 200}


def test_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 6))
    factor = [10.0 ** (-200, 0, 200)[i % 3] for i in range(120)]
    df = spark.createDataFrame([(i, [float(x) * factor[i] for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    plain_df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got, want = ({(r.query_id, r.vec_id): round(r.score, 9) for r in nearest(d, every=10, recall=0.999).collect()} for d in (df, plain_df))
    assert got == want and len(got) == 60


def test_every_query_is_answered(spark):
    """Lone vectors and tiny tables: as many neighbours as there are rows, five at most."""
    rng = np.random.default_rng(12)
    cone = [(i, np.array([1.0] * 16) + 0.02 * rng.normal(size=16)) for i in range(1, 3000)]
    got = run(spark, [(0, -np.ones(16)), *cone])
    assert len(got) == 60 and all(len(w) == 5 for w in got.values())
    want = plain([(0, -np.ones(16)), *cone])
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and recall(got, want) >= 0.95
    tiny = [(k * 10, rng.normal(size=2)) for k in range(6)]
    got = run(spark, tiny, every=10)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in plain(tiny, every=10).items()}
    assert all(len(w) == 5 for w in got.values())
    spread = [(i, rng.normal(size=24) + 40 * np.eye(24)[i % 24] * rng.choice([-1, 1])) for i in range(700)]
    got = run(spark, spread, every=7)
    assert len(got) == 100 and all(len(w) == 5 for w in got.values()) and recall(got, plain(spread, every=7)) >= 0.95
    assert {q: len(w) for q, w in run(spark, [(0, [1.0, 0.0]), (50, [0.0, 1.0])]).items()} == {0: 1, 50: 1}


def test_exact_pass_in_blocks(spark, monkeypatch):
    from chainage.llm import neighbours as N

    monkeypatch.setattr(N, "EXACT", 3)
    rng = np.random.default_rng(13)
    lone = [(10 * i, np.eye(20)[i] * (1 + i)) for i in range(20)] + [(10 * i + 1, -np.eye(20)[i]) for i in range(5)] + [(200, rng.normal(size=20))] * 2
    got, want = run(spark, lone, every=10), plain(list(dict(lone).items()), every=10)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
