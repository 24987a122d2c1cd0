"""Nearest neighbours and existence where a third of all points lie in one cell or at one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainage.operators import spatial


@pytest.fixture(scope="module")
def places():
    rng = np.random.default_rng(6)
    hot = rng.uniform(0.5, 0.5005, (400, 2))
    same = np.repeat([[0.25, 0.75]], 150, axis=0)
    return np.concatenate([hot, same, rng.uniform(0, 1, (500, 2)), [[9.0, 9.0]]])


def tables(spark, xy):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "id int, px double, py double"), spark.createDataFrame(rows, "other int, ox double, oy double")


def plain(xy, radius, k):
    out = {}
    for i in range(len(xy)):
        d = np.hypot(*(xy - xy[i]).T)
        order = [j for j in np.lexsort((np.arange(len(xy)), d)) if j != i and d[j] <= radius][:k]
        out[i] = [int(j) for j in order]
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_k_nearest(spark, places, k):
    p, o = tables(spark, places)
    got = {i: [] for i in range(len(places))}
    for r in sorted(spatial.k_nearest(p, o, 0.1, ["id"], ["other"], k, F.col("id") != F.col("other"), cell_rows=20).collect(), key=lambda r: (r.id, r["rank"])):
        got[r.id].append(r.other)
    assert got == plain(places, 0.1, k)


def test_empty_and_null(spark, places):
    p, o = tables(spark, places[:5])
    none = p.limit(0), o.limit(0)
    assert spatial.k_nearest(none[0], o, 0.1, ["id"], ["other"]).count() == 0 and spatial.k_nearest(p, none[1], 0.1, ["id"], ["other"]).count() == 0
    nulls = spark.createDataFrame([(1, None, 0.5), (2, 0.5, 0.5)], "id int, px double, py double")
    assert {r.id for r in spatial.k_nearest(nulls, o, 1.0, ["id"], ["other"]).collect()} == {2}


def test_exists_is_a_semi_join(spark, places):
    p, o = tables(spark, places)
    out = spatial.exists_within(p, o.where("other < 450"), 0.01, ["id"])
    d = np.hypot(*(places[:, None] - places[None, :450]).transpose(2, 0, 1))
    assert {r.id: r.near for r in out.collect()} == {i: bool((row <= 0.01).any()) for i, row in enumerate(d)}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_distance_to_a_segment_far_from_the_origin(spark):
    """Coordinates of 1.8e8 leave 3e-8 a digit; the distance keeps ten places all the same."""
    rng = np.random.default_rng(3)
    at = np.array([4096.0, 180_000_000.0])
    rows = [(i, *(float(v) for v in rng.integers(-64, 64, 6) / 64)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, px double, py double, ax double, ay double, bx double, by double").where("ax <> bx or ay <> by")
    far = df.withColumns({c: F.col(c) + float(at["xy".index(c[1])]) for c in ("px", "py", "ax", "ay", "bx", "by")})
    near = lambda d: {r.i: r.d for r in d.select("i", spatial.project(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")])[1].alias("d")).collect()}
    a, b = near(df), near(far)
    assert max(abs(a[i] - b[i]) for i in a) < 1e-12


def test_nearest_segment_from_small_radii(spark, places):
    """Equal distances go to the smaller segment; points that find nothing near go on to larger radii."""
    rng = np.random.default_rng(8)
    ends = places + rng.normal(0, 0.02, places.shape)
    ends[:150] = places[:150]  # without length
    p, _ = tables(spark, places)
    segments = spark.createDataFrame([(i, *map(float, (*s, *e))) for i, (s, e) in enumerate(zip(places, ends, strict=True))], "other int, ax double, ay double, bx double, by double")
    got = {r.id: (r.other, round(r.dist, 9)) for r in spatial.nearest_segments(p, segments, 0.1, ["id"], "other", 0.05, 9, F.col("id") != F.col("other"), near=4).collect()}
    want = {}
    for i, xy in enumerate(places):
        d, q = ends - places, xy - places
        n = (d * d).sum(1)
        t = np.clip(np.divide((q * d).sum(1), n, out=np.zeros(len(n)), where=n > 0), 0, 1)
        dist = np.round(np.hypot(*(q - t[:, None] * d).T), 9)
        order = [j for j in np.lexsort((np.arange(len(n)), dist)) if j != i and dist[j] <= 0.1]
        if order:
            want[i] = (int(order[0]), float(dist[order[0]]))
    assert got == want


@pytest.mark.parametrize("call", ["aligned_or_nearest", "crossings_by_band", "crossings_by_scenario", "project_on_edges"])
def test_dense_places_do_not_make_all_pairs(spark, tmp_path, call, monkeypatch):
    """1,500 vectors at nearly one place: no search starts from the whole radius."""
    from chainage.plans import all as plans

    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0, 0.002, 2)], i % 10) for i in range(1500)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    radii = []
    for name, at in (("within", 2), ("near_segments", 2)):
        monkeypatch.setattr(spatial, name, lambda *args, f=getattr(spatial, name), at=at, **how: radii.append(args[at]) or f(*args, **how))
    assert plans.QUERIES[call](spark, str(tmp_path)).count() > 0
    assert radii[0] <= 0.01
