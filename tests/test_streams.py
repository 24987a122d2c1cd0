"""Streamed and chunked forms against their plain functions over whole sections."""

import random

import numpy as np
import pandas as pd
import pytest

from chainage.operators import graph, linear, tables
from chainage.operators import sequences as S
from chainage.plans import all as plans
from chainage.plans.registry import points, track

SF = "/root/testdata/sf0.001"


@pytest.fixture
def short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    yield
    spark.conf.set(name, before)


def sections(spark):
    tr = track(spark, SF).toPandas().sort_values(["user_id", "us", "event_id"])
    return [g.reset_index(drop=True) for _, g in tr.groupby("user_id")]


def test_thinned_paths(spark, short_batches):
    got = {r.event_id: (r.thin, r.simple) for r in plans.QUERIES["thinned_paths"](spark, SF).collect()}
    n = 0
    for g in sections(spark):
        thin = set(g["event_id"][S.thin_by_distance(g["h"].to_numpy(), 6.0)])
        simple = set()
        for _, d in g.groupby("day"):
            simple |= set(d["event_id"].to_numpy()[S.simplify(d[["h", "value"]].to_numpy(np.float64), 50.0)])
        for e in g["event_id"]:
            assert got[e] == (e in thin, e in simple)
            n += 1
    assert n == len(got)



def test_inflection_points(spark, short_batches):
    got = {}
    for r in plans.QUERIES["inflection_points"](spark, SF).collect():
        got.setdefault(r.user_id, []).append(r["at"])
    for g in sections(spark):
        k = g["value"].to_numpy(np.float64) / 100 - 1
        found = [float(g["h"][i]) for scale in (2, 3) for i in S.inflections(k, scale, 0.05)]
        assert np.allclose(sorted(got.get(g["user_id"][0], [])), S.merge_splits(found, 1.0))
    assert got


def test_touching_bends_take_the_lesser_row(spark):
    assert S.inflections(np.array([5, 4, 1, -2, -3, -3.0]), 2, 0.5) == [2] and S.inflections(np.array([5, 4, 3, -2, -3.0]), 2, 0.5) == [3]
    df = spark.createDataFrame([(1, i, float(k)) for i, k in enumerate((5, 4, 1, -2, -3, -3, 0, 0, 9, 9))], "s long, i long, k double")
    assert sorted(r["at"] for r in linear.inflections(df, ["s"], ["i"], "k", "i", 2, 0.5).collect()) == [2, 6]


def test_curvature_radii(spark):
    got = {r.event_id: r.radius for r in plans.QUERIES["curvature_radii"](spark, SF).collect()}
    for g in sections(spark):
        want = np.minimum(S.circle_radii(g["h"].to_numpy(np.float64), g["value"].to_numpy(np.float64), 5), 1e7)
        assert np.allclose([got[e] for e in g["event_id"]], want, rtol=1e-4, atol=0.02)


def test_chunks_with_halo(spark):
    df = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(25)], "s long, i long")
    out = linear.with_halo(df, ["s"], "i", 3, rows=10).collect()
    own = sorted((r.s, r.i) for r in out if r.own)
    assert own == [(s, i) for s in (1, 2) for i in range(25)]
    for c in range(3):
        rows = sorted(r.i for r in out if r.s == 1 and r.chunk == c)
        assert rows == list(range(max(0, 10 * c - 3), min(25, 10 * c + 13)))


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in list(parent)}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in graph.components(df).collect()} == plain_components(edges)
    li, orders = (spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("lineitem", "orders"))
    joined = li.merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    want = plain_components(zip((2 * joined["o_custkey"]).tolist(), (2 * joined["l_partkey"] + 1).tolist(), strict=True))
    assert {r.node: r.component for r in plans.QUERIES["connected_components"](spark, SF).collect()} == want


def test_contained_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(rng.randint(0, n)))
    long, short = [word(12) for _ in range(80)] + [None, "long dark"], [word(5) for _ in range(60)] + [None, "", "on"]
    a = spark.createDataFrame(list(enumerate(long)), "i long, t string")
    b = spark.createDataFrame(list(enumerate(short)), "k long, s string")
    got = sorted((r.i, r.k) for r in tables.contained(a, b, "t", "s").collect())
    assert got == [(i, k) for i, t in enumerate(long) for k, s in enumerate(short) if t is not None and s is not None and s in t]


def test_settings_are_evaluated_together(spark):
    got = plans.QUERIES["travel_time_sweep"](spark, SF).toPandas()
    assert got.groupby(["user_id", "stretch"]).size().eq(9).all() and not got[["user_id", "stretch", "cant_set_id", "cap"]].duplicated().any()
    wide = got.pivot_table(index=["user_id", "stretch", "cant_set_id"], columns="cap", values="minutes")
    assert (wide[153.0] >= wide[177.0] - 1e-9).all() and (wide[177.0] >= wide[201.0] - 1e-9).all()


def test_entry_without_the_optional_part(monkeypatch):
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module
    monkeypatch.setattr(importlib, "import_module", lambda n, *a: (_ for _ in ()).throw(ImportError(n)) if "llm" in n or "pipeline" in n else real(n, *a))
    assert e.queries().keys() == plans.QUERIES.keys() and e.oracle_sql().keys() == plans.ORACLES.keys()


def test_pieces_of_a_key(spark, short_batches):
    df = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in range(k * 4)], "k long, i long")

    def step(state, p, last):
        state = (state or 0) + len(p["i"])
        return state, pd.DataFrame({"k": p["k"][:1], "n": [state], "last": [last]})

    rows = S.in_order(df, ["k"], ["i"], "k long, n long, last boolean", step).collect()
    assert sorted((r.k, r.n) for r in rows if r.last) == [(1, 4), (2, 8), (3, 12)] and len(rows) > 3


def test_components_go_on_with_fewer_edges(spark):
    """Rounds drop what is joined: a dense part is done after a few, a path halves; ids may be text."""
    from chainage.operators import graph

    dense = spark.range(20_000).selectExpr("id % 200 as a", "200 + (id * 7919 + id div 200) % 300 as b").distinct()
    n = dense.count()
    _, left = graph.contracted(dense)
    assert left.count() < n / 4
    path = spark.range(3000).selectExpr("id as a", "id + 1 as b")
    assert graph.contracted(path)[1].count() < 2000
    both = path.union(spark.createDataFrame([(9001, 9001), (9003, 9002), (None, 5)], "a long, b long"))
    got = {r.node: r.component for r in graph.components(both, "a", "b").collect()}
    assert got == {i: 0 for i in range(3001)} | {9001: 9001, 9002: 9002, 9003: 9002}
    words = spark.createDataFrame([("d", "c"), ("b", "c"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {r.node: r.component for r in graph.components(words, "a", "b").collect()} == {"b": "b", "c": "b", "d": "b", "x": "x", "y": "x", "z": "z"}
