import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from chainage.functions import curves, scalar
from chainage.operators import graph, intervals, linear, robust, sequences, spatial, tables
from chainage.sources import files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(1)
    span = lambda: sorted(rng.choice([rng.uniform(0, 100), float(rng.randint(0, 10) * 10)]) for _ in range(2))
    a = [(rng.randint(0, 2), i, *span()) for i in range(80)]
    b = [(rng.randint(0, 2), i, *span()) for i in range(80)]
    da = spark.createDataFrame([*a, (0, 99, None, 5.0)], "k int, a int, a_lo double, a_hi double")
    db = spark.createDataFrame(b, "k int, b int, b_lo double, b_hi double")
    want = sorted((x[1], y[1], round(min(x[3], y[3]) - max(x[2], y[2]), 9)) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    for width in (3.0, 10.0, 500.0):
        got = intervals.overlap_join(da, db, ["k"], width).collect()
        assert sorted((r.a, r.b, round(r.overlap, 9)) for r in got) == want
    pieces = intervals.subtract(da, db, ["k"], ["a"], 10.0).collect()
    for k, i, lo, hi in a:
        cover = [(max(lo, y[2]), min(hi, y[3])) for y in b if y[0] == k and y[2] < hi and lo < y[3] and y[2] < y[3]]
        own = sorted((r.lo, r.hi) for r in pieces if r.a == i)
        for t in [lo + (hi - lo) * (j + 0.5) / 97 for j in range(97)] if lo < hi else []:
            assert any(x <= t < y for x, y in own) != any(x <= t < y for x, y in cover)


def test_touching_intervals(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 10.0)], "k int, a int, a_lo double, a_hi double")
    b = spark.createDataFrame([(1, 10.0, 20.0), (1, 5.0, 5.0), (1, -5.0, 0.0)], "k int, b_lo double, b_hi double")
    assert intervals.overlap_join(a, b, ["k"], 4.0).count() == 0
    assert rows(intervals.subtract(a, b, ["k"], ["a"], 4.0)) == [(1, 1, 0.0, 10.0)]
    assert rows(intervals.overlap_share(a, b, ["k"], ["a"], 4.0).select("share")) == [(0.0,)]


def test_two_level_running_operators(spark):
    rng = random.Random(2)
    data = [(k, i, i // 7, rng.choice("ab") if rng.random() < 0.9 else None, rng.random()) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(data, "k int, i int, block int, v string, x double")
    for f in (lambda b: linear.running_sum(df, ["k"], ["i"], F.col("x"), "out", b), lambda b: linear.previous(df, ["k"], ["i"], "v", "out", b), lambda b: linear.islands(df, ["k"], ["i"], "v", "out", b)):
        one = {(r.k, r.i): r.out for r in f(None).collect()}
        two = {(r.k, r.i): r.out for r in f("block").collect()}
        assert one.keys() == two.keys() and all(one[x] == two[x] or abs(one[x] - two[x]) < 1e-9 for x in one)
    runs = linear.runs(df, ["k"], ["i"], "v", "i", "block").collect()
    assert sum(r.n for r in runs) == len(data)


def test_asof_and_interpolation(spark):
    marks = spark.createDataFrame([(1, 10.0, 100.0), (1, 20.0, 200.0), (1, 20.0, 300.0)], "k int, at double, y double")
    asked = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 15.0), (1, 20.0), (1, 99.0), (2, 1.0)], "k int, at double")
    down = {r.at: r.y for r in linear.asof(asked, marks, ["k"], "at", ["y"]).where("k = 1").collect()}
    assert down == {5.0: None, 10.0: 100.0, 15.0: 100.0, 20.0: 300.0, 99.0: 300.0}
    up = {r.at: r.y for r in linear.asof(asked, marks, ["k"], "at", ["y"], "forward").where("k = 1").collect()}
    assert up == {5.0: 100.0, 10.0: 100.0, 15.0: 200.0, 20.0: 200.0, 99.0: None}
    lerp = {r.at: r.z for r in linear.interpolate(asked, marks.limit(2), ["k"], "at", "y", "z").where("k = 1").collect()}
    assert lerp == {5.0: 100.0, 10.0: 100.0, 15.0: 150.0, 20.0: 200.0, 99.0: 200.0}


def test_spatial_against_all_pairs(spark):
    rng = random.Random(3)
    p = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(150)]
    o = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(150)]
    dp, do = spark.createDataFrame(p, "id int, px double, py double"), spark.createDataFrame(o, "other int, ox double, oy double")
    want = sorted((a, b) for a, x, y in p for b, u, v in o if (x - u) ** 2 + (y - v) ** 2 <= 0.01)
    assert sorted((r.id, r.other) for r in spatial.within(dp, do, 0.1).collect()) == want
    best = {a: min((b for aa, b in want if aa == a), key=lambda b: ((p[a][1] - o[b][1]) ** 2 + (p[a][2] - o[b][2]) ** 2, b)) for a, _ in want}
    assert {r.id: r.other for r in spatial.nearest_within(dp, do, 0.1, ["id"], ["other"]).collect()} == best
    assert {r.id: r.other for r in spatial.nearest_vertex(dp, do, ["id"], "other", 0.1).collect()} == best
    assert {r.id for r in spatial.exists_within(dp, do, 0.1, ["id"]).where("near").collect()} == set(best)


def test_every_speed_keeps_its_class(spark):
    k = [s.coefficient for s in (curves.CantSet("base", 100, 76), curves.CantSet("tilting", 127, 152))]
    df = spark.range(1, 6001).select((F.col("id") * 1.0).alias("r")).crossJoin(spark.createDataFrame([(x,) for x in k], "k double"))
    out = df.withColumn("least", F.col("r") * (F.pmod(F.xxhash64("r", "k"), F.lit(100)) / 100)).withColumn("p", curves.published(F.col("r"), F.col("least"), F.col("k")))
    assert out.where(curves.classify(F.col("p.vmax")) != F.col("p.code")).count() == 0
    assert out.where("p.vmax > 360 or p.vmax is null").count() == 0
    grid = spark.range(3601).select((F.col("id") / 10).alias("v")).withColumn("c", curves.classify(F.col("v")))
    assert {r.c: (r.a, r.b) for r in grid.groupBy("c").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()}["E"] == (100.0, 159.9)


def test_scalars(spark):
    df = spark.createDataFrame([("24:10:30", "single", None), ("bad", " 3 ", float("inf")), ("1:2", "multiple", 10.0), (None, None, 100.0)], "t string, tag string, r double")
    got = df.select(scalar.minutes_of_day(F.col("t")), scalar.track_number(F.col("tag")), scalar.degree_of_curve(F.col("r"))).collect()
    assert [r[0] for r in got] == [1450.5, None, None, None]
    assert [r[1] for r in got] == [1, 3, 2, None]
    assert [r[2] if r[2] is None else round(r[2], 3) for r in got] == [None, 0.0, 180.0, 17.532]
    one = spark.range(1)
    x, y = (c for c in scalar.equirectangular(F.lit(45.5), F.lit(-73.6), 45.0))
    lat, lon = scalar.from_equirectangular(x, y, 45.0)
    r = one.select(lat, lon, scalar.angle_between(F.lit(350.0), F.lit(20.0)), scalar.angle_folded(F.lit(10.0), F.lit(200.0)), scalar.utm_epsg(F.lit(-73.6)), scalar.clamp(F.lit(None).cast("double"), 1.0, 2.0)).first()
    assert round(r[0], 9) == 45.5 and round(r[1], 9) == -73.6 and r[2] == 30 and r[3] == 10 and r[4] == 32618 and r[5] is None
    e, n = scalar.transverse_mercator(F.lit(45.5), F.lit(-73.6), F.lit(-75.0))
    e2, n2 = scalar.transverse_mercator(F.lit(45.501), F.lit(-73.6), F.lit(-75.0))
    r = one.select(e, n, F.hypot(e2 - e, n2 - n)).first()
    assert abs(r[0] - 609_367) < 50 and abs(r[1] - 5_039_526) < 300 and abs(r[2] - 111.15) < 0.2


def test_timetable_pairs(spark):
    calls = [("t1", 1, "A", 1430.0), ("t1", 2, "B", 1450.0), ("t2", 1, "B", 10.0), ("t2", 2, "A", 40.0), ("t3", 1, "A", 5.0), ("t3", 2, "B", None), ("t4", 1, "A", 0.0), ("t4", 2, "B", 30.0), ("t4", 3, "A", 70.0), ("t5", 1, "A", 0.0)]
    df = spark.createDataFrame(calls, "trip string, seq int, stop string, at double")
    assert rows(tables.pair_minutes(df, "trip", ["seq"], "stop", "at", "A", "B")) == [("t1", 20.0), ("t2", 30.0), ("t4", 40.0)]
    assert rows(tables.pair_minutes(df, "trip", ["seq"], "stop", "at", "A", "B", repeats="first")) == [("t1", 20.0), ("t2", 30.0), ("t4", 30.0)]


def test_figures_and_attribution(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.5), (None, 4.0)], "kind string, `a value` double")
    figure = tables.Figure("sum", (("kind", "in", ["a", "b"]),), "a value", published=3.5, digits=1)
    assert rows(tables.verify(df, [figure])) == [("sum", 3.5, 3.5, True)]
    assert tables.evaluate(df, tables.Figure("n", (("a value", "<", 4),), mode="count")).first()[0] == 2
    for bad in ((("kind", "~", 1),),):
        with pytest.raises(ValueError):
            tables.predicate(bad)
    with pytest.raises(ValueError):
        tables.evaluate(df, tables.Figure("x", mode="mean"))
    parts = spark.createDataFrame([(10.0, 2.0, 3.0), (4.0, 6.0, 2.0), (5.0, None, 5.0)], "g double, a double, b double")
    for r in tables.attribution(parts, ["a", "b"], "g", "rest").collect():
        assert abs(r.a + r.b + r.rest - r.g) < 1e-9


def test_weighted_and_ranked(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 1.0), (1, 30.0, 2.0), (2, 5.0, 1.0), (2, None, 9.0)], "k int, v double, w double")
    assert rows(robust.lower_weighted_median(df, ["k"], "v", "w", "m")) == [(1, 20.0), (2, 5.0)]
    values = spark.createDataFrame([(n, float(i)) for n in range(4, 30) for i in range(n)], "n int, x double")
    got = {r.n: r.q for r in robust.low_index_quantile(values, ["n"], "x", 0.75, "q").collect()}
    assert got == {n: float(int(0.75 * (n - 1))) for n in range(4, 30)}


def test_graph(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 4], [(0.0, float(i)) for i in range(4)]), (2, [5, 3, 6], [(1.0, 2.0), (0.0, 2.0), (-1.0, 2.0)])], "way_id int, node_refs array<int>, coords array<struct<lat double, lon double>>")
    edges = graph.split_at_junctions(ways)
    assert sorted((r.way_id, r.u, r.v) for r in edges.collect()) == [(1, 1, 3), (1, 3, 4), (2, 3, 6), (2, 5, 3)]
    total = edges.where("way_id = 1").agg(F.sum("length_m")).first()[0]
    assert abs(total - 3 * 111_194.93) < 1
    parts = graph.components(spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)], "u int, v int"))
    assert {r.component for r in parts.collect()} == {0, 100} and parts.count() == 53


def test_files(spark, tmp_path):
    import zipfile

    df = spark.createDataFrame([(1, "é;x", None), (2, None, 2.5)], "a int, b string, c double")
    files.write_semicolon(df, str(tmp_path / "csv"))
    part = next(p for p in (tmp_path / "csv").iterdir() if p.name.endswith(".csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa;b;c")
    assert rows(files.read_semicolon(spark, str(tmp_path / "csv"), df.schema)) == rows(df)
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stops.txt", "﻿stop_id,stop_name\n1,\"A, B\"\n2,C\n")
    assert rows(files.read_zipped_csv(spark, str(tmp_path / "feed.zip"), "stops.txt", ["stop_id", "stop_name", "absent"])) == [("1", "A, B", None), ("2", "C", None)]
    assert files.read_zipped_csv(spark, str(tmp_path / "feed.zip"), "none.txt", ["x"]).count() == 0
    shape = spark.createDataFrame([("seg", "x", [(1.0, 2.0), (3.0, 4.0)]), ("stop", "y", [(5.0, 6.0)])], "kind string, name string, points array<struct<lon double, lat double>>")
    files.write_features(shape, str(tmp_path / "geo"), ["kind", "name"])
    lines = [line for p in (tmp_path / "geo").glob("*.txt") for line in p.read_text().splitlines()]
    (tmp_path / "all.geojson").write_text('{"type":"FeatureCollection","features":[' + ",".join(lines) + "]}")
    back = files.read_features(spark, str(tmp_path / "all.geojson"), spark.createDataFrame([], "kind string, name string").schema)
    assert rows(back.select("kind", "name", F.to_json("points"))) == [("seg", "x", '[{"lon":1.0,"lat":2.0},{"lon":3.0,"lat":4.0}]'), ("stop", "y", '[{"lon":5.0,"lat":6.0}]')]
    assert files.read_features(spark, str(tmp_path / "all.geojson"), spark.createDataFrame([], "kind string").schema, "stop").count() == 1
    assert files.clean_names(df.withColumnRenamed("a", " a  b ")).columns == ["a b", "b", "c"]
    assert files.without_label_row(df, "b", "é;x").count() == 1


def test_small_keys_are_whole(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias("x"))
    got = sequences.per_small_key(df, ["k"], ["x"], "k long, n long, ordered boolean", lambda c: [(int(c["k"][0]), len(c["x"]), bool((c["x"][1:] > c["x"][:-1]).all()))])
    out = got.collect()
    assert len(out) == 700 and sum(r.n for r in out) == 5000 and all(r.ordered for r in out)
    assert sequences.per_small_key(df.limit(0), ["k"], ["x"], "k long, n long", lambda c: []).count() == 0


def test_rest_works_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
    for folder in ("chainage/functions", "chainage/operators", "chainage/plans", "chainage/sources"):
        for name in os.listdir(os.path.join(ROOT, folder)):
            if name.endswith(".py"):
                with open(os.path.join(ROOT, folder, name)) as f:
                    assert "chainage.llm" not in f.read(), name
