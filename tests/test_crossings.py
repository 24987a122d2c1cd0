"""Counts of crossings by band: zeros, nulls, ties and the total."""

from pyspark.sql import functions as F

from chainage.plans import crossings


def test_counts_and_total(spark):
    pairs = spark.createDataFrame(
        [(1, "a", 2.0, 7, 150.0), (1, "a", 2.0, 6, 190.0), (1, "b", 1.0, 9, 300.0), (2, "b", 5.0, 3, 177.0), (2, "a", 5.0, 4, 153.0), (3, "a", 0.0, 1, None)], "id long, section string, dist double, other long, v double"
    )
    near = crossings.nearest_by_section(pairs, "id", "section", "dist", "other", ["v"])
    assert sorted(map(tuple, near.collect()), key=str) == [(1, "a", 2.0, 190.0), (1, "b", 1.0, 300.0), (2, "a", 5.0, 153.0), (2, "b", 5.0, 177.0), (3, "a", 0.0, None)]
    out = crossings.counts(near, "id", "section", "dist", {"as it is": F.col("v"), "slow": F.col("v") / 2}, ["a", "b", "c"])
    got = {(r.scenario, r.section, r.band): r.n for r in out.collect()}
    assert len(got) == 2 * 4 * 4
    assert {k[1:]: n for k, n in got.items() if n and k[0] == "as it is"} == {("a", "to 201"): 1, ("a", "to 153"): 1, ("b", "over 201"): 1, ("b", "to 177"): 1, (crossings.TOTAL, "over 201"): 1, (crossings.TOTAL, "to 153"): 1}
    assert sum(n for k, n in got.items() if k[0] == "slow" and k[1] == crossings.TOTAL) == 2
    none = crossings.counts(near.limit(0), "id", "section", "dist", {"x": F.col("v")}, ["a"])
    assert {r.n for r in none.collect()} == {0} and none.count() == 8
