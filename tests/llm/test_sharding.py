import numpy as np
import pytest

from chainage.llm.sharding import lookup_table, place, write_shards

NAMES = [f"s{i}" for i in range(7)]


def plain_table(shards, slots):
    """Turn-taking told again, slot by slot."""
    import xxhash

    order = {s: [(xxhash.xxh64_intdigest(s, 1) % slots + k * (xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards}
    owner = {}
    while len(owner) < slots:
        for i, s in enumerate(shards):
            free = next((x for x in order[s] if x not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[x] for x in range(slots)]


def test_table_against_plain_turns():
    assert lookup_table(NAMES, 101).tolist() == plain_table(NAMES, 101)


def test_even_and_stable():
    table = lookup_table(NAMES, 65537)
    share = np.bincount(table, minlength=7)
    assert share.max() - share.min() <= 1
    fewer = lookup_table(NAMES[:-1], 65537)
    stayed = table != 6
    assert (table[stayed] == fewer[stayed]).mean() > 0.85
    weighted = np.bincount(lookup_table(NAMES, 65537, [3, 1, 1, 1, 1, 1, 0]), minlength=7)
    assert weighted[6] == 0 and abs(weighted[0] / weighted[1] - 3) < 0.05


def test_bad_tables():
    for args in (([], 101), (["a", "a"], 101), (NAMES, 100), (NAMES, 5), (NAMES, 101, [0] * 7)):
        with pytest.raises(ValueError):
            lookup_table(*args)


def test_place(spark):
    rows = [(1, "x", 5), (1, "x", 6), (None, None, None), (2, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, slot int")
    got = place(df, ["doc_id"], NAMES, 101).collect()
    assert len(got) == 4 and {r.shard for r in got} <= set(NAMES)
    assert len({(r.slot, r.shard) for r in got if r.doc_id == 1}) == 1
    table = lookup_table(NAMES, 101)
    assert all(NAMES[table[r.slot]] == r.shard for r in got)
    assert place(df.limit(0), ["doc_id"], NAMES, 101).count() == 0
    plan = place(spark.range(1000), ["id"], NAMES, 101)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_write(spark, tmp_path):
    placed = place(spark.range(500).withColumnRenamed("id", "doc_id"), ["doc_id"], NAMES, 101)
    write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.select("shard").distinct().count() == 7


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, "x", 9), (2, None, None, None, None), (2, None, None, None, None)], "slot long, shard string, __slot long, lookup_slot_0 string, `a.b` long")
    names = [f"s{i}" for i in range(4)]
    got = place(df, ["slot", "shard", "a.b"], names, slots=101)
    assert got.columns == ["__slot", "lookup_slot_0", "a.b", "slot", "shard"]
    rows = got.collect()
    assert len(rows) == 3 and {r.shard for r in rows} <= set(names) and sorted(r["__slot"] or 0 for r in rows) == [0, 0, 5]
    table = lookup_table(names, 101)
    assert all(names[table[r.slot]] == r.shard for r in rows)
    assert len({r.slot for r in rows if r["__slot"] is None}) == 1
