import random

import numpy as np
import xxhash

from chainage.llm import simhash as S

DOCS = "doc_id long, text string, source string, fingerprint string, fp long"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, distance=3):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near(fp, bits, rng):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_fingerprint_of_one_text():
    for t in ("", None, " \t\n", "One", "a b", "A b C", "a b c d e f g h", "É é A b c", "x " * 500, "UP Down\x0bup down"):
        assert S.simhash(t) == plain_fingerprint(t), t


def test_nulls_empty_repeats_and_clashing_columns(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until night falls on the quiet hills"
    rows = [(1, text, "a", "x", 5), (2, text, None, None, None), (2, text, None, None, None), (3, None, "a", "", 0), (4, "", None, None, 1), (None, text, "a", "x", 5), (9, "quite other words stand here for once", "b", "y", 6)]
    got = S.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[None] == {(f"{plain_fingerprint(text):016x}", 1)}
    assert by[3] == by[4] == {("0" * 16, 3)}
    assert {c for _, c in by[9]} == {9}


def test_empty_table(spark):
    out = S.near_duplicates(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_links_find_every_pair(spark):
    rng = random.Random(4)
    fps = {}
    for k in range(150):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            fps[len(fps)] = near(base, rng.randint(0, 4), rng)
    distinct = {}
    for i, f in fps.items():
        distinct.setdefault(f, i)
    nodes = spark.createDataFrame([(S._signed(f), i) for f, i in distinct.items()], "fp long, node long")
    for blocks in (5, 6):
        found = {r.node: r.component for r in S.components(S.links(nodes, 3, blocks)).collect()}
        want = plain_components({i: f for f, i in distinct.items()})
        assert {i: found.get(i, i) for i in want} == want


def test_large_class_is_split_and_whole(monkeypatch):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fp = np.array(sorted({near(base, rng.randint(0, 5), rng) for _ in range(700)}), dtype=np.uint64)
    pivots = np.array(S.splitmix64(S.PIVOTS), dtype=np.uint64)
    want = plain_components(dict(enumerate(int(x) for x in fp)))
    for direct in (5000, 64):
        monkeypatch.setattr(S, "DIRECT", direct)
        label = S.classes(fp, 3, pivots)
        groups = {}
        for i, x in enumerate(label.tolist()):
            groups.setdefault(x, set()).add(i)
        expected = {}
        for i, x in want.items():
            expected.setdefault(x, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in S.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[1001] == 1000


def test_rows_without_id_link(spark, monkeypatch):
    fps = {"a": 0, "b": 0b111, "c": 0b111111, "d": (1 << 60) - 1}
    rows = [(7, "a"), (None, "b"), (4, "c"), (4, "d"), (None, "d")]
    monkeypatch.setattr(S, "fingerprints", lambda docs, *_: spark.createDataFrame([(i, fps[t]) for i, t in rows], "doc_id long, fp long"))
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # b joins a and c; the other text of 4 is a class of its own
    assert sorted((r.doc_id or -1, r.fingerprint[-2:], r.component_id) for r in got) == [(-1, "07", 4), (-1, "ff", 4), (4, "3f", 4), (4, "ff", 4), (7, "00", 4)]


def test_every_pivot_discards_before_a_verification():
    rng = np.random.default_rng(0)
    pivots = np.array(S.splitmix64(S.PIVOTS), dtype=np.uint64)
    fp = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    near = fp ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    label = S._pairs(np.concatenate((fp, near)), 3, pivots, np.arange(600))
    assert (label[300:] == label[:300]).all() and len(np.unique(label)) == 300
