import random

from chainage.llm import decontam as D

DOCS = "doc_id long, text string, item_id long, start string"


def semi_global(item, text):
    """Fewest edits of the whole item anywhere in the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(text, edits, rng):
    x = list(text)
    for _ in range(edits):
        p = rng.randrange(len(x))
        kind = rng.random()
        if kind < 0.34:
            x[p] = rng.choice("qxz")
        elif kind < 0.67:
            x.insert(p, rng.choice("qxz"))
        else:
            del x[p]
    return "".join(x)


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "ing", "on", "é", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 25)))
        b = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 40)))
        edits, end = D.banded(D.codes(a), D.codes(b), -len(a), len(b))
        assert edits == semi_global(a, b)
        assert 0 <= end <= len(b)


def test_against_the_full_table(spark):
    rng = random.Random(5)
    items = [words(rng, rng.randint(6, 20)) for _ in range(12)]
    docs = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 15))]
        if rng.random() < 0.6:
            t = rng.choice(items)
            parts += [edited(t, rng.randint(0, int(len(t) * 0.13)), rng).upper() if rng.random() < 0.5 else t.replace(" ", "\n\n"), words(rng, 5)]
        docs.append((i, " ".join(parts)))
    df = spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in D.matches(df, bench).collect()}
    for i, t in docs:
        text = D.normalised(t)
        for k, item in enumerate(items):
            item = D.normalised(item)
            edits = semi_global(item, text)
            if edits <= int(len(item) * 0.1):
                assert got[i, k].edits == edits, (i, k)
                assert semi_global(item, text[got[i, k].start : got[i, k].end]) == edits
            else:
                assert (i, k) not in got
    kept = {r.doc_id for r in D.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_blocks_of_the_benchmark(spark):
    rng = random.Random(6)
    items = [words(rng, 12) for _ in range(9)]
    df = spark.createDataFrame([(i, "start " + t + " end", 0, "") for i, t in enumerate(items)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(map(tuple, D.matches(df, bench).collect()))
    assert sorted(map(tuple, D.matches(df, bench, block_chars=150).collect())) == want and len(want) >= 9
    assert D.drop_contaminated(df, bench, block_chars=150).count() == 0


def test_edges(spark):
    item = "an item of the benchmark that is long enough"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (None, "another item without a number at all")], "item_id long, text string")
    rows = [(None, item, 0, ""), (1, item, 0, ""), (1, item, 0, ""), (2, None, 0, ""), (3, "", 0, ""), (4, "tiny", 0, ""), (5, "x " * 300_000 + item, 0, ""), (6, (item + " ") * 50, 0, ""), (7, "another item without a number at all", 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.item_id) for r in D.matches(df, bench).collect()), key=str)
    assert got == sorted([(None, 1), (1, 1), (1, 1), (5, 1), (6, 1), (7, None), (4, 4)], key=str)
    assert sorted(r.doc_id for r in D.drop_contaminated(df, bench).collect()) == [2, 3]
    assert D.matches(df, bench.limit(0)).count() == 0 and D.drop_contaminated(df, bench.limit(0)).count() == len(rows)
    assert D.matches(df.limit(0), bench).count() == 0


def test_every_length_and_every_number_of_edits(spark):
    rng = random.Random(9)
    items = ["".join(rng.choice("abcdefgh ij") for _ in range(n)).strip().replace(" ", "k") or "a" for n in range(1, 61)]
    assert sorted({len(t) for t in items}) == list(range(1, 61)) or len(items) == 60
    docs = []
    for t in items:
        for edits in range(int(len(t) * 0.1) + 2):
            for _ in range(4):
                docs.append("zz " * rng.randint(0, 3) + edited(t, edits, rng) + " zz" * rng.randint(0, 3))
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.matches(df, bench, least_chars=1).collect()}
    want = {}
    for i, t in enumerate(docs):
        for k, item in enumerate(items):
            if (edits := semi_global(item, D.normalised(t))) <= int(len(item) * 0.1):
                want[i, k] = edits
    assert got == want
    kept = {r.doc_id for r in D.drop_contaminated(df, bench, least_chars=1).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}


def test_fillers_cost_runs():
    import time
    import tracemalloc

    rng = random.Random(2)
    items = [D.normalised(words(rng, 8) + " " + "=" * 40 + " " + words(rng, 8)) for _ in range(50)]
    index = D.Index(items, 8, 0.1)
    tracemalloc.start()
    began = time.monotonic()
    got = index.search(["=" * 20_000, "-=" * 10_000 + items[7] + "=-" * 10_000, "clean"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[h.item for h in hits] for hits in got] == [[], [7], []]
    assert peak < 200e6 and time.monotonic() - began < 60


def test_counts_in_slices(monkeypatch):
    rng = random.Random(4)
    items = [words(rng, 10) for _ in range(30)]
    texts = [" ".join([words(rng, 6), edited(rng.choice(items), 4, rng), items[k], words(rng, 3)]) for k in range(30)]
    texts = [D.normalised(t) for t in texts]
    index = D.Index([D.normalised(t) for t in items], 8, 0.1)
    want = index.search(texts)
    for held in (1, 100, 1000):
        monkeypatch.setattr(D, "HELD", held)
        assert index.search(texts) == want
    assert all(hits for hits in want)


def test_short_items_are_words(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "a b"), (3, "c++"), (4, "é"), (5, "yes")], "item_id long, text string")
    texts = ["say YES!", "eyes", "yes_no", "a  b", "xa b", "in c++ now", "c++11", "café é", "café", "", None, "no, yes, yes"]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], DOCS)
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in D.matches(df, bench).collect())
    assert got == [(0, 1, 4, 7, 0), (0, 5, 4, 7, 0), (3, 2, 0, 3, 0), (5, 3, 3, 6, 0), (6, 3, 0, 3, 0), (7, 4, 5, 6, 0), (11, 1, 4, 7, 0), (11, 5, 4, 7, 0)]
    assert sorted(r.doc_id for r in D.drop_contaminated(df, bench).collect()) == [1, 2, 4, 8, 9, 10]
