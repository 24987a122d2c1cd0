import hashlib
import random

from chainage.llm import superkmer as K

DOCS = "doc_id long, text string, n_words long, lo int"


def plain(rows, width=13):
    words = {}
    for i, t in rows:
        words.setdefault(i, (t or "").encode().split())
    first = {}
    for i in sorted(x for x in words if x is not None):
        w = words[i]
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 7, 0) for i, t in rows], DOCS)
    return sorted((tuple(r) for r in K.remove_repeats(df, **how).collect()), key=str)


def sample(rng, docs=60):
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "ñandú", "a"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 60))) for _ in range(8)]
    rows = []
    for i in range(docs):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(parts)))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = sample(rng)
        assert run(spark, rows, n_buckets=7) == plain(rows)


def test_one_bucket_and_other_widths(spark):
    rows = sample(random.Random(2), 30)
    assert run(spark, rows, n_buckets=1, width=5, m=2) == plain(rows, 5)
    assert run(spark, rows, n_buckets=3, width=13, m=13) == plain(rows)


def test_edge_cases(spark):
    text = " ".join(f"word{i}" for i in range(30))
    same = "a " * 40
    rows = [(1, text), (2, None), (3, ""), (4, " \n\t"), (None, text), (5, text), (5, text), (6, same), (7, same), (8, " ".join(["x"] * 12)), (9, " ".join(["x"] * 12))]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_long_text_and_chunks(spark, monkeypatch):
    rng = random.Random(3)
    text = " ".join(str(rng.randint(0, 50)) for _ in range(60_000))
    rows = [(1, text), (2, text[5000:90_000]), (3, "other words " * 20), (4, text)]
    monkeypatch.setattr(K, "CHUNK", 10_000)
    monkeypatch.setattr(K, "HELD", 50_000)
    assert run(spark, rows) == plain(rows)


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    monkeypatch.setattr(K._Text, "runs", lambda self, width: self.ends[width - 1 :].astype("uint64") * 0)
    rows = sample(random.Random(5), 12)
    assert run(spark, rows, n_buckets=2) == plain(rows)


def test_kept_text(spark):
    rows = [(1, " ".join(map(str, range(20)))), (2, "new " + " ".join(map(str, range(20))) + " end")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], DOCS)
    got = {r.doc_id: r.kept for r in K.remove_repeats(df, with_text=True).collect()}
    assert got[2] == "new end" and got[1] == rows[0][1]


def test_ranges_and_repeats_count_as_held():
    held = K._Held(13, 4)
    for doc in range(1000):
        held.add(b"one string", (doc, 0), 0, 1, 2)
    assert held.size >= 999 * K._ENTRY and len(held.ranges) == 999


def test_one_id_with_several_texts(spark):
    """Each text of an id is judged by itself; smaller ids' windows go, those of its other texts stay."""
    rng = random.Random(7)
    first = [str(rng.randint(0, 10**6)) for _ in range(40)]
    own = [str(rng.randint(0, 10**6)) for _ in range(30)]
    rows = [(1, " ".join(first)), (5, " ".join(first + own)), (5, "short one"), (5, "x " + " ".join(own)), (7, " ".join(own)), (5, "short one"), (None, " ".join(first)), (None, "other")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in K.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 40, 0), (5, 70, 40), (5, 2, 0), (5, 31, 0), (7, 30, 30), (5, 2, 0), (None, 40, 0), (None, 1, 0)], key=str)
