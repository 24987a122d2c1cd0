import random
import zlib

from chainage.llm import toxicity as T

DOCS = "doc_id long, text string, score double, held_out string"


def corpus(n=400):
    rng = random.Random(2)
    plain = ["river", "stone", "table", "green", "window", "paper", "music", "garden", "trash", "can"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain[:8]) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "bruxtal", "bruxtend"]))
        rows.append((i, " ".join(words), 0.0, "x"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_folding():
    assert T.folded("ID10T") == T.folded("idiot") == T.folded("іdіоt") == T.folded("Ídïöt,") == T.folded("ｉｄｉｏｔ")
    assert T.folded(None) == T.folded("") == "  "
    assert T.folded("l00ser") == T.folded("iooser")


def test_exceptions_and_weights():
    m = T.Matcher({T.folded("trash"): 2.0, " tras": 1.0, T.folded("idiot"): 3.0}, ("trash can",))
    assert m.measure("a trash can")[0] == 0
    assert m.measure("trash trash can")[0] == 2.0
    assert m.measure("idiot, trash")[0] == 5.0
    assert m.measure("") == (0, 1) and m.measure(None) == (0, 1)
    assert T.Matcher({}, ()).measure("anything")[0] == 0


def test_learns_and_holds_out(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.fit(docs, marks)
    assert any(e.strip().startswith("brux") for e in model.lexicon)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())
    # rows of the held-out fold don't reach the fit
    other = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert T.fit(docs, other) == model


def test_disguises_are_found(spark):
    rows, labels = corpus()
    model = T.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = [(1, "you 1d10t and m0ron, іdіоt", 0.0, ""), (2, "river stone table", 0.0, "")]
    got = {r.doc_id: r.predicted for r in T.score(spark.createDataFrame(odd, DOCS), model).collect()}
    assert got == {1: 1, 2: 0}
    kept = T.drop_toxic(spark.createDataFrame(odd, DOCS), model).collect()
    assert [r.doc_id for r in kept] == [2] and kept[0].held_out == ""


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "idiot", 0.0, ""), (1, None, None, None), (2, "", 0.0, ""), (3, "word " * 300_000, 0.0, ""), (3, "x", 0.0, "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(docs, none)
    got = T.score(docs, model).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (3, None, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert T.score(docs, T.fit(docs, odd)).count() == 5
    assert T.score(docs.limit(0), model).count() == 0


def plain_measure(lexicon, exceptions, text):
    """Every entry at every place of the folded text, by plain comparison."""
    t = T.folded(text)
    best, excused = {}, set()
    for i in range(len(t)):
        for p in map(T.folded, exceptions):
            if t.startswith(p, i):
                excused.update(range(i, i + len(p) - 1))
        for e, w in lexicon.items():
            if e not in map(T.folded, exceptions) and t.startswith(e, i):
                best[i] = max(best.get(i, 0.0), w)
    return sum(w for i, w in best.items() if i not in excused), max(1, t.count(" ") - 1)


def test_matcher_equals_plain_comparison():
    import random

    rng = random.Random(11)
    words = ["trash", "can", "tr4sh", "idiot", "1diots", "proof", "stupid", "simple", "cl\u043ewn", "fish", "river", "l0ser", "idiotic", "\u00efdiot", "not", "an"]
    lexicon = {" idiot": 2.0, f" {T.folded('idiot').strip()} ": 3.5, f" {T.folded('trash').strip()} ": 1.0, f" {T.folded('stup').strip()}": 0.5, f" {T.folded('clown').strip()} ": 1.5, f" {T.folded('lose').strip()}": 2.5}
    matcher = T.Matcher(lexicon, T.EXCEPTIONS)
    for _ in range(500):
        text = rng.choice((" ", ", ", "\n")).join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        got, want = matcher.measure(text), plain_measure(lexicon, T.EXCEPTIONS, text)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9, text
    assert matcher.measure(None) == (0, 1)


def test_sample_reads_long_texts_and_repeats_once(spark):
    docs = spark.createDataFrame([(1, "bad " * 60_000), (1, "bad " * 60_000), (2, None), (3, ""), (7, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3, 7)] + [(1, 0, 1)], "doc_id long, quality int, toxic int")
    got = T.learning_rows(docs, labels).collect()
    import zlib

    want = [i for i in (1, 3, 7) if zlib.crc32(str(i).encode()) % 5]
    assert len(got) == len(want) and (1 not in want or max(len(r.text) for r in got) == 240_000)
