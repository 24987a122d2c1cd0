import random
import re

from chainage.llm import licenses as L

PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
DOCS = "doc_id long, text string, n_words long, labels string, w string"


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(k, name) for name, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places}))


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, 3, "x", "y") for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: r for r in L.scan(df).collect()}


def test_base_places(spark):
    rng = random.Random(1)
    bits = ["GNU General Public License", "apache\nlicense", "CC-BY", "cc by cc by", "MIT/License", "license", "gnu", "MIT", "Apache", "é", "İ", "K", "x9", "cc", "by", "gnu gnu general public license", "ünïcode"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "...", "mit license", "cc by", "license mit license"]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    got = scan(spark, [mit, mit.replace("obtaining", "getting"), "Permission is granted", bsd + " filler " * 50 + mit, "Mozilla Public License", "plain words only"])
    assert got[0].labels == "mit" and got[0].score > 0.99
    assert got[1].labels == "mit" and 0.6 < got[1].score < 1
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "bsd,mit"
    assert got[4].labels == "mpl" and got[4].base_labels == ""
    assert got[5].labels == ""


def test_edge_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert L.scan(empty).count() == 0
    rows = [(None, "mit license", 0, "", ""), (1, "mit license", 0, "", ""), (1, "mit license", 0, "", ""), (2, "word " * 200_000 + "mit license", 0, "", "")]
    got = L.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 4 and all(r.n_base == 1 for r in got)
    assert [r.first_word for r in got if r.doc_id == 2] == [200_000]


def test_no_python_in_plan(spark):
    plan = L.scan(spark.createDataFrame([(1, "x", 0, "", "")], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_added_labels_against_plain_scan(spark):
    """Each template at each place, by its definition."""
    import math

    rng = random.Random(12)
    fragments = [t.text for t in L.TEMPLATES] + ["permission", "license", "software", "copy", "and", "gnu", "x"]
    texts = []
    for _ in range(150):
        w = " ".join(rng.choice(fragments) for _ in range(rng.randint(0, 5))).split()
        for _ in range(rng.choice((0, 0, 1, 3, 9))):
            if w:
                w[rng.randrange(len(w))] = rng.choice(("x", "license", "the"))
        if w and rng.random() < 0.3:
            del w[rng.randrange(len(w))]
        texts.append(" ".join(w))
    got = scan(spark, texts)
    vocab = L.vocabulary(L.TEMPLATES)
    idf = {v: math.log((1 + len(texts)) / (1 + sum(v in t.split() for t in texts))) + 1 for v in vocab}
    for i, text in enumerate(texts):
        w, found, score = text.split(), set(), 0.0
        for t in L.TEMPLATES:
            words, key = t.text.split(), t.key.split()
            own = sorted(set(words), key=lambda v: (-idf[v], v))[: 1 if t.base else L.LOOKUPS]
            at = next(j for j in range(len(words)) if words[j : j + len(key)] == key)
            total = sum(idf[v] for v in words)
            for start in range(-len(words), len(w) + 1):
                there = [0 <= start + j < len(w) and w[start + j] == v for j, v in enumerate(words)]
                share = sum(idf[v] for v, ok in zip(words, there) if ok) / total
                if sum(there[words.index(v)] for v in own) >= min(L.AGREE, len(own)) and all(there[at : at + len(key)]) and (t.base or share >= L.LEAST_SHARE):
                    found.add(t.label)
                    score = max(score, share)
        assert got[i].labels == ",".join(sorted(found)), text
        assert abs(got[i].score - score) < 2e-6
