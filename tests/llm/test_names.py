"""Columns of odd names go through every stage that keeps whole rows."""

import pytest

from chainage.llm import decontam, secrets, similar, toxicity

ODD = ["a.b", "c d", "`q`", "text_key", "__doc", "c0", "node", "C1"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["you idiot moron " + "word " * 10, "plain words of a longer text " * 4, "plain words of a longer text " * 4, None, "token = abcdef123456"]
    rows = [(i, t, *[f"{i}{n}" for n in range(len(ODD))]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ["doc_id", "text", *ODD])


@pytest.mark.parametrize("stage", ["toxic", "similar", "decontam", "secrets"])
def test_odd_names(spark, docs, stage):
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "nothing like these documents at all")], "item_id long, text string")
    run = {
        "toxic": lambda d: toxicity.drop_toxic(d, toxicity.fit(d, labels)),
        "similar": similar.representatives,
        "decontam": lambda d: decontam.drop_contaminated(d, bench),
        "secrets": lambda d: secrets.redact(d, secrets.update(d).findings),
    }[stage]
    out = run(docs)
    assert out.columns == docs.columns
    got, given = {r[0]: r for r in out.collect()}, {r[0]: r for r in docs.collect()}
    assert got.keys() == (given.keys() - {2} if stage == "similar" else given.keys())
    for i, r in got.items():
        assert tuple(r)[2:] == tuple(given[i])[2:]
    assert run(docs.limit(0)).count() == 0
