import pytest

from chainage.llm import decontam, secrets, similar

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    words = [f"{a}{b}" for a in ("river", "stone", "table", "green", "paper", "music") for b in ("", "s", "ly", "ed", "er")]
    docs, labels = [], []
    for i in range(120):
        text = [words[(i * 7 + k * (i % 11 + 3)) % len(words)] + str(i * k % 17) for k in range(40)]
        toxic = i % 4 == 0
        if toxic:
            text[5:5] = ["idiot", "moron", "scum"]
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    item = "the one passage of the benchmark that nobody may train on"
    docs += [(200, docs[1][1]), (201, docs[3][1] + " more"), (202, "a start " + item.upper() + " an end"), (203, "my token = abcdef123456 stays hidden here"), (204, None), (205, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_in_turn(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    seen = []
    for k, (name, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        now = {r.doc_id: r for r in docs.collect()}
        seen.append((name, now))
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
    after = dict(seen)
    toxic = {i for i in range(0, 120, 4)}
    assert not toxic & after["toxicity"].keys() and len(after["toxicity"]) == len(rows) - len(toxic)
    want = {}
    for i in sorted(after["toxicity"]):
        own = similar.shingles(rows[i].text)
        if not any(similar.similarity(own, x) >= 0.8 for x in want.values()):
            want[i] = own
    assert set(want) == set(after["near_duplicates"]) and not {200, 201, 205} & want.keys()
    assert set(after["near_duplicates"]) - set(after["decontamination"]) == {202}
    assert after["secrets"][203].text == "my [secret] stays hidden here" and after["secrets"].keys() == after["decontamination"].keys()
    assert after["packing"].keys() == after["secrets"].keys()
    assert decontam.normalised("A  b\n") == "a b" and secrets.RULE_VERSION


def test_run(spark, sf_dir):
    import corpus_pipeline as C

    out = C.run(spark, sf_dir)
    assert out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"]
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
