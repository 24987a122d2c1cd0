import hashlib
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainage.llm import middle as M

DOCS = "doc_id long, text string, n long, form string, digest string, h1 string"


def plain(doc_id, text, rate=50):
    """The contract told again, one document at a time."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 7, "x", "y", "z") for i, t in rows], DOCS)
    return M.transform(df, digests=True, **how).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_against_plain(spark):
    rng = random.Random(8)
    bits = ["a", "bé", " ", "\t\n", "  ", "<", "<P", "<S>", "P>", "ω" * 5, "\u00a0", "\u2003", "\x0b", "\x1c", "x" * 50, "😀"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(600)] + [(1000, None), (1001, ""), (1002, " "), (1003, "x"), (None, "a b c"), (None, None), (1004, "<P>"), (1005, "word " * 300_000), (5, "twice"), (5, "twice")]
    for rate in (50, 100, 0):
        got = run(spark, rows, rate=rate)
        assert len(got) == len(rows)
        want = sorted((str(i), *[str(x) for x in plain(i, t, rate)], sha(plain(i, t, rate)[-1]), sha(t or "")) for i, t in rows)
        assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.output_sha256, r.restored_sha256) for r in got) == want
    assert {r.form for r in run(spark, rows, rate=100)} == {"plain", "spm", "psm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\né<PSM>😀", max_size=12), max_size=8), st.integers(0, 5))
def test_kernel(texts, drop):
    array = pa.array(texts, pa.string())[drop:]
    texts = texts[drop:]
    b = M.batch_of(array)
    one, two = (M.np.array([7 * i + k for i in range(len(texts))], M.np.int64) for k in (3, 5))
    c = M.cuts(b, one, two)
    for i, t in enumerate(texts):
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        lo, hi = sorted((int(one[i]) % (len(units) + 1), int(two[i]) % (len(units) + 1)))
        assert c.n[i] == len(units) and c.marked[i] == any(m in t for m in ("<P>", "<S>", "<M>"))
        assert b.data[b.offsets[i] : c.first[i]].tobytes().decode() == "".join(units[:lo])
        assert b.data[c.first[i] : c.second[i]].tobytes().decode() == "".join(units[lo:hi])
        assert (c.prefix_chars[i], c.middle_chars[i]) == (len("".join(units[:lo])), len("".join(units[lo:hi])))


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restored(form):
    for parts in (("", "", ""), ("<", "<S", "P>"), ("a<P", ">", "M>"), ("<M", "x", "<"), ("é ", "😀", " ")):
        p, m, s = (x.encode() for x in parts)
        assert M.restored(form, M.arranged(form, p, m, s)) == p + m + s


def test_edge_tables(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([("k1", "a b"), (None, "a")], "key string, body string")
    assert sorted(r.n for r in M.transform(df, "key", "body").collect()) == [1, 2]


def test_small_chunks(spark, monkeypatch):
    b = M.batch_of(pa.array(["ab", "", "cdefgh", "i", "jk"]))
    assert list(M._pieces(b.offsets, 3)) == [(0, 2), (2, 3), (3, 5)]
    assert list(M._pieces(b.offsets, 1 << 20)) == [(0, 5)] and list(M._pieces(b.offsets[:1], 5)) == []
