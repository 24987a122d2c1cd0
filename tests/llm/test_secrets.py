import hashlib
import random
import re

from chainage.llm import secrets as S

DOCS = "doc_id long, text string, blob string, found string, n_chars long"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    return found


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], DOCS)
    return S.report(docs, S.update(docs).findings).collect()


def texts(n=250):
    rng = random.Random(1)
    bits = ["password", "Passwd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "a.b+c/d-e_f", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", "deadbeef", "é", "中", "\n", "😀", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIiOi.abc"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_base_spans(spark):
    rows = list(enumerate([*texts(), "secret=token:abcdefg", "token=abc password=xyz12345", "AKIA" * 10, "f" * 23, "f" * 24, None, ""]))
    got = {r.doc_id: r for r in run(spark, rows)}
    for i, t in rows:
        want, r = plain(t), got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _, _ in want) for x in range(3)), t
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest(), t
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")] == [f"{k}:{a}:{b}" for a, _, k, b in want]
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def test_added_kinds(spark):
    got = run(spark, [(1, "x ghp_" + "aZ" * 18 + " -----BEGIN RSA PRIVATE KEY-----")])
    assert [s.split(":")[0] for s in got[0].spans.split(",")] == ["github", "private_key"]


def test_ledger_scans_unseen_pairs_only(spark):
    first = spark.createDataFrame([(1, "token = abcdef1", "", "", 0), (2, "token = abcdef1", "", "", 0)], DOCS)
    ledger = S.update(first)
    assert ledger.scanned.count() == 1 and ledger.findings.count() == 1
    # a second run sees one new blob; were the old one scanned again, its finding would come back
    known = S.Ledger(ledger.scanned, ledger.findings.limit(0))
    more = first.union(spark.createDataFrame([(3, "secret: zzzzzz", "", "", 0)], DOCS))
    second = S.update(more, known)
    assert second.scanned.count() == 2 and second.findings.count() == 1
    # a new rule version scans all of it again
    third = S.update(more, known, version="2")
    assert third.scanned.count() == 3 and third.findings.count() == 2


def test_edges(spark):
    rows = [(None, "token = abcdef1"), (1, "token = abcdef1"), (1, "token = abcdef1"), (2, "x" * 300_000 + " token=abcdef1"), (3, "token=abcdef1 " * 3000)]
    got = run(spark, rows)
    assert len(got) == 5 and sum(r.n_assign for r in got) == 3 + 1 + 3000
    assert [r.spans for r in got if r.doc_id == 2] == ["assign:300001:300014"]
    assert run(spark, []) == []


def test_redact(spark):
    text = "é token = abcdef1234567890abcdef1234 end AKIA" + "B" * 16
    docs = spark.createDataFrame([(1, text, "b", "f", 99), (2, "clean", "b", "f", 5), (3, None, "b", "f", None)], DOCS)
    got = {r.doc_id: r for r in S.redact(docs, S.update(docs).findings).collect()}
    assert got[1].text == "é [secret] end [secret]" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "clean" and got[2].blob == "b" and got[2].found == "f" and got[3].text == ""


def test_no_python_in_plan(spark):
    docs = spark.createDataFrame([(1, "x", "", "", 0)], DOCS)
    plan = S.report(docs, S.update(docs).findings)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "token = abcdef123456"), (2, "token = abcdef123456"), (3, "clean"), (4, None)], "doc_id long, text string")
    second = first.union(spark.createDataFrame([(5, "AKIA" + "A" * 20), (6, "clean")], "doc_id long, text string"))
    scanned = []
    own = S.blobs
    monkeypatch.setattr(S, "scan", lambda new, *a, f=S.scan, **k: scanned.append(new.count()) or f(new, *a, **k))
    one = S.extend(first, folder)
    assert one.scanned.count() == 3 and one.findings.count() == 1
    assert S.extend(first, folder).scanned.count() == 3
    two = S.extend(second, folder)
    assert two.scanned.count() == 4 and two.findings.count() == 2 and scanned == [3, 1]
    assert S.extend(second, folder, version="2").scanned.count() == 4
    want = S.report(second, S.update(second).findings)
    assert sorted(map(tuple, S.report(second, two.findings).collect())) == sorted(map(tuple, want.collect())) and own is S.blobs


def test_redact_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "token = abcdef123456", 5, "x", 7), (None, None, None, None, None)], "__blob long, text string, n_chars long, __found string, blob long")
    out = S.redact(docs, S.update(docs).findings)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "[secret]", 8, "x", 7), (None, "", 0, None, None)]


def test_versions_and_the_order_of_rules(spark, tmp_path):
    """Findings of a rule version are that version's alone, and keep their kind when the rules are put in another order."""
    folder = f"file://{tmp_path}/ledger"
    docs = spark.createDataFrame([(1, "token = abcdef123456 AKIA" + "B" * 18), (2, "clean"), (1, "token = abcdef123456 AKIA" + "B" * 18)], "doc_id long, text string")
    more = (S.Rule("card", r"[0-9]{16}", 16), *S.RULES)
    for version, rules in (("1", S.RULES), ("2", more), ("1", S.RULES), ("3", S.RULES[::-1])):
        led = S.extend(docs, folder, rules, version)
        got = sorted(map(tuple, S.report(docs, led.findings, rules, version).collect()))
        want = sorted(map(tuple, S.report(docs, S.update(docs, None, rules, version).findings, rules, version).collect()))
        assert got == want
        assert {r.spans for r in S.report(docs, led.findings, rules, version).collect() if r.doc_id == 1} == {"assign:0:20,access:21:43"}
    # findings of all versions together are told apart too
    both = S.update(docs, S.update(docs), more, "2").findings
    assert {r.n_assign for r in S.report(docs, both, more, "2").collect()} == {0, 1}
    assert S.redact(docs, both, rules=more, version="2").first().text == "[secret] [secret]"
