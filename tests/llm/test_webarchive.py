import base64
import hashlib
import io
import zipfile

import pytest

from chainage.llm import webarchive as W
from chainage.llm.common import fresh_dir

PAGES = "page_id long, url string, html string, key string, refers_to string"


def plain(rows, least=0):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        last = max(same, default=None)
        revisit = i is not None and len(b) >= least and i != last
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def run(spark, rows, least=0, **how):
    df = spark.createDataFrame([(i, u, h, "k", "r") for i, u, h in rows], PAGES)
    return sorted((tuple(r) for r in W.round_trip(df, fresh_dir(spark, "test"), least, **how).collect()), key=str)


def test_round_trip(spark):
    rows = [(i, f"http://a.example/{i}", f"<p>é {i % 4}</p>" if i % 5 else None) for i in range(40)] + [(50, None, ""), (51, "http://x y/\n", "a\r\n\r\nb"), (None, "u", "<p>é 1</p>"), (3, "http://a.example/3", "<p>é 3</p>"), (60, "u", "z" * 300_000)]
    for how in ({}, {"least": 9}, {"package_bytes": 300}):
        assert run(spark, rows, **how) == plain(rows, how.get("least", 0))
    assert run(spark, []) == []


def test_payloads_come_back(spark):
    df = spark.createDataFrame([(1, "u", "héllo", "", ""), (2, "u", "héllo", "", "")], PAGES)
    packages = spark.createDataFrame(W.write(df, fresh_dir(spark, "test")).collect())
    got = {r.page_id: r for r in W.read(packages).collect()}
    assert bytes(got[2].payload) == "héllo".encode() and got[1].payload is None and got[1].refers_to == 2


def test_packages_are_plain_zip_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}", "", "") for i in range(5)], PAGES)
    W.write(df.coalesce(1), f"file://{tmp_path}").collect()
    (path,) = tmp_path.glob("*.wacz")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and set(z.namelist()) == {W.DATA, W.INDEX, W.MANIFEST}
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert len(z.read(W.INDEX).splitlines()) == 5


class Kept(io.BytesIO):
    def close(self):
        pass


@pytest.mark.parametrize("zip64", [False, True])
def test_own_writer(zip64):
    out = Kept()
    w = W.Writer(out, zip64)
    for name, data in (("a", b"hello"), ("dir/é", b"x" * 1000), ("empty", b"")):
        w.begin(name)
        w.write(data)
        w.end()
    w.close()
    raw = out.getvalue()
    p = W.Package(io.BytesIO(raw), len(raw))
    assert p.member("a") == b"hello" and p.range("dir/é", 10, 5) == b"xxxxx" and p.member("empty") == b""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.read("dir/é") == b"x" * 1000
    with pytest.raises(ValueError):
        p.range("a", 3, 5)


def test_foreign_zip_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"data")
        z.writestr("packed", b"y" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 inside and more than twenty-two bytes after it"
    raw = out.getvalue()
    p = W.Package(io.BytesIO(raw), len(raw))
    assert p.member("big") == b"data"
    with pytest.raises(ValueError):
        p.member("packed")
    for bad in (b"", b"no zip file", raw[:-5]):
        with pytest.raises(ValueError):
            W.Package(io.BytesIO(bad), len(bad))


def test_broken_records():
    good = W.record(1, "u", b"payload", "D", None)
    assert W.parse_record(good)[1] == b"payload"
    for bad in (good[:-6], b"HTTP/1.1\r\n\r\n", good + b"x"):
        with pytest.raises(ValueError):
            W.parse_record(bad)


def test_places():
    for uri in ("/a b/c", "file:/a b/c", "file:///a b/c"):
        assert W.open_fs(uri)[1] == "/a b/c"


def test_odd_urls(spark):
    urls = ["http://x/{id}", "http://x/a b?q={\"k\": 1}", "https://www.B.example:8080/é/ü?x=%7B", "", "{", "no url at all", "http://x/\u2003y\n", "a\tb", "\\", None]
    rows = [(i, u, f"<p>{i % 7}</p>") for i, u in enumerate(urls)]
    assert run(spark, rows) == plain(rows)
    assert W.sort_key("https://www.B.example:8080/é") == "example,b:8080)/é" and W.sort_key("http://a.example") == "example,a)/"
    assert all(len(f"{W.sort_key(u or '')} t {{}}".split(" ")) == 3 and "{" not in W.sort_key(u or "") for u in urls)


def test_revisits_name_their_response():
    first, second = W.record(9, "u", b"x", "D", None), W.record(2, "u", b"x", "D", 9)
    own, other = (W.parse_record(r)[0] for r in (first, second))
    assert other["warc-refers-to"] == own["warc-record-id"] and other["warc-refers-to-date"] == own["warc-date"]
