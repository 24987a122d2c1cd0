"""Collections cut out in byte ranges against a JSON parser, files with two header rows, archives."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainage.sources import collections, files

PROPERTIES = T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())])
NAMES = ["plain", 'a "quoted" } name', "back\\slash", 'ends with \\"', "{[}]", '","features":[{"type":"Feature"', "line\nbreak", "é}ü{", "", None, "}" * 40, '"' * 30]


@pytest.fixture
def ranges(spark):
    """Byte ranges of some hundred bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def feature(name, i):
    geometry = {"type": "LineString", "coordinates": [[i, 0.5], [i + 1, 1.5]]} if i % 2 else {"type": "Point", "coordinates": [i, 2.5]}
    one = {"type": "Feature", "properties": {"name": name, "kind": "odd" if i % 2 else "even", "more": {"deep": [{"x": 1}]}}, "geometry": geometry}
    return dict(reversed(one.items())) if i % 3 == 0 else one


def points_of(f):
    c = f["geometry"]["coordinates"]
    return [tuple(p) for p in (c if f["geometry"]["type"] == "LineString" else [c])]


@pytest.mark.parametrize("indent", [None, 1])
def test_features_are_cut_out_of_one_file(spark, ranges, tmp_path, indent):
    found = [feature(n, i) for i, n in enumerate(NAMES * 3)]
    whole = {"note": 'a } "note" {', "meta": {"source": "x } y", "list": [{"features": [{}]}]}, "features": found, "crs": {"name": "z"}}
    for n in range(2):
        (tmp_path / f"{n}.geojson").write_text(json.dumps(whole, ensure_ascii=bool(n), indent=indent) + "\n" * n, encoding="utf-8")
    got = collections.members(spark, str(tmp_path)).orderBy("path", "seq").collect()
    assert collections.pieces(spark, str(tmp_path)).select("path", "block").distinct().count() > 10
    for path in {r.path for r in got}:
        own = [(r.member, json.loads(r.text)) for r in got if r.path == path]
        assert own == [("meta", whole["meta"]), *[("features", f) for f in found], ("crs", whole["crs"])]
    rows = files.read_features(spark, str(tmp_path), PROPERTIES).collect()
    assert sorted((str(r.name), r.kind, [tuple(p) for p in r.points]) for r in rows) == sorted((str(f["properties"]["name"]), f["properties"]["kind"], points_of(f)) for f in found * 2)
    assert files.read_features(spark, str(tmp_path), PROPERTIES, "odd").count() == len(found)
    assert {r.meta.source for r in collections.meta(spark, str(tmp_path), "source string").collect()} == {"x } y"}


@pytest.mark.parametrize("text", ['{"type":"FeatureCollection","features":[]}', "{}", "", '{"a":"}{"}', '{"features":[1,2]}', "[]"])
def test_documents_without_objects(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert collections.members(spark, str(tmp_path)).count() == 0
    assert files.read_features(spark, str(tmp_path), PROPERTIES).count() == 0


def test_a_long_string_of_escapes(spark, tmp_path):
    name = '\\"}{' * 50_000
    (tmp_path / "a.json").write_text(json.dumps({"note": name, "features": [feature(name, 1), feature(name, 2)]}))
    assert [r.name for r in files.read_features(spark, str(tmp_path), PROPERTIES).collect()] == [name] * 2


def test_collections_are_written_in_parts(spark, tmp_path):
    df = spark.createDataFrame([(n, "k", [(float(i), 1.0)] * (1 + i % 3)) for i, n in enumerate(NAMES)], "name string, kind string, points array<struct<lon double, lat double>>")
    files.write_collection(df.repartition(3), str(tmp_path / "out"), ["name", "kind"], {"source": 'a } "b"'})
    parts = [json.loads(p.read_text(encoding="utf-8")) for p in (tmp_path / "out").glob("*.txt")]
    assert all(p["meta"] == {"source": 'a } "b"'} for p in parts) and sum(len(p["features"]) for p in parts) == len(NAMES)
    back = files.read_features(spark, str(tmp_path / "out"), PROPERTIES)
    key = lambda r: (str(r.name), str(r.points))
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    files.write_collection(df.limit(0), str(tmp_path / "none"), ["name", "kind"], {})
    assert files.read_features(spark, str(tmp_path / "none"), PROPERTIES).count() == 0


def test_two_header_rows(spark, tmp_path):
    labels = ["nom; long", "valeur", 'dit "x"']
    df = spark.createDataFrame([("a;b", 1.5, 'say "hi"'), (None, None, "  blanks "), ("nom; long", 2.0, 'dit "x"'), ("é", -1.0, "z")], "name string, `the value` double, c string")
    files.write_labelled(df.repartition(2), str(tmp_path / "out"), labels)
    heads = [p.read_text(encoding="utf-8").split("\n")[:2] for p in (tmp_path / "out").glob("*.txt")]
    assert heads == [["﻿name;the value;c", '"nom; long";valeur;"dit ""x"""']] * 2
    back = files.read_labelled(spark, str(tmp_path / "out"), df.schema, labels)
    assert back.schema == df.schema and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError):
        files.write_labelled(df, str(tmp_path / "bad"), ["one"])


def test_archives_are_streamed(spark, tmp_path):
    lines = "".join(f"{i},\"name, {i}\"\n" for i in range(45_000))
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("other.txt", "x\n")
            if n:
                z.writestr("stops.txt", "﻿stop_id,stop_name\n" + lines)
    got = files.read_zipped_csv(spark, str(tmp_path), "stops.txt", ["stop_id", "stop_name", "absent"])
    assert got.agg(F.count("*"), F.count_distinct("stop_id"), F.count("absent")).first() == (90_000, 45_000, 0)
    assert got.where("stop_name <> concat('name, ', stop_id)").count() == 0


def test_one_range_is_worked_on_in_parts(spark, tmp_path, monkeypatch):
    """A task's share is bounded, however long the byte ranges are and however few shuffle partitions the session has."""
    monkeypatch.setattr(collections, "PIECES", 7)
    monkeypatch.setattr(collections, "CHARACTERS", 1000)
    found = [feature(n, i) for i, n in enumerate(NAMES * 3)]
    (tmp_path / "one.geojson").write_text(json.dumps({"meta": {"source": "x } y"}, "features": found}), encoding="utf-8")
    assert collections.pieces(spark, str(tmp_path)).select("path", "block").distinct().count() > 10
    out = collections.members(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= 6
    got = out.orderBy("path", "seq").collect()
    assert [(r.member, json.loads(r.text)) for r in got] == [("meta", {"source": "x } y"}), *[("features", f) for f in found]]
