"""Sources and sinks over real files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

from quire.sources import files


def test_bounded_files_and_roots(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/small.html").write_bytes(b"x" * 10)
    (tmp_path / "a/large.html").write_bytes(b"x" * 1000)
    found = files.bounded(spark, str(tmp_path), most=100)
    assert [r["bytes"] for r in found.collect()] == [10]
    assert files.under(found, [str(tmp_path / "a")]).count() == 1 and files.under(found, [str(tmp_path / "b")]).count() == 0


def test_strict_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id":"a","n":1}\n{"id":"b","other":1}\nnot json\n\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    assert sorted(str(r["error"]) for r in files.strict_json(spark, str(tmp_path / "x.json"), schema).collect()) == ["None", "input.json", "input.unknown_field"]


def test_bundles(spark, tmp_path):
    for name in ("one/index.md", "one/assets/a.png", "two/assets/b.png"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = {r["bundle"].rpartition("/")[2]: (r["files"], r["bytes"], r["error"]) for r in files.bundles(spark, str(tmp_path)).collect()}
    assert found == {"one": (2, 10, None), "two": (1, 5, "bundle.index")}


def test_settings(tmp_path):
    (tmp_path / "user.toml").write_text('timeout = "5s"\n')
    assert files.settings(str(tmp_path / "user.toml"), None, {"PAGE_ARCHIVE_VIEWPORT": "1x1", "HOME": "/"}) == [("user", "timeout", "5s"), ("env", "viewport", "1x1")]
    with pytest.raises(ValueError):
        files.settings(environment={"PAGE_ARCHIVE_NOPE": "1"})


def test_sink_takes_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "artifacts")
    table = lambda *rows: spark.createDataFrame(list(rows), "name string, body binary")
    there = lambda: {r["name"]: bytes(r["body"]) for r in files.saved_artifacts(spark, folder).collect()}
    assert there() == {}
    files.save_artifacts(table(("a.html", b"1"), ("d/b.html", b"2")), folder)
    more = table(("c.html", b"3"), ("a.html", b"4"))
    with pytest.raises(ValueError, match="in the way"):
        files.save_artifacts(more, folder)
    assert there() == {"a.html": b"1", "d/b.html": b"2"}
    files.save_artifacts(more, folder, "replace")
    assert there() == {"a.html": b"4", "d/b.html": b"2", "c.html": b"3"}
    files.save_artifacts(table(("a.html", b"5"), ("a.html", b"6"), ("e", b"7")), folder, "uniquify")
    found = there()
    assert found.keys() == {"a.html", "d/b.html", "c.html", "a-1.html", "a-2.html", "e"} and {found["a-1.html"], found["a-2.html"]} == {b"5", b"6"} and found["a.html"] == b"4"
    for rows in (table(("../x", b"")), table(("x", b"1"), ("x", b"2"))):
        with pytest.raises(ValueError):
            files.save_artifacts(rows, folder)
    assert {r["digest"] for r in files.saved_artifacts(spark, folder).where("name = 'e'").collect()} == {"7902699be42c8a8e46fbbb4501726517e86b22c56a189f7625a6da49081b2451"}
