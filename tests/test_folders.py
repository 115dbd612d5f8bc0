"""Folders of annotations and edges, and what a filter on the page opens."""

import json
import os

import pytest

from docflow.sources import folders


@pytest.fixture
def pushed(spark):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    yield
    spark.conf.set(key, before)


def test_edges(spark, tmp_path):
    (tmp_path / "p 1%2F.txt").write_text("#1->#2\nno edge\n #2->#3 \n#x->#1\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.json").write_text("[]")
    got = sorted(tuple(r) for r in folders.edge_folder(spark, str(tmp_path)).collect())
    assert got == [("p 1/", 0, 1, 2), ("p 1/", 2, 2, 3)]
    assert folders.edge_folder(spark, str(tmp_path / "none")).count() == 0


def test_elements(spark, tmp_path):
    box = {"xc": 1, "yc": 2.5, "w": "x", "h": True}
    (tmp_path / "a.json").write_text(json.dumps([{"doc_id": "d", "id": 1, "bbox": box, "type": "p", "text": "é", "fontsize": 9, "more": 1}, 5, {"id": 2.5, "bbox": [], "text": {"a": 1}}]))
    (tmp_path / "b.json").write_text('{"id": 7}')
    (tmp_path / "c.json").write_text("[{")
    got = {(r["page"], r["ord"]): r for r in folders.element_folder(spark, str(tmp_path)).collect()}
    one = got["a", 0]
    assert (one["doc_id"], one["id"], tuple(one["bbox"]), one["type"], one["text"], one["fontsize"]) == ("d", 1, (1.0, 2.5, None, None), "p", "é", 9.0)
    assert (got["a", 2]["id"], got["a", 2]["bbox"], got["a", 2]["text"]) == (None, None, '{"a": 1}')
    assert got["b", 0]["id"] == 7 and got["c", None]["error"].startswith("JSONDecodeError") and len(got) == 4


def test_filters_open_only_what_they_ask_for(spark, tmp_path, pushed):
    for i in range(40):
        (tmp_path / f"p{i}.txt").write_text(f"#{i}->#{i + 1}\n" * 2)
    os.chmod(tmp_path / "p39.txt", 0)
    (tmp_path / "p38.txt").unlink()
    (tmp_path / "p38.txt").mkdir()
    read = folders.edge_folder(spark, str(tmp_path))
    for condition, want in (("page = 'p3'", [3]), ("page in ('p5', 'p7', 'none') and parent_id > 5", [7]), ("page like 'p1%'", [1, *range(10, 20)]), ("page = 'p3' and page = 'p4'", []), ("page in ('p1', 'p12') and page like 'p12%'", [12])):
        found = read.where(condition)
        assert sorted(r["parent_id"] for r in found.collect()) == sorted(want * 2)
    # a filtered reader lists what is asked for and no more
    reader = folders.FilteredFolder(str(tmp_path), "txt")
    assert list(reader.pushFilters([folders.EqualTo(("page",), "p3"), folders.EqualTo(("ord",), 0)])) == [folders.EqualTo(("ord",), 0)]
    assert [p.names for p in reader.partitions()] == [["p3.txt"]]


def test_files_are_dealt_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "SHARE", 1000)
    monkeypatch.setattr(folders, "LEAST", 100)
    for i in range(30):
        (tmp_path / f"{i:02d}.txt").write_text("x" * (2000 if i == 5 else 10))
    sizes = [len(p.names) for p in folders.Folder(str(tmp_path), "txt").partitions()]
    assert sum(sizes) == 30 and max(sizes) == 10 and len(sizes) == 4
