"""Merges and deletes of stored tables touch the slots of their keys alone and keep ids, also when two writers meet."""

import glob

import pytest

from factloom.sources.keyed import KeyedTable

SCHEMA = "page_id string, chunk_index int, id string, text string"


def chunks(spark, *rows):
    return spark.createDataFrame([(p, i, f"{p}-{i}-{t}", t) for p, i, t in rows], SCHEMA)


def table(spark, tmp_path, slots=8):
    return KeyedTable(spark, str(tmp_path / "t"), ["page_id", "chunk_index"], slots)


def content(t):
    return {(r.page_id, r.chunk_index): (r.id, r.text) for r in t.rows().collect()}


def test_merge_keeps_ids_and_other_slots(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.rows() is None
    first = chunks(spark, *[(f"p{i}", 0, "old") for i in range(200)])
    assert t.merge(first, ["id"]) == list(range(8))
    before = set(glob.glob(f"{tmp_path}/t/data/*/*/*.parquet"))
    change = chunks(spark, ("p3", 0, "new"), ("p3", 1, "more"), ("p3", 1, "most"))
    slots = t.merge(change, ["id"])
    assert 1 <= len(slots) <= 2
    written = set(glob.glob(f"{tmp_path}/t/data/*/*/*.parquet")) - before
    assert {int(f.split("slot=")[1].split("/")[0]) for f in written} <= set(slots)
    want = {(f"p{i}", 0): (f"p{i}-0-old", "old") for i in range(200)} | {("p3", 0): ("p3-0-old", "new"), ("p3", 1): ("p3-1-most", "most")}
    assert content(t) == want
    t.merge(change, ["id"])  # again
    assert content(t) == want and content(KeyedTable(spark, t.folder, ["page_id", "chunk_index"], 99)) == want
    assert t.vacuum() > 0 and content(t) == want and t.vacuum() == 0


def test_only_touched_slots_are_read(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(chunks(spark, *[(f"p{i}", 0, "x") for i in range(100)]))
    number, last = t._last()
    files = t._read(last, [2]).inputFiles()
    assert files and all("slot=2/" in f for f in files)


def test_delete(spark, tmp_path):
    t = table(spark, tmp_path, 4)
    t.merge(chunks(spark, ("a", 0, "x"), ("b", 0, "y"), ("c", 0, "z")))
    t.delete(chunks(spark, ("a", 0, ""), ("nowhere", 1, "")))
    assert sorted(content(t)) == [("b", 0), ("c", 0)]
    t.delete(chunks(spark, ("b", 0, ""), ("c", 0, "")))
    assert t.rows() is None or t.rows().count() == 0
    t.merge(chunks(spark, ("b", 0, "again")))
    assert content(t) == {("b", 0): ("b-0-again", "again")}


def test_a_faster_writer_is_not_overwritten(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path, 2), table(spark, tmp_path, 2)
    t.merge(chunks(spark, ("a", 0, "1")))
    commit, once = t._commit, []

    def late(number, content_):
        if not once:
            once.append(1)
            other.merge(chunks(spark, ("a", 1, "other")))
        return commit(number, content_)

    monkeypatch.setattr(t, "_commit", late)
    t.merge(chunks(spark, ("a", 0, "2")), ["id"])
    assert content(t) == {("a", 0): ("a-0-1", "2"), ("a", 1): ("a-1-other", "other")}


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, 2)
    t.merge(chunks(spark, ("a", 0, "1")))
    monkeypatch.setattr(t, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        t.merge(chunks(spark, ("a", 0, "2")))
    assert content(table(spark, tmp_path)) == {("a", 0): ("a-0-1", "1")}
