"""Batches of facts and evidence count in both tables or in neither, once, whatever is killed or repeated."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from factloom.operators import extraction as E
from factloom.operators import facts as O
from factloom.sources import tables as S

SCHEMA = "id string, dataset_id string, document_id string, page_number int, raw_claim string, quote string, page_id string, chunk_id string, start int, end int, confidence double, metadata map<string,string>"


def batch(spark, *ids, dataset="007"):
    return spark.createDataFrame([(i, dataset, "d", 2, f"claim {i}", f"quote {i}", "p", None, 3, 9, 0.5, {"pdf_page_number": "2"}) for i in ids], SCHEMA)


def held(spark, folder):
    facts, evidence = S.stored(spark, folder, "facts"), S.stored(spark, folder, "evidence")
    if facts is None:
        return None
    return sorted(r.id for r in facts.collect()), sorted(r.fact_id for r in evidence.collect())


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    folder = str(tmp_path)
    assert held(spark, folder) is None
    one = batch(spark, "a", "b")
    assert [tuple(r) for r in S.append_facts_evidence(one, folder).collect()] == [("007", 2, 2)]
    assert [tuple(r) for r in S.append_facts_evidence(one, folder).collect()] == [("007", 2, 2)]
    S.append_facts_evidence(batch(spark, "c", dataset="1e5"), folder, "second")
    S.append_facts_evidence(batch(spark, "c", "z"), folder, "second")  # the name is taken
    assert held(spark, folder) == (["a", "b", "c"], ["a", "b", "c"])
    assert [r.id for r in S.stored(spark, folder, "facts", dataset="1e5").collect()] == ["c"] and S.stored(spark, folder, "facts").schema["dataset_id"].dataType.simpleString() == "string"
    assert S.append_facts_evidence(batch(spark), folder, "empty").count() == 0


@pytest.mark.parametrize("dies_before", ["facts", "evidence", "commit"])
def test_a_crash_leaves_no_half(spark, tmp_path, monkeypatch, dies_before):
    folder, write, commit = str(tmp_path), S._write, S._commit
    S.append_facts_evidence(batch(spark, "old"), folder, "0")

    def broken(table, path, *rest):
        if path.endswith(dies_before):
            raise RuntimeError("killed")
        write(table, path, *rest)

    def no_commit(*a):
        raise RuntimeError("killed")

    monkeypatch.setattr(S, "_write", broken)
    monkeypatch.setattr(S, "_commit", no_commit if dies_before == "commit" else commit)
    with pytest.raises(RuntimeError):
        S.append_facts_evidence(batch(spark, "a", "b"), folder, "1")
    assert held(spark, folder) == (["old"], ["old"])
    monkeypatch.undo()
    S.append_facts_evidence(batch(spark, "a", "b"), folder, "1")
    assert held(spark, folder) == (["a", "b", "old"], ["a", "b", "old"])
    assert S.vacuum(spark, folder) == {"facts": 0, "evidence": 1, "commit": 2}[dies_before]
    assert held(spark, folder) == (["a", "b", "old"], ["a", "b", "old"]) and S.vacuum(spark, folder) == 0


def test_a_killed_process_leaves_no_half(spark, tmp_path):
    folder = str(tmp_path / "store")
    code = f"""
import os, sys
sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
from factloom.sources import tables as S
from test_store import batch
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
write = S._write
def killed(table, path, *rest):
    write(table, path, *rest)
    if path.endswith("facts"):
        os._exit(9)
S._write = killed
S.append_facts_evidence(batch(spark, "a"), {folder!r}, "1")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), env=os.environ | {"PYTHONPATH": os.path.dirname(__file__)}, capture_output=True, timeout=300)
    assert done.returncode == 9
    assert os.path.isdir(f"{folder}/facts") and held(spark, folder) is None
    S.append_facts_evidence(batch(spark, "a"), folder, "1")
    assert held(spark, folder) == (["a"], ["a"])


def test_of_two_attempts_the_first_commit_counts(spark, tmp_path):
    folder = str(tmp_path)
    assert S._commit(spark, folder, "x/y z", "one", 1, 1) and not S._commit(spark, folder, "x/y z", "two", 1, 1)
    assert [tuple(r) for r in S.commits(spark, folder).collect()] == [("x/y z", "one", 1, 1)]


def test_the_library_reads_what_it_stores(spark, tmp_path):
    folder = str(tmp_path)
    S.append_facts_evidence(batch(spark, "a", "b"), folder, now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    facts, evidence = S.stored(spark, folder, "facts"), S.stored(spark, folder, "evidence")
    assert {tuple(r) for r in O.first_evidence(evidence).select("fact_id", "quote", "evidence_page").collect()} == {("a", "quote a", 2), ("b", "quote b", 2)}
    assert [r.violations for r in O.validate_evidence(evidence).collect()] == [[], []]
    assert {(r.id, r.quote, len(r.evidence)) for r in O.facts_with_evidence(facts, evidence).collect()} == {("a", "quote a", 1), ("b", "quote b", 1)}
    row = evidence.where("fact_id = 'a'").first()
    assert (row.document_id, row.start_offset, row.end_offset, row.extraction_confidence, row.metadata) == ("d", 3, 9, 0.5, {"pdf_page_number": "2"})


def test_documents_end_in_the_store(spark, tmp_path):
    folder = str(tmp_path)
    pages = spark.createDataFrame([("s", "d", "p1", 1, "Revenue was Rs. 5 crore in FY24.")], "dataset_id string, document_id string, page_id string, page_number int, text string")
    item = lambda claim, quote: f'{{"subject": "s", "predicate": "p", "raw_claim": "{claim}", "quote": "{quote}", "value_boolean": true, "geography": "India"}}'
    answers = lambda *items: spark.createDataFrame([("d/0", f'{{"facts": [{", ".join(items)}]}}')], "batch_id string, answer string")
    none = spark.createDataFrame([], "document_id string, raw_claim string, quote string")
    run = lambda a, name: [tuple(r) for r in E.process_documents(pages, a, {"facts": none}, folder=folder, batch=name)["appended"].collect()]
    one = answers(item("one", "Revenue was"), item("two", "in FY24"), item("  ", "crore"))
    assert run(one, "1") == [("s", 2, 2)] and run(one, "1") == [("s", 2, 2)]
    assert run(answers(item("ONE", "Rs. 5"), item("three", "FY24.")), "2") == [("s", 1, 1)]  # stored claims count
    facts = {r.raw_claim: r for r in S.stored(spark, folder, "facts").collect()}
    assert sorted(facts) == ["one", "three", "two"] and (facts["one"].value_boolean, facts["one"].geography, facts["one"].fact_type, facts["one"].status, facts["one"].confidence) == (True, "India", "NUMERICAL", "actual", 0.9)
    assert O.first_evidence(S.stored(spark, folder, "evidence")).count() == 3
