"""Sources of items, whole documents, streams, cards and formats on small tables."""

import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import matching as M
from factloom.operators import extraction as E
from factloom.operators import facts as O
from factloom.operators import text as X
from factloom.sources.files import scan_files
from factloom.sources.tables import rewritten, settled
from factloom.streaming.ingest import chunk_stream


@pytest.mark.parametrize(
    ("label", "quote", "want"),
    [("Chunk_2", "x", 2), (" chunk 1 ", "x", 1), ("2", None, 2), ("UUID-B", "", 2), (None, "beta  gamma", 2), (None, "beta gamma", 2), ("chunk_7", "alpha", 1), (None, "only page", 1), (None, "nowhere", None), (None, "", None)],
)
def test_source_of_an_item(spark, label, quote, want):
    chunks = spark.createDataFrame([("b", 1, "uuid-a", "p", "alpha", "alpha only\npage"), ("b", 2, "uuid-b", "p", "beta  gamma", "alpha only\npage")], "batch_id string, at int, chunk_id string, page_id string, chunk_text string, page_text string")
    items = spark.createDataFrame([("b", 0, label, quote)], "batch_id string, position int, label string, quote string")
    row = E.chunk_of_fact(items, chunks).first()
    assert row["at"] == want


def test_items_without_a_batch_are_kept_without_a_source(spark):
    chunks = spark.createDataFrame([], "batch_id string, at int, chunk_id string, page_id string, chunk_text string, page_text string")
    items = spark.createDataFrame([("b", 0, "1", "q")], "batch_id string, position int, label string, quote string")
    assert E.chunk_of_fact(items, chunks).first()["chunk_id"] is None


def test_whole_documents(spark):
    pages = spark.createDataFrame([("d/1", "p1", 1, "Revenue was Rs. 5 crore in FY24."), ("d/1", "p2", 2, "  "), ("d/1", "p3", 3, "Volume grew.")], "document_id string, page_id string, page_number int, text string")
    fact = lambda claim, quote: f'{{"subject": "s", "predicate": "p", "raw_claim": "{claim}", "quote": "{quote}", "raw_value_text": "Rs. 5 crore"}}'
    answer = f'```json\n{{"facts": [{fact("one", "Revenue was")}, {fact("ONE ", "in FY24")}, {fact("two", "made up")}, {fact("three", "Volume grew")}]}}\n```'
    answers = spark.createDataFrame([("d/1/0", answer)], "batch_id string, answer string")
    stored = spark.createDataFrame([("d/1", "Three", "other")], "document_id string, raw_claim string, quote string")
    runs = spark.createDataFrame([("r", "d/1", "PROCESSING", 1), ("q", "d/2", "PROCESSING", 1)], "id string, document_id string, status string, facts_extracted int")
    known = spark.createDataFrame([("old", "p1", 0, "before")], "id string, page_id string, chunk_index int, text string")
    out = E.process_documents(pages, answers, {"facts": stored, "runs": runs, "chunks": known}, embedder=lambda texts: [[float(len(t))] for t in texts])
    row = out["facts"].collect()
    assert [r["raw_claim"] for r in row] == ["one"] and row[0]["normalized_value_numeric"] == 5e7
    assert row[0]["metadata"]["pdf_page_number"] == "1" and row[0]["metadata"]["chunk_id"] == "p1/0"
    assert out["counts"].first()[2:] == (3, 1)
    assert {r["id"]: r["text"] for r in out["chunks"].collect()} == {"old": "Revenue was Rs. 5 crore in FY24.", "p3/0": "Volume grew."}
    assert {r["id"]: (r["status"], r["chunks_created"], r["facts_extracted"], r["facts_rejected"]) for r in out["runs"].collect()} == {"r": ("COMPLETED", 2, 2, 1), "q": ("PROCESSING", 0, 1, 0)}
    again = E.process_documents(pages, answers, {"facts": stored, "extracted": pages.where("page_number < 3").select("page_id")}, most=1)
    assert [r["page_id"] for r in again["chunks"].collect()] == ["p3"]


def test_stream_of_pages(spark, tmp_path):
    spark.createDataFrame([("d", "p1", "one two"), ("d", "p2", None)], "document_id string, page_id string, text string").write.parquet(str(tmp_path / "in"))
    seen = []
    chunk_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda b: seen.extend(b.collect())).awaitTermination(60)
    assert [(r["page_id"], r["text"]) for r in seen] == [("p1", "one two")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"x")
    files = X.validate_files(scan_files(spark, str(tmp_path)))
    assert [(r["filename"], r["length"], r["problem"]) for r in files.collect()] == [("a.pdf", 6, None)]


def test_cards_and_formats(spark):
    f = F.lit
    text = lambda x, y, kind="CONTRADICTS": M.card_variance(f(x).cast("double"), f(y).cast("double"), f(kind))
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(text(100, 110), text(-100, -110), text(0, 0), text(1000, 1001), text(None, 1), text(1, 2, "RELATED"), text(0, 3)) == ("+10.0% variance", "-10.0% variance", "Exact match (~0% variance)", "Exact match (~0% variance)", None, None, None)
    assert one(X.format_bytes(f(0)), X.format_bytes(f(1023)), X.format_bytes(f(1024)), X.format_bytes(f(1536)), X.format_bytes(f(5 << 30)), X.format_confidence(f(0.955)), X.format_confidence(f(None).cast("double"))) == ("0 B", "1023 B", "1 KB", "1.5 KB", "5 GB", "96%", "—")


def test_updates_keep_other_rows(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    out = O.update_columns(stored, spark.createDataFrame([(2, None), (3, "c"), (4, "d")], "id int, v string"), "id", ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, None), (3, "c")]


def test_what_is_stored_leaves_nothing_shuffled_behind(spark):
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {str(x) for x in store.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    for keep in (settled, rewritten):
        there, df = shuffled(), spark.range(1000).repartition(3, "id")
        assert keep(df).count() == 1000
        until = time.time() + 20
        while len(new := {x.split("/shuffle_")[1].split("_")[0] for x in shuffled() - there}) > 1 and time.time() < until:
            time.sleep(0.2)
        assert len(new) <= 1, keep  # that of the count
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_texts_of_pages_are_dealt_once(spark):
    own = "document_id string, page_id string, page_number int"
    pages = spark.createDataFrame([("d", "p1", 1, "one two"), ("d", "p2", 2, "x"), (None, None, 3, "no id"), (None, "p4", 4, "y")], f"{own}, text string")
    counts = spark.createDataFrame([("d", "p1", 1, 1), ("d", "p2", 2, 1), (None, "p4", 4, 1)], f"{own}, chunks int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = E.with_before(E.with_before(pages, counts).drop("before"), counts)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning(coalesce(page_id" in x for x in plan.splitlines()) == 1
    assert sorted((r.page_id, r.before) for r in dealt.collect()) == [("p1", 0), ("p2", 1), ("p4", 0)]
    assert [(r.page_id, r.batch_id, r["at"]) for r in E.batched_chunks(pages).orderBy("page_id").collect()] == [("p1", "d/0", 1), ("p2", "d/0", 2), ("p4", "0", 2)]  # a page without an id is counted, but has no chunks
