"""Stored tables, listings, neighbours and classification where nulls, ties and repeated keys matter."""

import datetime

from pyspark.sql import functions as F

from factloom.functions import matching as M
from factloom.operators import facts as O
from factloom.operators import pairs as P
from factloom.operators import text as X
from factloom.sources.tables import append_facts_evidence, stored


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_takes_nulls_and_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 1, "i1"), (4, "d", 4, "i4")], "k int, v string, w int, id string")
    new = spark.createDataFrame([(1, None, 2, "x"), (2, None, 3, "i2"), (3, "c", 1, "i3"), (3, "e", 5, "i3")], "k int, v string, w int, id string")
    assert rows(O.upsert(old, new, ["k"], ["id"], latest="w")) == [(1, None, 2, "i1"), (2, None, 3, "i2"), (3, "e", 5, "i3"), (4, "d", 4, "i4")]
    assert O.upsert(old, new, ["k"], ["id"]).count() == 4


def test_period_bounds_stay(spark):
    day = datetime.date(2020, 1, 1)
    f = spark.createDataFrame([("FY24", day, None), ("FY24", None, None)], "period_text string, period_start date, period_end date")
    f = f.withColumns({"value_numeric": F.lit(1.0), "raw_value_text": F.lit("1"), "unit": F.lit(None).cast("string")})
    got = O.normalize_facts(f).select("period_start", "period_end").collect()
    assert [tuple(r) for r in got] == [(day, datetime.date(2024, 3, 31)), (datetime.date(2023, 4, 1), datetime.date(2024, 3, 31))]


def test_equal_distances_go_by_id(spark):
    v = [1.0, 2.0]
    table = spark.createDataFrame([(i, v) for i in range(100, 40, -1)] + [(5, [1.0]), (6, None)], "id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, v)], "query_id long, query array<double>")
    assert [r["id"] for r in P.similar_vectors(table, queries, 3).orderBy("rank").collect()] == [41, 42, 43]


def test_nearest_facts_are_of_other_documents_of_the_dataset(spark):
    v = [1.0, 0.0]
    f = spark.createDataFrame([("a", "s", "d1", v), ("b", "s", "d1", v), ("c", "s", "d2", v), ("d", "t", "d2", v), ("e", "s", "d3", [0.0, 1.0])], "id string, dataset_id string, document_id string, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in P.nearest_facts(f, f.where("id = 'a'"), 5).collect()] == [("a", "c")]


def test_context_of_a_query_without_hits(spark):
    hits = spark.createDataFrame([(1, 7, 0.25, 1)], "query_id int, id int, distance double, rank int")
    texts, queries = spark.createDataFrame([(7, "seven")], "id int, text string"), spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r["query_id"]: r["context"] for r in X.rag_context(hits, texts, queries).collect()}
    assert got == {1: "[Source 1] (7, 0.750)\nseven", 2: "No relevant document chunks found."}


def test_choice_of_pages(spark):
    pages = spark.createDataFrame([("d", f"p{i}", i) for i in range(1, 6)], "document_id string, page_id string, page_number int")
    seen = pages.where("page_number < 3").select("page_id")
    ids = lambda *a, **k: sorted(r["page_id"] for r in X.select_pages(pages, *a, **k).collect())
    assert ids(seen) == ["p3", "p4", "p5"] and ids(seen, 1) == ["p3"] and ids(pages.select("page_id"), 2) == ["p1", "p2"]
    assert ids(seen, offset=3) == ["p4", "p5"] and ids(seen, 1, offset=3) == ["p4"] and ids(seen, 1, numbers=[1, 5]) == ["p1", "p5"]


def test_appended_tables(spark, tmp_path):
    f = spark.createDataFrame([("f1", "s", "q1", 0), ("f2", "t", "q2", 3)], "id string, dataset_id string, quote string, start int")
    assert rows(append_facts_evidence(f, str(tmp_path))) == [("s", 1, 1), ("t", 1, 1)]
    append_facts_evidence(f.withColumn("id", F.concat("id", F.lit("b"))), str(tmp_path))
    assert rows(stored(spark, str(tmp_path), "evidence").select("fact_id", "quote", "start_offset")) == [("f1", "q1", 0), ("f1b", "q1", 0), ("f2", "q2", 3), ("f2b", "q2", 3)]
    assert stored(spark, str(tmp_path), "facts").columns == ["id", "dataset_id", "created_at"]


def test_deleted_chunks_leave_evidence(spark):
    table = lambda data, schema: spark.createDataFrame(data, schema)
    tables = {
        "filings": table([("d1", "s"), ("d2", "t")], "id string, dataset_id string"), "facts": table([("f1", "s", "d1"), ("f2", "t", "d2")], "id string, dataset_id string, document_id string"),
        "evidence": table([("f1", "c1"), ("f2", "c1"), ("f2", "c2")], "fact_id string, chunk_id string"), "chunks": table([("c1", "d1"), ("c2", "d2")], "id string, document_id string"),
    }
    rest = O.delete_dataset("s", tables)
    assert rows(rest["evidence"]) == [("f2", "c2"), ("f2", None)] and rows(rest["chunks"]) == [("c2", "d2")] and rows(rest["facts"].select("id")) == [("f2",)]


def test_signals_of_a_fact(spark):
    f = spark.createDataFrame([("x" * 30, 3, "FY24", "INR", "standalone", 5.0, {"extraction_warning": "cut off"})], "quote string, page_number int, period_text string, unit string, scope string, value_numeric double, metadata map<string,string>")
    f = f.withColumns({"normalized_value_numeric": F.lit(None).cast("double"), "normalized_unit": F.lit(None).cast("string"), "raw_value_text": F.lit("5"), "raw_claim": F.lit("c")})
    r = O.fact_confidence(f).first()
    assert (r["score"], r["level"], r["positive_count"], r["negative_count"]) == (90, "HIGH", 6, 1)
    assert r["signals"][-1].asDict() == {"signal": "table", "impact": -15, "status": "fail", "description": "cut off"}


def test_verdicts_are_validated_and_pairs_ordered(spark):
    answers = spark.createDataFrame([("a", "b", '```{"relationship_type": "RELATED", "confidence": "0.7", "reason": "r"}```'), ("a", "c", '{"relationship_type": "OTHER", "confidence": 0.7, "reason": "r"}'), ("a", "d", '{"relationship_type": "RELATED", "confidence": 2, "reason": "r"}'), ("a", "e", "no")], "fact_a_id string, fact_b_id string, answer string")
    assert rows(P.parse_verdicts(answers).drop("verdict_factors")) == [("a", "b", "RELATED", 0.7, "r")]
    fact = "struct<id:string,dataset_id:string,document_id:string,page_number:int,subject:string,predicate:string,raw_claim:string,raw_value_text:string,value_numeric:double,normalized_value_numeric:double,unit:string,normalized_unit:string,fact_type:string,period_text:string,period_start:date,period_end:date,scope:string,status:string>"
    one = lambda i, n: (i, "s", i, 1, "Sales", "revenue", "c", str(n), float(n), float(n), None, "INR", "NUMERICAL", "FY24", None, None, None, None)
    pair = spark.createDataFrame([("z", "b", one("z", 100), one("b", 150))], f"fact_a_id string, fact_b_id string, a {fact}, b {fact}")
    r = P.classify_pairs(pair).first()
    assert (r["fact_a_id"], r["fact_b_id"], r["a"]["id"], r["relationship_type"]) == ("b", "z", "b", "CONTRADICTS") and "33.33 %" in r["reason"]
    found = M.investigate(F.col("a"), F.col("b"), F.lit(None).cast("string"))
    seen = pair.select(*[c.alias(k) for k, c in found.items()]).first()
    assert seen["verdict_type"] == "TRUE_CONTRADICTION" and "+50.00 %" in seen["explanation"] and seen["review_required"]


def test_best_pairs_are_those_of_all_pairs(spark):
    data = [(f"f{i:03}", "s", f"d{i % 7}", i % 3, f"subject {i % 5}", f"metric {i % 4}", f"claim {i}", [float(i % 11), 1.0, float(i % 3)] if i % 6 else None) for i in range(120)]
    f = spark.createDataFrame(data, "id string, dataset_id string, document_id string, page_number int, subject string, predicate string, raw_claim string, embedding array<double>")
    f = f.withColumns({"normalized_unit": F.lit(None).cast("string"), "unit": F.lit(None).cast("string")})
    whole = P.candidate_scores(f, 0.3)
    want = rows(P.max_candidates(whole, 9).drop("vector_similarity"))
    assert rows(P.max_candidates(P.candidate_scores(f, 0.3, tile=30, block=16, most=9), 9).drop("vector_similarity")) == want and len(want) == 9
    assert rows(P.candidate_scores(f, 0.3, tile=30, block=7).select("fact_a_id", "fact_b_id", "score")) == rows(whole.select("fact_a_id", "fact_b_id", "score"))
