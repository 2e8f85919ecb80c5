"""What a run over larger tables found."""

import os

from pyspark.sql import functions as F

from factloom.functions import matching as M
from factloom.functions import normalize as N
from factloom.operators import compare as C
from factloom.operators import extraction as E
from factloom.operators import facts as O
from factloom.operators import pairing
from factloom.operators import pairs as P
from factloom.operators import text as X
from factloom.plans import fixtures
from factloom.plans import registry
from factloom.sources import tables as S


def test_a_batch_of_many_datasets_takes_few_files(spark, tmp_path):
    folder = str(tmp_path)
    facts = spark.range(2000, numPartitions=8).select(F.col("id").cast("string"), F.concat(F.lit("set "), F.col("id") % 400).alias("dataset_id"), F.lit("d").alias("document_id"), F.lit("q").alias("quote"))
    assert S.append_facts_evidence(facts, folder, "1").count() == 400
    files = [f for _, _, names in os.walk(f"{folder}/facts") for f in names if f.endswith(".parquet")]
    assert len(files) <= S.SLOTS + 8
    assert sorted(int(r.id) for r in S.stored(spark, folder, "facts", dataset="set 7").collect()) == [7, 407, 807, 1207, 1607]


def test_halves_round_as_in_sql(spark):
    x = spark.createDataFrame([(0.9249999999999999,), (1.4749999999999999,), (-0.9249999999999999,), (0.9244,), (2.0,)], "x double")
    assert [r[0] for r in x.select(C.hundredths(F.col("x"))).collect()] == [0.93, 1.48, -0.93, 0.92, 2.0]


def test_numbers_follow_ids_over_many_ranges(spark):
    ids = spark.range(5000, numPartitions=5).select(F.md5(F.col("id").cast("string")).alias("id"))
    numbered = fixtures._numbered(ids)
    assert "Window [row_number" not in numbered._jdf.queryExecution().toString()
    assert [(r.id, r.n) for r in numbered.orderBy("id").collect()] == [(x, n) for n, x in enumerate(sorted(r.id for r in ids.collect()))]
    assert fixtures._numbered(ids.limit(0)).count() == 0


def test_a_query_derives_totals_once(spark):
    made = {}
    fixtures.frame(spark, "/root/testdata/sf0.001", "fx_edges", made)
    assert "lineitem" not in made["fx_edges"]._jdf.queryExecution().optimizedPlan().toString()


def test_cosines_are_those_of_the_column_function(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, None])], "id long, embedding array<double>")
    queries = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    want = queries.crossJoin(rows).select("query_id", "id", F.round(M.cosine_similarity(F.col("query"), F.col("embedding")), 4).alias("similarity"))
    for part in (2, 2048):
        got = P.cosines(queries, rows, part)
        assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_candidates_are_the_same_in_parts_of_any_size(spark):
    facts = spark.range(60).select(
        F.concat(F.lit("f"), "id").alias("id"), F.lit("s").alias("dataset_id"), (F.col("id") % 7).cast("string").alias("document_id"), F.lit(None).cast("int").alias("page_number"), F.lit("brand").alias("subject"),
        F.concat(F.lit("metric "), F.col("id") % 3).alias("predicate"), F.concat(F.lit("claim "), F.col("id") % 5).alias("raw_claim"), F.lit(None).cast("string").alias("normalized_unit"), F.lit(None).cast("string").alias("unit"),
        F.when(F.col("id") % 4 > 0, F.array(F.cos("id"), F.sin("id"))).alias("embedding"),
    )
    queries = facts.where("id IN ('f1', 'f8', 'f20', 'f33')")
    pairs = P.candidate_scores(facts, 0.45)
    sides = pairs.selectExpr("fact_a_id q", "fact_b_id id", "score").unionByName(pairs.selectExpr("fact_b_id q", "fact_a_id id", "score")).where("q IN ('f1', 'f8', 'f20', 'f33')")
    want = {}
    for r in sorted(sides.collect(), key=lambda r: (r.q, -r.score, r.id)):
        want.setdefault(r.q, []).append((r.id, r.score))
    for part in (3, 4096):
        found = P.candidates_for_fact(queries, facts, 5, 0.45, part=part)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.id, r.score))
        assert got == {q: x[:5] for q, x in want.items()}


def test_no_page_is_copied_for_each_of_its_chunks(spark):
    pages = spark.createDataFrame([("p", "intro words here and the quote stands on the page")], "page_id string, page_text string")
    chunks = spark.createDataFrame([("b", 1, "c1", "p", "intro words"), ("b", 2, "c2", "p", "here and")], "batch_id string, at int, chunk_id string, page_id string, chunk_text string")
    items = spark.createDataFrame([("b", 0, "chunk_2", "the quote"), ("b", 1, None, "intro  words"), ("b", 2, None, "quote stands"), ("b", 3, None, "nowhere"), ("b", 4, "c1", "")], "batch_id string, position int, label string, quote string")
    got = E.grounded_items(items, chunks, pages)
    full = chunks.join(pages, "page_id")
    want = X.ground_facts(E.chunk_of_fact(items, full)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert not {"page_text", "chunk_text"} & set(got.columns)


def test_order_lines_and_facts_of_pairs_move_once(spark):
    made = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pairs = registry._table(spark, "/root/testdata/sf0.001", "pairs", made)
    for df in (pairs, fixtures.frame(spark, "/root/testdata/sf0.001", "fx_edges", made)):
        assert plan(df).count("Exchange hashpartitioning") == plan(df).count("REPARTITION_BY_NUM") == 2  # totals only, once a side
        assert "SortMergeJoin" not in plan(df)


def test_blanks_are_those_of_the_pattern(spark):
    one = spark.range(0x3100).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    t = one.select(F.explode(F.array("c", F.concat("c", F.lit("a b"), "c", F.lit("x"), "c", F.lit(" \n")))).alias("t"))
    assert t.where(~N.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).isEmpty()


def test_a_block_keeps_its_best_pairs_and_facts_move_once(spark, monkeypatch):
    facts = spark.range(90).select(
        F.concat(F.lit("f"), F.col("id") % 80).alias("id"), F.lit("s").alias("dataset_id"), F.col("id").cast("string").alias("document_id"), F.lit(None).cast("int").alias("page_number"), F.lit("brand").alias("subject"),
        F.concat(F.lit("metric "), F.col("id") % 3).alias("predicate"), F.lit("claim").alias("raw_claim"), F.lit(None).cast("string").alias("normalized_unit"), F.lit(None).cast("string").alias("unit"),
        F.when(F.col("id") % 6 > 0, F.array(F.cos("id"), F.sin("id")).cast("array<float>")).alias("embedding"),
    )
    assert P.candidate_scores(facts, 0.3).schema["score"].dataType.simpleString() == "double"
    plain = lambda df: sorted((r.fact_a_id, r.fact_b_id, r.score) for r in df.collect())
    doubles = facts.withColumn("embedding", F.col("embedding").cast("array<double>"))
    want = plain(P.candidate_scores(doubles, 0.3))
    assert plain(P.candidate_scores(facts, 0.3)) == want and all(a < b for a, b, _ in want)
    tops = [plain(P.max_candidates(P.candidate_scores(facts, 0.3, tile=20, block=8, most=n), n)) for n in (1, 7)]
    best = sorted(want, key=lambda r: (-r[2], r[0], r[1]))
    assert tops == [sorted(best[:1]), sorted(best[:7])]
    assert pairing.measured(facts).schema["embedding"].dataType.simpleString() == "array<float>"
    moved = lambda: P.candidate_scores(facts, 0.3)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = moved()
        monkeypatch.setattr(pairing, "FEW", 0)
        assert few < moved() and plain(P.candidate_scores(facts, 0.3)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tiles_end_with_datasets_and_angles_stay(spark):
    facts = spark.range(90).select(
        F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"), F.concat(F.lit("s"), F.floor(F.col("id") / 30)).alias("dataset_id"), F.col("id").cast("string").alias("document_id"), F.lit(None).cast("int").alias("page_number"),
        F.lit("brand").alias("subject"), F.lit("metric").alias("predicate"), F.lit("claim").alias("raw_claim"), F.lit(None).cast("string").alias("normalized_unit"), F.lit(None).cast("string").alias("unit"), F.array(F.cos("id"), F.sin("id")).alias("embedding"),
    )
    tiles = pairing.tiles_of(facts.coalesce(1), 40)
    assert "angles" not in tiles.columns and tiles.where("embedding IS NULL").isEmpty()
    spread = tiles.groupBy("dataset_id").agg(F.count_distinct("tile").alias("n"), F.count_distinct(F.shiftright("place", 33)).alias("ranges")).collect()
    assert len(spread) == 3 and all(r.n == r.ranges for r in spread)  # a tile for each range that holds some of a dataset


def test_an_upsert_gives_its_changes_alone(spark):
    old = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, "y", 2.0), ("b", 1, "z", 3.0)], "k string, n int, id string, v double")
    new = spark.createDataFrame([("a", 2, "new", None), ("c", 1, "new", 5.0), ("c", 1, "new", 6.0), ("a", None, "new", 7.0)], "k string, n int, id string, v double")
    full = O.upsert(old, new, ["k", "n"], ["id"])
    want = sorted(map(str, full.where("id IN ('new', 'y')").collect()))
    for few in (0, 100):
        got = O.upsert(old, new, ["k", "n"], ["id"], changed=True, few=few)
        assert got.columns == full.columns and sorted(map(str, got.collect())) == want and len(want) == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = lambda few: O.upsert(old, new, ["k", "n"], ["id"], changed=True, few=few)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert moved(100) < moved(0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chosen_pairs_join_their_facts_alone(spark):
    facts = spark.range(60).select(
        F.concat(F.lit("f"), "id").alias("id"), F.lit("s").alias("dataset_id"), F.col("id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.lit("brand").alias("subject"), F.lit("metric").alias("predicate"),
        F.concat(F.lit("claim "), F.col("id") % 5).alias("raw_claim"), F.lit(None).cast("string").alias("normalized_unit"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("date").alias("period_end"),
        F.lit(None).cast("string").alias("period_text"), F.lit("NUMERICAL").alias("fact_type"), F.array(F.cos("id"), F.sin("id")).alias("embedding"),
    )
    best = P.max_candidates(P.candidate_scores(facts, 0.45), 4)
    got = P.candidate_pairs(facts, 0.45, most=4)
    assert {(r.fact_a_id, r.fact_b_id, r.score) for r in got.collect()} == {(r.fact_a_id, r.fact_b_id, r.score) for r in best.collect()}
    assert all(r.a.id == r.fact_a_id and r.b.id == r.fact_b_id for r in got.collect())
    assert "Range (0, 60" not in got._jdf.queryExecution().optimizedPlan().toString()  # facts of chosen pairs are kept


def test_evidence_moves_the_start_of_a_text(spark):
    sf = "/root/testdata/sf0.001"
    made = {}
    got = fixtures.frame(spark, sf, "fx_evidence", made)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(text" in plan.split("Window")[-1]  # below the numbering of pages
    want = fixtures._recipe(spark, sf, "fx_evidence", made)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_prepared_pairs_are_the_joined_ones(spark):
    sf, made = "/root/testdata/sf0.001", {}
    want = registry._table(spark, sf, "pairs", made)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    a, b = F.col("a"), F.col("b")
    for name, rules in (
        ("pairs for rules", lambda x, y: {"r": M.rule_relationship(x, y)}), ("pairs for the audit", lambda x, y: M.investigate(x, y, F.col("relationship_type"))), ("pairs for flags", lambda x, y: M.pair_flags(x, y)),
    ):
        got = registry._table(spark, sf, name, made)
        assert plan(got).count("Exchange hashpartitioning") == 1 and "Join" not in plan(got).split("ObjectHashAggregate")[0]  # facts are made once
        shown = lambda df, x, y: sorted(map(str, df.select("fact_a_id", "fact_b_id", "relationship_type", "confidence", "edge_created", *[c.cast("string").alias(k) for k, c in rules(x, y).items()]).collect()))  # noqa: E731, B023
        assert shown(got, M.Prepared("a"), M.Prepared("b")) == shown(want, a, b)
    both = {c: F.array(F.cos(F.col(f"{c}.bn")), F.sin(F.col(f"{c}.bn")), F.lit(1.0)) for c in "ab"}
    held = want.select(*[F.struct(F.col(f"{c}.*"), both[c].alias("embedding")).alias(c) for c in "ab"])
    ready = held.select("a", "b", *[F.struct(F.col(f"{c}.*"), F.struct(*[M.TRAITS[t](F.col(c)).alias(t) for t in registry.PREPARED["pairs for scores"][1]]).alias("traits")).alias(f"p{c}") for c in "ab"])
    assert ready.where(M.hybrid_score(a, b) != M.hybrid_score(M.Prepared("pa"), M.Prepared("pb"))).isEmpty()


def test_an_answer_is_read_once(spark):
    answers = spark.createDataFrame([("a", "b", 'x {"relationship_type": "RELATED", "confidence": "0.5", "reason": "r"} y'), ("a", "c", '{"relationship_type": "RELATED", "confidence": "2", "reason": "r"}'), ("a", "d", None), ("a", "e", "none"), ("a", "f", '{"relationship_type": "RELATED", "confidence": "0.5"}')], "fact_a_id string, fact_b_id string, answer string")
    got = P.parse_verdicts(answers)
    assert [tuple(r) for r in got.collect()] == [("a", "b", "RELATED", 0.5, "r", None)]
    assert all(line.count("from_json") <= 1 or "Generate" in line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert "Filter" not in got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_facts_meet_a_selection_where_they_lie(spark):
    facts = spark.range(40).selectExpr("concat('f', id) AS id", "concat('d', id % 4) AS document_id", "concat('s', floor(id / 4)) AS subject", "'p' AS predicate", "'c' AS raw_claim", "CAST(id AS double) AS value_numeric", "current_timestamp() AS created_at")
    selection = spark.range(4).selectExpr("concat('c', id % 2) AS comparison_id", "CAST(1 + floor(id / 2) AS int) AS ordinal", "concat('d', id) AS document_id", "concat(id, '.pdf') AS filename")
    summary = lambda few: C.comparison_summary(C.compare_documents(facts, selection, few=few))
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(document_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(summary(100)) == 0 < moved(summary(0))
        assert sorted(map(tuple, summary(100).collect())) == sorted(map(tuple, summary(0).collect())) == [("c0", 10, 10, 0, 0, 0, 0, 0), ("c1", 10, 10, 0, 0, 0, 0, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
