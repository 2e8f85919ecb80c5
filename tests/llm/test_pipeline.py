"""Each stage of corpus_pipeline against a plain version, on a table with odd rows and columns."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as stages
from factloom.llm import quality
from test_brute_force import WORDS, jaccard_by_hand, near_copies


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{i % 3}" if i % 9 else None, 0) for i, (k, t) in enumerate(near_copies())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"rep": F.lit(1), "a.b": F.lit("x"), "row": F.lit(2), "copies": F.lit(9)})


def test_rules_keep_what_they_judge_good(spark, docs):
    kept = stages.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    judged = quality.judge(docs.withColumn("doc_id", F.xxhash64("doc_id", "text", "source"))).where("kept")
    got = Counter(kept.select(F.xxhash64("doc_id", "text", "source").alias("k")).toPandas().k)
    assert got == Counter(judged.toPandas().doc_id)


def test_one_of_each_group_of_near_copies_stays(spark, docs):
    got = stages.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    rows = near_copies()
    want = Counter((k, t) for k, t, _, n in jaccard_by_hand(rows) if not n)
    found = Counter((r.doc_id, r.text) for r in got.collect())
    classes = {c for _, _, c, n in jaccard_by_hand(rows) if n}
    linked = found - want
    assert not want - found and sum(linked.values()) == len(linked)
    assert sum(linked.values()) == 10 + 2 - sum(1 for _, _, c, n in jaccard_by_hand(rows[:1]) if not n) and {k for k, _ in linked} <= classes
    assert {(1005, rows[-8][1])} & set(found) == set() and found[1001, rows[-10][1]] == 1 and found[1002, rows[-9][1]] == 1


def test_repeated_passages_go(spark, docs):
    got = stages.repeated_passages(spark, docs, "")
    assert got.columns == docs.columns
    for r in got.collect():
        assert r.text is None or r["a.b"] == "x"
    words = sum(len(WORDS.findall(r.text or "")) for r in got.collect())
    assert words < sum(len(WORDS.findall(t or "")) for _, t in near_copies()) / 4


def test_mix_takes_what_the_operator_says(spark, docs):
    from factloom.llm.mixing import mix_sources

    plain = docs.drop("copies")
    got = Counter((r.doc_id, r.text) for r in stages.source_mix(spark, docs, "").collect())
    want = Counter()
    for r in mix_sources(plain).collect():
        want[r.doc_id, r.text] += r.copies
    near = lambda c: sum(len(WORDS.findall(t or "")) * n for (_, t), n in c.items())
    assert abs(near(got) - near(want)) <= 0.02 * near(want) and stages.source_mix(spark, docs, "").columns == docs.columns


def test_all_pieces_are_packed(spark, docs):
    got = stages.packed_sequences(spark, docs, "").toPandas()
    assert len(got) >= docs.count() and got.groupby("sequence_id").length.sum().max() <= 2048


def test_whole_pipeline(spark, tmp_path):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 3000, 150))
    rows = [(i, text(), "en", f"s{i % 2}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(20)] + [(200, "too short", "en", "s1", 1), (201, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in stages.run(spark, str(tmp_path)).collect()}
    assert got <= set(range(60)) and len(got) > 50
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert stages.run(spark, str(tmp_path / "none")).count() == 0
