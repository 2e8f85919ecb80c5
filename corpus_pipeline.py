"""A training corpus from `documents`: quality rules, near duplicates, repeated passages, mix, packing.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, shared_dir, unzipped, zipped
from factloom.llm.jaccard import jaccard_join
from factloom.llm.mixing import laid_out, mix_sources, word_count
from factloom.llm.packing import pack_documents
from factloom.llm.quality import keep_good
from factloom.llm.substrings import substring_dedup

#: SQL cannot express robust estimates, tokens or a packing; tests hold each stage against its operator.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the robust outlier test keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 reach: the smallest by doc_id,
    then by a hash of the text.

    Documents that link with nothing and rows without a doc_id stay. A doc_id that stands on several
    rows names none of them: only the rows whose text links go. Of rows with equal doc_id and text
    that link with each other or with others, one stays at most.
    """
    found = checkpointed(jaccard_join(docs))
    gone = found.where("NOT kept").select("doc_id", "text_hash").distinct()
    again = found.where("kept AND n_links > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    rows = zipped(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("others")), "text")
    rows = rows.join(gone, ["doc_id", "text_hash"], "left_anti")
    if not again.isEmpty():  # each task keeps one row of a group before any exchange
        twice = rows.join(again.drop("n_rows"), ["doc_id", "text_hash"], "left_semi")
        one = twice.groupBy("doc_id", "text_hash").agg(F.first(F.struct("text", "others")).alias("row")).select("doc_id", "row.text", "text_hash", "row.others")
        rows = rows.join(again.drop("n_rows"), ["doc_id", "text_hash"], "left_anti").unionByName(one)
    rows = unzipped(rows, "text")
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word passages that stand in a document with a smaller doc_id.

    A text that loses nothing stays as it is; of others the kept words are joined by blanks and
    n_chars is set anew. Documents of which no word is left go.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    wide = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))
    cut = substring_dedup(wide, carry=("others",), keep_text=True)
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    columns = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col("others")[c] for c in others}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them (repeats are repeated rows), in the shards that drew
    them and in random order there. Null sources and texts count as mix_sources says."""
    narrow = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), word_count(F.col("text")).alias("words"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return laid_out(mix_sources(narrow, source="of", size=F.col("words"), key=("id",))).select("doc.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them is Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
