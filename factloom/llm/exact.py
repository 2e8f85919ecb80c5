"""Exact duplicates by a stored index of digests, bucketed and sorted, to which batches are added (operator 13)."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lookup, shared_dir

#: Digests that a bucket of an index made by `exact_dedup` holds, about.
BUCKET_ROWS = 2_000_000
#: What of a row decides which of equal texts stays: the smallest of these, in this order.
BEST = ("fewer", "no_id", "id", "batch_no", "row")


def normalized(text: F.Column) -> F.Column:
    """The text without blanks and the controls 9 to 13; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fewer, no_id, digest, row) of every row: SHA-256 of the normalized text, less the code points
    of the original one, and a number of the row. Written once, so that numbers stay."""
    t = F.col(f"`{text}`")
    narrow = docs.select(
        F.col(f"`{key}`").alias("id"), (-F.char_length(F.coalesce(t, F.lit(""))).cast("long")).alias("fewer"), F.col(f"`{key}`").isNull().alias("no_id"),
        F.unhex(F.sha2(normalized(t).cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"),
    )
    return checkpointed(narrow)


class DigestIndex:
    """A table of digests in a folder that outlives the session: a row for each digest and batch.

    The table is bucketed and sorted by digest and partitioned by batch, so that joining new data with it
    shuffles the new data alone, and adding a batch again replaces what it added before (a failed or
    repeated batch leaves no doubles). Of a digest the row with `fresh` is the one that came through the
    anti-join; later batches add their counts, and a better row if they have one. An open table keeps the
    number of buckets that it was made with.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, key_type: str = "bigint", name: str | None = None):
        self.spark, self.name = spark, name or f"digest_index_{re.sub('[^0-9a-z]', '_', folder.lower())[-80:]}"
        known = spark.catalog.tableExists(self.name)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, fewer BIGINT, no_id BOOLEAN, id {key_type}, batch_no INT, row BIGINT, n_rows BIGINT, fresh BOOLEAN, batch INT) "
            f"USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
        )
        self.folder, self.buckets = folder, buckets
        path, files = self._path(folder)
        if not known and files.exists(path):
            spark.sql(f"MSCK REPAIR TABLE {self.name}")  # batches that other sessions added

    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _others(self, batch: int) -> DataFrame:
        """Digests that batches other than this one brought in. Each stands once."""
        return self.table().where((F.col("batch") != batch) & F.col("fresh")).select("digest").hint("merge")

    def _best(self, rows: DataFrame, batch: int) -> DataFrame:
        """A row per digest of the batch, dealt as the table's buckets are. Tasks reduce before any exchange."""
        best = rows.withColumn("batch_no", F.lit(batch)).groupBy("digest").agg(F.min(F.struct(*BEST)).alias("best"), F.count("*").alias("n_rows"))
        return best.select("digest", "best.*", "n_rows").repartition(self.buckets, "digest")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Appends a batch of rows (as `digests` gives them): new digests by a sort-merge anti-join with
        what is stored, and the counts of known ones. What the batch added before goes first."""
        path, files = self._path(f"{self.folder.rstrip('/')}/batch={batch}")
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {batch})")
        files.delete(path, True)
        best, others = self._best(rows, batch), self._others(batch)
        new = best.join(others, "digest", "left_anti").withColumn("fresh", F.lit(True))
        old = best.join(others, "digest", "left_semi").withColumn("fresh", F.lit(False))
        both = new.unionByName(old).withColumn("batch", F.lit(batch)).select(*self.table().columns)
        both.write.mode("append").insertInto(self.name)

    def new_rows(self, rows: DataFrame, batch: int) -> DataFrame:
        """The best row of each digest of a batch that no other batch has brought in."""
        return self._best(rows, batch).join(self._others(batch), "digest", "left_anti").select("digest", "id", "row")

    def groups(self) -> DataFrame:
        """A row per digest: the row that stays among all batches, and how many rows have the text."""
        return self.table().groupBy("digest").agg(F.min(F.struct(*BEST)).alias("best"), F.sum("n_rows").alias("n_rows"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2, index: DigestIndex | None = None) -> DataFrame:
    """A row per document: key, keep_id, group_size, kept, text_sha256 (hex of the normalized text).

    Texts are equal if they are identical without blanks and the controls 9 to 13. Of equal texts the row
    with the most code points stays, of these the smallest key (a null key is the largest), of repeated
    rows one. The documents are added to an index in `batches` parts by a hash of the key, each
    deduplicated against those before; without `index` a new one is made in the shared folder. An index
    that is given should be empty: what it holds counts as further rows.

    Digests of over 64 rows (and over a 100,000th of all) are joined by broadcast, fewer than 100,000 of
    them; all others by sort-merge. A null text counts as empty, an empty table gives an empty result,
    other columns are ignored.
    """
    spark = docs.sparkSession
    rows = digests(docs, key, text).withColumn("batch_no", F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(batches)).cast("int"))
    total = rows.count()
    if index is None:
        folder = f"{shared_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}"
        index = DigestIndex(spark, folder, max(8, 1 << (total // BUCKET_ROWS).bit_length()), rows.schema["id"].dataType.simpleString())
    for batch in range(batches):
        index.add(rows.where(F.col("batch_no") == batch).drop("batch_no"), batch)
    found = lookup(rows, index.groups(), "digest", "n_rows", total)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("best")[c]) for c in BEST])
    return found.select(F.col("id").alias(key), F.col("best.id").alias("keep_id"), F.col("n_rows").alias("group_size"), same.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op13_exact_dedup(spark, sf_dir):
    """Which documents have equal texts but for white space, and which of them stay."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS turn, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, turn = 1 AS kept, text_sha256 FROM r
"""
