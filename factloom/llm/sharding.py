"""Uniform sharding with exact shard sizes (operator 8, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed
from .splitting import split_over_many

#: Rows of a partition, of which the communication matrix has one row, and of a run of slots.
PARTITION_ROWS, RUN_ROWS = 20_000, 20_000


def shuffle_into_shards(docs: DataFrame, n_shards: int, key: tuple[str, ...] = ("doc_id",), seed: int = 5) -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (gapless from 0 in each shard): a uniform shuffle.

    Rows fall into partitions by a hash of `key`. A splitting tree draws the communication matrix:
    how many rows each partition sends to each shard, given the partitions' row counts and shard
    sizes that differ by one at most, in levels of bounded arrays. Each partition permutes its rows and cuts them in those
    numbers; after the exchange each shard permutes again. A shard is permuted in runs (ranges of
    the random key) that are numbered one after the other, so no task holds a whole shard.

    Returns the columns of `docs` (which should be narrow, and checkpointed if costly: it is read
    three times), shard int and slot long; input columns of these names are replaced, others may have any name. Nulls hash
    like any value, equal rows are interchangeable, an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.struct(*[F.col(f"`{k}`") for k in key]).alias("by"))
    n = rows.count()
    n_parts = max(1, -(-n // PARTITION_ROWS))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "by"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(n_parts)))
    sizes = rows.groupBy(F.col("part").alias("leaf")).agg(F.count("*").alias("n"))
    counts = rows.sparkSession.range(1).select(F.expr(f"transform(sequence(0, {n_shards - 1}), i -> CAST(({n}L + i) DIV {n_shards} AS BIGINT))").alias("counts"))
    upto = "transform(sequence(1, size(counts)), i -> aggregate(slice(counts, 1, i), 0L, (x, y) -> x + y))"
    matrix = split_over_many(checkpointed(sizes), counts, n_parts, seed).select("leaf", F.expr(upto).alias("upto"))

    local = Window.partitionBy("part").orderBy("key", "by")
    rows = rows.withColumn("rank", F.row_number().over(local)).join(matrix, F.col("part") == F.col("leaf"))
    rows = rows.withColumn("shard", F.expr("CAST(size(filter(upto, x -> x < rank)) AS INT)"))
    rows = rows.withColumn("again", F.xxhash64(F.lit(seed + 2), "key", "shard"))
    n_runs = max(1, -(-n // (n_shards * RUN_ROWS)))
    rows = rows.withColumn("run", F.floor((F.shiftrightunsigned("again", 11) / F.lit(float(1 << 53))) * n_runs).cast("long"))
    rows = checkpointed(rows.select("row", "by", "again", "shard", "run"))
    runs = rows.groupBy(F.col("shard").alias("of_shard"), F.col("run").alias("of_run")).agg(F.count("*").alias("n"))
    runs = runs.withColumn("start", F.sum("n").over(Window.partitionBy("of_shard").orderBy("of_run")) - F.col("n"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "run").orderBy("again", "by")))
    rows = rows.join(runs, (F.col("shard") == F.col("of_shard")) & (F.col("run") == F.col("of_run")))
    return rows.select("row.*", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))


def op8_uniform_shards(spark, sf_dir):
    """All documents in 24 shards whose row counts differ by one at most."""
    text = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    done = shuffle_into_shards(checkpointed(docs), 24, ("doc_id", "text_crc32", "size"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
