"""Times candidate_scores over facts made of order lines: uniform datasets or a hot one, with and without its bounds."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.pairing import candidate_scores


def facts_of(spark: SparkSession, sf_dir: str, n: int, hot: bool) -> DataFrame:
    """One fact per order line, the first `n` by a hash: the brand is the subject, the line number the predicate, the supplier
    the document, the region of the supplier the dataset (`hot`: one dataset for all)."""
    t = {x: spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("lineitem", "part", "supplier", "nation", "embeddings")}
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).limit(n)
    lines = lines.join(F.broadcast(t["part"].select(F.col("p_partkey").alias("l_partkey"), "p_brand")), "l_partkey").join(F.broadcast(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")), "l_suppkey")
    vectors = t["embeddings"].count()
    lines = lines.withColumn("vec_id", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(vectors))).join(t["embeddings"].select("vec_id", "embedding"), "vec_id")
    text = lambda *c: F.concat_ws(" ", *c)
    return lines.select(
        text("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), (F.lit("hot") if hot else text(F.col("s_nationkey"))).alias("dataset_id"), text("l_suppkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("page_number"),
        F.col("p_brand").alias("subject"), F.concat(F.lit("Metric "), F.col("l_linenumber").cast("string")).alias("predicate"), text("p_brand", "l_linenumber").alias("raw_claim"),
        F.lit("INR").alias("normalized_unit"), F.lit(None).cast("string").alias("unit"), "embedding",
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    sizes = [int(x) for x in sys.argv[1:]] or [10_000, 50_000, 100_000]
    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", work).config("spark.sql.warehouse.dir", f"{work}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    candidate_scores(facts_of(spark, sf_dir, 1000, False)).count()  # compiles
    for least in (0.65, 0.5):
        for n in sizes:
            for hot in (False, True):
                for prune in (True, False):
                    began = time.time()
                    pairs = candidate_scores(facts_of(spark, sf_dir, n, hot), least, prune=prune).count()
                    print(json.dumps({"facts": n, "hot": hot, "least": least, "bounds": prune, "pairs": pairs, "sec": round(time.time() - began, 1)}), flush=True)


if __name__ == "__main__":
    main()
