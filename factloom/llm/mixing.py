"""Mixing sources to target weights with exact block quotas (operator 1, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed
from .splitting import split_over_many

#: Documents that a block holds on average, over all sources, and words of a shard (at least 16 shards).
BLOCK_ROWS, SHARD_WORDS = 512, 20_000_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, get the weights in turn. `share` of all sizes is dealt out by
    weight; a target stops at `most` times its source's size and what is over goes to the others by
    weight. With the sources ordered by most * size / weight, the level (rest of the total over rest
    of the weights, once the first j are full) rises as long as sources are above their limit and
    falls after, so its maximum over j is what repeated resharing converges to.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("full", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("full") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / rest)
    s = s.withColumn("target", F.least("full", F.col("weight") * F.max("level").over(everything)))
    return s.select("source", "source_size", "target")


def running(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` before each row among rows of equal `by`, ordered by a hash and what
    makes it unique. Sums over 1024 ranges of the hash are run first, so that no task orders them all.
    """
    key, *more = order.split(", ")
    rows = rows.withColumn("__range", F.shiftright(key, 54))
    ranges = rows.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__of")).agg(F.sum(value).alias("__n"))
    ranges = ranges.withColumn("__base", F.sum("__n").over(Window.partitionBy("__by").orderBy("__of")) - F.col("__n")).drop("__n")
    inside = F.sum(value).over(Window.partitionBy(by, "__range").orderBy(key, *more)) - F.col(value)
    rows = rows.withColumn("__inside", inside).join(ranges, (F.col(by) == F.col("__by")) & (F.col("__range") == F.col("__of")))
    return rows.withColumn(name, F.col("__base") + F.col("__inside")).drop("__range", "__by", "__of", "__base", "__inside")


def mix_sources(docs: DataFrame, source: str = "source", size: Column | None = None, key: tuple[str, ...] = ("doc_id",), text: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, n_shards: int | None = None, seed: int = 11) -> DataFrame:
    """How often the mix takes each document, and into which output shards.

    A source's documents fall into random blocks by a hash of `key` and size, its blocks in a random
    order on a tape that repeats. Its quota is the blocks of the tape, whole turns and then the first
    ones once more, that reach its target. A splitting tree draws how many blocks of each source each
    of `n_shards` equal shards gets (by default one for SHARD_WORDS words of the input, 16 at least),
    and each shard draws that many from the permuted quota, disjoint from those of other shards. What
    the shards drew of a block is how often it is taken. The last block of a quota is cut between
    documents, and the gap that stays goes to the document that comes nearest to it, so a source ends
    close to its target. Within a shard, rows ordered by `shuffle_key` are a random order.

    Returns the columns of `docs` and mix_size, source_size, target, copies (0 to `most`), shards
    (array<int>, one per copy), shuffle_key. Input columns of these names are replaced; others may have
    any name. Null and empty texts have size 0 and may be taken at no cost; a null source is a source of
    its own; repeated rows count as separate documents, of which equal ones are interchangeable; an empty
    table gives an empty result. Windows hold a block's documents or a range of a source's blocks; only
    the sources themselves (thousands at most) are ordered and counted in one row.
    """
    ours = ("mix_size", "source_size", "target", "copies", "shards", "shuffle_key")
    column = lambda c: F.col(f"`{c}`")
    kept = [c for c in docs.columns if c not in ours]
    rows = docs.select(
        F.struct(*[column(c) for c in kept]).alias("row"), column(source).alias("of"), F.struct(*[column(k) for k in key]).alias("key"),
        (word_count(column(text)) if size is None else size).alias("mix_size"),
    )
    n_blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    rows = rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "key", "mix_size"))
    # One key without nulls, so that the windows and the join below share one exchange of the rows.
    cell = lambda s, b: F.concat(F.coalesce(F.concat(F.lit("s"), F.col(s).cast("string")), F.lit("null")), F.lit(" "), F.col(b).cast("string"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "shuffle_key"), F.lit(n_blocks))).withColumn("cell", cell("of", "block"))

    blocks = checkpointed(rows.groupBy(F.col("of").alias("source"), "block").agg(F.sum("mix_size").alias("words")))
    goals = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goals = goals.withColumn("colour", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    goals = goals.withColumn("turns", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("over", F.col("target") - F.col("turns") * F.col("source_size"))
    b = blocks.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    b = b.withColumn("tape", F.xxhash64(F.lit(seed + 2), "source", "block"))
    b = running(b, "colour", "tape, block", "words", "start")
    b = checkpointed(b.withColumn("quota", F.col("turns") + F.when(F.col("start") < F.col("over"), 1).otherwise(0)))

    # The tree: how many blocks of each source each shard gets; then each draws its places of the permuted quota.
    quotas = b.groupBy("colour").agg(F.sum("quota").alias("quota"))
    root = quotas.groupBy().agg(F.expr("transform(array_sort(collect_list(struct(colour, quota))), x -> x.quota)").alias("counts"), F.sum("quota").alias("total"))
    words, total = b.agg(F.sum("words"), F.sum("quota")).first()
    n_shards = n_shards or max(16, -(-(words or 0) // SHARD_WORDS))
    sizes = docs.sparkSession.range(n_shards).select(F.col("id").alias("leaf"), F.expr(f"({total or 0}L + id) DIV {n_shards}").alias("n")).where("n > 0")
    ranges = split_over_many(sizes, root.where("total > 0").select("counts"), n_shards, seed).select("leaf", F.posexplode("counts").alias("colour", "n"))
    past = Window.partitionBy("colour").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("low", F.coalesce(F.sum("n").over(past), F.lit(0))).where("n > 0")
    places = ranges.select(F.col("colour").cast("long").alias("colour"), F.col("leaf").cast("int").alias("shard"), F.explode(F.expr("sequence(low, low + n - 1)")).alias("place"))
    tickets = b.where("quota > 0").select("block", "colour", F.explode(F.expr("sequence(1L, quota)")).alias("copy"), F.lit(1).alias("one"))
    tickets = running(tickets.withColumn("draw", F.xxhash64(F.lit(seed + 3), "colour", "block", "copy")), "colour", "draw, block, copy", "one", "place")
    drawn = tickets.join(places, ["colour", "place"]).groupBy("colour", "block").agg(F.expr("transform(array_sort(collect_list(struct(copy, shard))), x -> x.shard)").alias("drawn"))
    b = b.join(drawn, ["colour", "block"], "left").withColumn("drawn", F.coalesce("drawn", F.array().cast("array<int>")))
    plan = checkpointed(b.select(cell("source", "block").alias("cell"), "source_size", "target", "turns", (F.size("drawn") > F.col("turns")).alias("again"), (F.col("over") - F.col("start")).alias("rest"), "drawn"))

    inside = Window.partitionBy("cell").orderBy("shuffle_key", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.drop("of", "block").withColumn("upto", F.sum("mix_size").over(inside)).join(plan, "cell")
    rows = rows.withColumn("fits", F.col("again") & (F.col("upto") <= F.col("rest")))
    block = Window.partitionBy("cell")
    rows = rows.withColumn("gap", F.col("rest") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(block), F.lit(0)))
    by_gap = block.orderBy("fits", F.abs(F.col("mix_size") - F.col("gap")), "shuffle_key", "key")
    fills = (F.row_number().over(by_gap) == 1) & (F.abs(F.col("mix_size") - F.col("gap")) < F.col("gap"))
    rows = rows.withColumn("copies", (F.col("turns") + (F.col("fits") | (F.col("again") & fills)).cast("long")).cast("int"))
    rows = rows.withColumn("shards", F.slice("drawn", 1, F.col("copies")))
    return rows.select("row.*", *ours)


def laid_out(mixed: DataFrame, seed: int = 13) -> DataFrame:
    """The documents of a mix as often as it takes them, laid out by shard: each shard's rows stand in
    runs (ranges of a random key drawn for each copy) in random order, a run in one partition."""
    copies = mixed.where("copies > 0").select("*", F.posexplode("shards").alias("copy", "shard"))
    copies = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "shuffle_key", "copy", "shard"))
    return copies.repartition("shard", F.shiftright("shuffle_key", 58)).sortWithinPartitions("shard", "shuffle_key")


def op1_source_mix(spark, sf_dir):
    """Words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = checkpointed(docs)
    mixed = mix_sources(docs, size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", F.array_join("shards", ",").alias("shards"))
