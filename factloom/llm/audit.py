"""How filters interact: what each would remove at each place of every order (operator 12)."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, checkpointed, hot_limit, lookup

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (1, 2, 4, 8): under 200 words; under half of them
    distinct; over 2 % capitals; any of # $ % & * |."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    size = F.char_length(text).cast("long")
    capitals = size - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * size, text.rlike(r"[#$%&*|]"))
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def fold(mask: Column, n: Column, good: Column, toxic: Column, orders: Column) -> Column:
    """A cell's 600 structs: its rows weigh n in each count of each step of each order."""

    def step(state: Column, bit: Column) -> Column:
        fails, gone, seen = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(state["seen"]) != 0, state["seen"].bitwiseOR(bit)
        removed = fails & ~gone
        weigh = lambda condition, weight: F.when(condition, weight).otherwise(F.lit(0).cast("long"))
        counts = (weigh(mask.bitwiseAND(seen) == 0, n), weigh(removed, n), weigh(fails & gone, n), weigh(mask == bit, n), weigh(removed, good), weigh(removed, toxic))
        return F.struct(seen.alias("seen"), F.concat(state["steps"], F.array(F.struct(*[c.alias(k) for c, k in zip(counts, COUNTS, strict=True)]))).alias("steps"))

    start = F.struct(F.lit(0).alias("seen"), F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>").alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["steps"])))


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per part (a source; null counts as empty), filter_order and step with the counts of COUNTS and shapley.

    A document is a mask of five bits; E is set if its text is identical to that of a smaller key, whatever
    else befalls that one. Rows are reduced to cells of (part, mask), at most 32 a part, and each part's
    cells are folded over the literal array of all orders into 600 structs, merged by elementwise sums.
    shapley adds up what the step's filter removes over all 120 orders.

    A null text counts as empty, so all of these are identical. A null key is the largest and finds no
    label; rows of equal key and text do not make each other fail E. Of repeated labels any 1 counts. An
    empty table gives an empty result, other columns are ignored. Texts and keys of many rows are joined
    by broadcast (`lookup`).
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"), failures(t).alias("mask"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"))
    rows = checkpointed(rows)
    total = rows.count()
    firsts = checkpointed(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n_rows")).where("n_rows > 1"))
    rows = lookup(rows, firsts, "digest", "n_rows", total).select("id", "part", "mask", F.coalesce(F.col("id") > F.col("first"), F.col("first").isNotNull()).alias("again"))
    rows = checkpointed(rows.select("id", "part", (F.col("mask") + F.when(F.col("again"), 16).otherwise(0)).alias("mask")))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0).cast("long"))
    flags = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    often = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > hot_limit(total)) if total > HOT_ROWS else None
    rows = lookup(rows, flags, "id", "n_rows", total, hot=often)
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0).cast("long")).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0).cast("long")).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32

    orders = F.lit([[1 << LETTERS.index(x) for x in order] for order in ORDERS])
    letters = F.lit([LETTERS.index(x) for order in ORDERS for x in order])
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(LETTERS))
    merge = lambda x, y: F.zip_with(x, y, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS]))
    folded = parts.select("part", F.aggregate("cells", zero, lambda acc, c: merge(acc, fold(c["mask"], c["n"], c["good"], c["toxic"], orders))).alias("steps"))
    removed = F.zip_with("steps", letters, lambda s, x: F.struct(s["removed"].alias("removed"), x.alias("letter")))
    share = lambda i: F.aggregate(removed, F.lit(0).cast("long"), lambda acc, s: acc + F.when(s["letter"] == i, s["removed"]).otherwise(F.lit(0).cast("long")))
    folded = folded.withColumn("shares", F.array(*[share(i) for i in range(len(LETTERS))]))
    out = folded.select("part", "shares", F.posexplode("steps").alias("at", "counts"))
    order = F.get(F.lit(ORDERS), F.floor(F.col("at") / len(LETTERS)).cast("int"))
    return out.select("part", order.alias("filter_order"), (F.col("at") % len(LETTERS) + 1).cast("int").alias("step"), "counts.*", F.get("shares", F.get(letters, F.col("at"))).alias("shapley"))


def op12_filter_audit(spark, sf_dir):
    """What five filters remove in each order, by source."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x))::INT + 8 * regexp_matches(x, '[#$%&*|]')::INT
        + 16 * (doc_id > min(doc_id) OVER (PARTITION BY x))::INT AS mask FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
a AS (SELECT unnest([{'x': 'A', 'b': 1}, {'x': 'B', 'b': 2}, {'x': 'C', 'b': 4}, {'x': 'D', 'b': 8}, {'x': 'E', 'b': 16}], recursive := true)),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM a, a AS b, a AS c, a AS d, a AS e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, i::INT AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM p, range(1, 6) AS r(i)),
o AS (SELECT part, filter_order, step, any_value(bit) AS bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM o
"""
