"""Multivariate hypergeometric splitting trees in SQL, for exact random counts."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Leaves that one row's arrays hold: a tree with more is split in levels of so many branches.
FAN = 256


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(total: str, good: str, drawn: str, uniform: str) -> str:
    """SQL for one draw: how many of `good` among `total` items are in a random `drawn` of them.

    The draw inverts the distribution over the values within 12 standard deviations (and 12 more)
    of the mode; what is beyond weighs less than 1e-30. Successive weights follow from their ratio,
    so no factorials are needed and the work grows with the standard deviation alone.
    """
    ratio = "CAST(h.good - k AS DOUBLE) * (h.drawn - k) / (CAST(k + 1 AS DOUBLE) * greatest(h.total - h.good - h.drawn + k + 1, 1))"
    spread = "12 + CAST(12 * sqrt(CAST(h.drawn AS DOUBLE) * h.good / greatest(h.total, 1) * (1 - CAST(h.good AS DOUBLE) / greatest(h.total, 1)) * (h.total - h.drawn) / greatest(h.total - 1, 1)) AS BIGINT)"
    mode = "CAST(floor((h.drawn + 1.0D) * (h.good + 1.0D) / (h.total + 2.0D)) AS BIGINT)"
    low = f"greatest(0L, h.drawn - (h.total - h.good), {mode} - ({spread}))"
    high = f"least(h.good, h.drawn, {mode} + ({spread}))"
    sum_all = f"aggregate(sequence(w.low, w.high), named_struct('p', 1.0D, 'sum', 0.0D), (s, k) -> named_struct('p', s.p * {ratio}, 'sum', s.sum + s.p), s -> s.sum)"
    walk = f"aggregate(sequence(w.low, w.high), named_struct('p', 1.0D, 'left', goal, 'k', w.low), (s, k) -> named_struct('p', s.p * {ratio}, 'left', s.left - s.p, 'k', CASE WHEN s.left > 0 THEN k ELSE s.k END), s -> s.k)"
    return _let("h", f"named_struct('total', {total}, 'good', {good}, 'drawn', {drawn})", _let("w", f"named_struct('low', {low}, 'high', greatest({low}, {high}))", _let("goal", f"({uniform}) * {sum_all}", walk)))


def split_counts(roots: DataFrame, n_leaves: int, seed: int) -> DataFrame:
    """Deals the items of every colour out to leaves of given sizes, as a uniform shuffle would.

    `roots` has for each `root` (long) `sizes` (array<long>, one of up to n_leaves leaves each) and
    `counts` (array<long>, one per colour) with equal sums. Returns (root, leaf, counts): sums over a
    root's leaves give its colours' counts, and the sum of each leaf its size, exactly. Each level
    halves every range of leaves and draws what its left half gets of each colour, given what is left
    of the others.
    """
    uniform = f"(CAST(shiftrightunsigned(xxhash64({seed}L, root, leaf, CAST(size(sizes) AS BIGINT), s.i), 11) AS DOUBLE) + 0.5D) / 9007199254740992.0D"
    draw = hypergeometric("s.total", "c", "s.drawn", uniform)
    after = "named_struct('total', s.total - c, 'drawn', s.drawn - g, 'i', s.i + 1, 'got', concat(s.got, array(g)))"
    dealt = (
        "aggregate(counts, named_struct('total', aggregate(sizes, 0L, (x, y) -> x + y), 'drawn', aggregate(slice(sizes, 1, half), 0L, (x, y) -> x + y), 'i', 0L, 'got', CAST(array() AS ARRAY<BIGINT>)),"
        f" (s, c) -> {_let('g', draw, after)}, s -> s.got)"
    )
    nodes = roots.select("root", F.lit(0).cast("long").alias("leaf"), "sizes", "counts")
    for _ in range(ceil(log2(n_leaves)) if n_leaves > 1 else 0):
        nodes = nodes.withColumn("half", F.expr("CAST((size(sizes) + 1) DIV 2 AS INT)"))
        nodes = nodes.withColumn("got", F.expr(f"CASE WHEN size(sizes) > 1 THEN {dealt} END"))
        halves = """CASE WHEN size(sizes) <= 1 THEN array(named_struct('leaf', leaf, 'sizes', sizes, 'counts', counts))
            ELSE array(named_struct('leaf', leaf, 'sizes', slice(sizes, 1, half), 'counts', got),
                named_struct('leaf', leaf + half, 'sizes', slice(sizes, half + 1, size(sizes)), 'counts', zip_with(counts, got, (x, y) -> x - y))) END"""
        nodes = nodes.select("root", F.explode(F.expr(halves)).alias("n")).select("root", "n.*")
    return nodes.select("root", "leaf", "counts")


def split_over_many(sizes: DataFrame, counts: DataFrame, n_leaves: int, seed: int) -> DataFrame:
    """`split_counts` of one root over any number of leaves: (leaf, counts).

    sizes: (leaf from 0, n), one row per leaf that holds something; counts: one row with the array of
    the colours' counts. Leaves are grouped FAN to a branch, branches FAN to the next, so no row holds
    more than FAN sizes and every level but the first is spread over tasks; a level draws what its
    branches get and hands it down.
    """
    levels = max(1, ceil(log2(max(2, n_leaves)) / log2(FAN)))
    nodes = counts.select(F.lit(0).cast("long").alias("root"), "counts")
    for level in range(levels - 1, -1, -1):
        width = FAN**level
        branches = sizes.groupBy(F.floor(F.col("leaf") / width).cast("long").alias("branch")).agg(F.sum("n").alias("n"))
        pairs = F.array_sort(F.collect_list(F.struct(F.pmod("branch", F.lit(FAN)).alias("at"), "n")))  # FAN at most
        grouped = branches.groupBy(F.floor(F.col("branch") / FAN).cast("long").alias("root")).agg(pairs.alias("pairs"))
        held = F.expr("transform(pairs, p -> p.n)")
        grouped = grouped.select("root", held.alias("sizes"), F.expr("transform(pairs, p -> p.at)").alias("at"))
        most = min(FAN, ceil(n_leaves / width))
        joined = grouped.join(nodes, "root")
        places = grouped.select("root", F.posexplode("at").alias("leaf", "at"))
        dealt = split_counts(joined.select("root", "sizes", "counts"), most, seed + level)
        nodes = checkpointed(dealt.join(places.withColumn("leaf", F.col("leaf").cast("long")), ["root", "leaf"]).select((F.col("root") * FAN + F.col("at")).alias("root"), "counts"))
    return nodes.withColumnRenamed("root", "leaf")
