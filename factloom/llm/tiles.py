"""Groups of any size dealt out in tiles, so that all their pairs are looked at but none is a row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt_in_tiles(rows: DataFrame, group: str, member: str, tiles: Column, per_bucket: int, weight: Column | None = None, weight_per_bucket: int = 1, total: int | None = None) -> DataFrame:
    """Adds tile, tile_a, tile_b and bucket to the members of groups; `tiles` is how many a row's group has.

    A group's rows are split at random into its tiles, and each row goes to every pair of tiles that
    has its own; two rows meet in exactly one pair (tile_a, tile_b) if their tiles differ, and in
    (tile, tile) if not. Pairs of tiles are hashed into buckets of about `per_bucket` rows and at most
    about `weight_per_bucket` of their weight, the unit that a task holds. `total`: the rows of all pairs
    of tiles if they are known, else they are counted.
    """
    rows = rows.withColumn("tiles", F.greatest(tiles, F.lit(1)).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(F.lit(97), member), F.col("tiles")).cast("int"))
    n, heavy = (total, 0) if total is not None else rows.agg(F.sum("tiles"), F.sum(F.col("tiles") * (F.lit(0) if weight is None else weight))).first()
    n = max(1, -(-(n or 0) // per_bucket), -(-(heavy or 0) // weight_per_bucket))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    rows = rows.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")})
    return rows.drop("tiles", "other").withColumn("bucket", F.pmod(F.xxhash64(group, "tile_a", "tile_b"), F.lit(n)).cast("int"))


def group_starts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each group starts in it (and the end)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.append(np.flatnonzero(new), len(order))


def pairs_upto(last: np.ndarray, most: int):
    """Pairs (i, j) with i < j <= last[i], in blocks of about `most`."""
    n = np.maximum(last - np.arange(len(last)), 0)
    upto = np.cumsum(n)
    first = 0
    while first < len(n):
        done = upto[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(upto, done + most, "right")))
        a = np.repeat(np.arange(first, end), n[first:end])
        b = a + 1 + np.arange(len(a)) - np.repeat(upto[first:end] - n[first:end] - done, n[first:end])
        if len(a):
            yield a, b
        first = end


def spanned(a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From links (a, b): each linked id, the smallest id that these links reach, how many links it has."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    wa, wb = (np.ones(len(a)), np.ones(len(b))) if weights is None else weights
    links = np.bincount(x, weights=wb, minlength=len(ids)) + np.bincount(y, weights=wa, minlength=len(ids))
    return ids, ids[label], links.astype(np.int64)
