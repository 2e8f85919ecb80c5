"""Near-duplicate vectors by collision-counting projections (operator 7)."""

from __future__ import annotations

from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, give_back, join_groups, mix, small_batches
from .tiles import dealt_in_tiles, group_starts, pairs_upto, spanned

#: Rows that a cell has on average, rows of a tile and of a bucket, rows and bytes of those that verify.
CELL_ROWS, TILE, BUCKET, PAIR_TILE, PAIR_BUCKET, PAIR_BYTES = 16, 512, 8192, 512, 1536, 16 << 20
#: Least chance that a pair at the threshold meets in a cell's window, and that its count passes.
RECALL, COUNT_RECALL = 0.999, 0.9999
#: Projections whose windows are counted; half the width of a window in standard deviations of a
#: pair's difference, and the chance that a pair at the threshold falls into it.
COUNTED, SPREAD, INSIDE = 32, 2.0, 0.9545
#: Steps of a window in which counted projections are kept, a byte each.
STEPS = 24
#: Cells of over a tile that are broadcast at most (16 bytes each); more are joined by exchange.
MOST_BROADCAST = 500_000


class Projections:
    """Random projections of unit vectors: tables that bring pairs together, and those that are counted.

    In each table a few signs name a cell and one more projection sorts it; two vectors meet in it if
    they share the cell and each is within the window that is centred on the other. COUNTED further
    projections are the same for all tables: a pair that meets is held against the number of them in
    which one is within the other's window. All chances are known for a pair at the threshold, so the
    number of tables and the least count follow from the recall asked for.
    """

    def __init__(self, n: int, threshold: float, seed: int = 17):
        self.bits = max(1, min(30, ceil(log2(max(2, n / CELL_ROWS)))))
        self.window = SPREAD * sqrt(2 - 2 * threshold)
        self.chance = (1 - acos(threshold) / pi) ** self.bits * INSIDE
        self.tables = max(1, ceil(log(1 - RECALL) / log(1 - self.chance)))
        upto, self.least = 1.0, 0
        while self.least < COUNTED:  # the most that still has COUNT_RECALL of such pairs at or above it
            upto -= comb(COUNTED, self.least) * INSIDE**self.least * (1 - INSIDE) ** (COUNTED - self.least)
            if upto < COUNT_RECALL:
                break
            self.least += 1
        self.seed = seed
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells and places (rows x tables) and counted projections in steps (rows x COUNTED)."""
        dim = unit.shape[1]
        if dim not in self.known:
            rng = np.random.default_rng([self.seed, dim])
            self.known[dim] = rng.standard_normal((dim, self.tables * (self.bits + 1))), rng.standard_normal((dim, COUNTED))
        meet, count = self.known[dim]
        values = (unit @ meet).reshape(len(unit), self.tables, self.bits + 1)
        cells = ((values[:, :, : self.bits] > 0).astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(2, dtype=np.uint64)
        with np.errstate(over="ignore"):
            cells = mix(mix(cells) + np.arange(self.tables, dtype=np.uint64) + np.uint64(dim << 32))
        steps = np.clip(np.rint(unit @ count / self.window * STEPS), -127, 127).astype(np.int8)
        return cells.view(np.int64), values[:, :, self.bits].astype(np.float32), steps


def _matrices(column: pa.Array):
    """(rows, unit vectors) for each vector length that occurs."""
    lengths = column.value_lengths().to_numpy()
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        m = flat.reshape(len(rows), int(dim))
        m = m / np.abs(m).max(1, keepdims=True)  # squares of very small or large numbers stay numbers
        yield rows, m / np.linalg.norm(m, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Returns (key, n_links, component_id, kept) for every row; links are pairs with cosine >= threshold.

    1. Equal vectors are one class from here on. Each class's projections are made once.
    2. A class goes to one cell in each table, with COUNTED bytes instead of its vector. Members of a
       cell meet in tiles; a task sorts them by the table's projection, takes the pairs within the
       window and counts in how many of the counted projections they collide. A spanning tree of the
       pairs with a sufficient count leaves the task.
    3. Components of these trees are what may be linked. Within one all pairs are verified by their
       cosine in doubles, in tiles, and links are counted there. Vectors are shuffled in this step alone.

    Pairs are no rows. Vectors that are null, empty, all zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths. Rows with a null key get no links and a null
    component, and are kept. Rows with equal keys count as one vector (the smallest) and get the same
    result. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    named = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    fine = F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)")
    points = named.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine).groupBy("id").agg(F.min("v").alias("v"))
    points = checkpointed(points.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")}))
    n_rows = points.count()
    classes = checkpointed(points.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    tables = Projections(classes.count(), threshold)

    def to_cells(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, unit in _matrices(batch.column(1)):
                cells, places, steps = tables.of(unit)
                counted = np.repeat(steps, tables.tables, axis=0)
                counted = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COUNTED), len(counted), [None, pa.py_buffer(counted.tobytes())]).cast(pa.binary())
                yield pa.record_batch([pa.array(cells.ravel()), pa.array(np.repeat(ids[rows], tables.tables)), pa.array(places.ravel()), counted], ["cell", "rep", "place", "counted"])
        give_back()

    def to_keys(batches):
        for batch in batches:
            for _, unit in _matrices(batch.column(0)):
                yield pa.record_batch([pa.array(tables.of(unit)[0].ravel())], ["cell"])

    cells = classes.select("rep", "v").mapInArrow(to_cells, "cell long, rep long, place float, counted binary")
    large = classes.select("v").mapInArrow(to_keys, "cell long").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    large = checkpointed(large)
    n_large, more = large.agg(F.count("*"), F.sum(F.col("n") * (F.ceil(F.col("n") / TILE) - 1))).first()
    n_cells = n_rows * tables.tables
    cells = cells.join(F.broadcast(large), "cell", "left") if n_large <= MOST_BROADCAST else join_groups(cells, large, ["cell"], "n", n_cells, ["rep"])
    tiled = dealt_in_tiles(cells, "cell", "rep", F.ceil(F.coalesce("n", F.lit(1)) / TILE), BUCKET, total=n_cells + (more or 0)).drop("n")

    def gather(table: pa.Table) -> pa.Table:
        give_back()
        get = lambda name: table.column(name).to_numpy()
        rep, cell, place, tile, a, b = (get(c) for c in ("rep", "cell", "place", "tile", "tile_a", "tile_b"))
        steps = np.frombuffer(b"".join(table.column("counted").to_pylist()), np.int8).reshape(-1, COUNTED).astype(np.int16)
        order = np.lexsort((place, cell, a, b))
        new = np.zeros(len(order), bool)
        for k in (cell, a, b):
            new[1:] |= k[order][1:] != k[order][:-1]
        line = np.cumsum(new) * 1000.0 + place[order]
        last = np.searchsorted(line, line + tables.window * 1.001, "right") - 1
        found = [np.zeros((2, 0), np.int64)]
        for i, j in pairs_upto(last, 60_000):
            i, j = order[i], order[j]
            meet = (tile[i] != tile[j]) | (a[i] == b[i])
            i, j = i[meet], j[meet]
            good = (np.abs(steps[i] - steps[j]) <= STEPS + 1).sum(1) >= tables.least  # a step more for what rounding did
            found.append(np.stack([rep[i[good]], rep[j[good]]]))
        x, y = np.concatenate(found, 1)
        ids, least, _ = spanned(x, y)
        rest = ids != least
        return pa.table({"a": pa.array(ids[rest], pa.int64()), "b": pa.array(least[rest], pa.int64())})

    maybe = components(tiled.groupBy("bucket").applyInArrow(gather, "a long, b long"))
    sizes = maybe.groupBy("component").agg(F.count("*").alias("n"))
    maybe = join_groups(maybe, sizes, ["component"], "n", n_rows, ["id"], "inner").withColumnRenamed("id", "rep")
    bytes_of = F.size("v") * 8
    held = maybe.join(classes.select("rep", "copies", "v"), "rep")
    placed = dealt_in_tiles(held, "component", "rep", F.ceil(F.col("n") / PAIR_TILE), PAIR_BUCKET, bytes_of, PAIR_BYTES).drop("n")

    def verify(table: pa.Table) -> pa.Table:
        give_back()
        column = table.column("v").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        get = lambda name: table.column(name).to_numpy()
        found = [np.zeros((4, 0), np.int64)]
        for rows, unit in _matrices(column):
            rep, copies, comp, tile, a, b = (get(c)[rows] for c in ("rep", "copies", "component", "tile", "tile_a", "tile_b"))
            order, starts = group_starts(comp, a, b)
            for first, end in zip(starts[:-1], starts[1:], strict=True):
                at = order[first:end]
                near = np.triu(unit[at] @ unit[at].T >= threshold, 1)
                if a[at[0]] != b[at[0]]:
                    near &= tile[at][:, None] != tile[at][None, :]
                i, j = np.nonzero(near)
                found.append(np.stack([rep[at[i]], rep[at[j]], copies[at[i]], copies[at[j]]]))
        x, y, wx, wy = np.concatenate(found, 1)
        ids, least, links = spanned(x, y, (wx, wy))
        return pa.table({"id": pa.array(ids, pa.int64()), "least": pa.array(least, pa.int64()), "links": pa.array(links, pa.int64())})

    linked = checkpointed(placed.groupBy("bucket").applyInArrow(verify, "id long, least long, links long"))
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(linked.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    linked = counts.join(groups, "id").withColumnRenamed("id", "rep")
    done = classes.select("h1", "h2", "rep", "copies").join(linked, "rep", "left")
    done = join_groups(points.drop("v"), done, ["h1", "h2"], "copies", n_rows, ["id"], "inner")
    done = done.select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    times = named.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("times"))
    named = join_groups(named.select("id"), done.join(times, "id"), ["id"], "times", n_rows, ["id"])
    return named.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce("component", "id").eqNullSafe(F.col("id")).alias("kept"))


def op7_near_vectors(spark, sf_dir):
    """Links and components of all embeddings at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
