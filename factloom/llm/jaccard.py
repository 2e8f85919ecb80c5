"""Jaccard join of documents on word shingles with Bayesian candidate pruning (operator 5)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, chunks, components, give_back, grams, join_groups, small_batches, slices, text_bytes, unzip_array, zipped
from .tiles import dealt_in_tiles, group_starts, pairs_upto, spanned

#: MinHash values of a signature (a byte each), values of a band, values between two decisions.
HASHES, BAND, STEP = 240, 6, 24
BANDS = HASHES // BAND
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-6
#: Rows of a tile and of a bucket, for signatures and for differences of sets, and bytes of the latter.
SIGNATURE_TILE, SIGNATURE_BUCKET, SET_TILE, SET_BUCKET, TILE_BYTES, BUCKET_BYTES = 512, 4096, 512, 1536, 2 << 20, 8 << 20
#: Pairs whose band codes (320 bytes a row) are compared at once.
PAIRS = 25_000

_MULTIPLY = np.random.default_rng(41).integers(0, 1 << 31, HASHES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(43).integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text one after the other, and where each starts."""
    words = Words(data, offsets)
    h = words.hashes()
    g = grams(h, n)
    valid = np.flatnonzero(words.rows[: len(g)] == words.rows[n - 1 :]) if len(g) else np.zeros(0, np.int64)
    g, row = g[valid], words.rows[valid]
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[fresh], row[fresh]
    return g, np.searchsorted(row, np.arange(len(offsets)))


def signature(shingles: np.ndarray) -> bytes:
    """The lowest byte of each MinHash value of a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        values = _MULTIPLY * x[None, i : i + 2048]
        values += _ADD
        np.minimum(low, values.min(1), out=low)
    # The least value has few bits to tell; a finaliser spreads them over the byte that is kept.
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    low ^= low >> np.uint32(12)
    return (low & np.uint32(255)).astype(np.uint8).tobytes()


@lru_cache
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of compared values, how many must agree to go on.

    With a uniform prior on the similarity s and agreement by chance in 1 of 256, m of n agree with
    probability p^m (1 - p)^(n - m), p = s + (1 - s) / 256. The pair goes on while the posterior
    probability of s >= threshold is at least the tolerance.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    high = s >= threshold
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        m = np.arange(n + 1)[:, None]
        likelihood = m * np.log(p) + (n - m) * np.log1p(-p)
        likelihood = np.exp(likelihood - likelihood.max(1, keepdims=True))
        posterior = likelihood[:, high].sum(1) / likelihood.sum(1)
        out[n] = int(np.argmax(posterior >= tolerance)) if (posterior >= tolerance).any() else n + 1
    return out


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """(k, h, class_a, class_b, shingles, sig): equal classes mean equal shingle sets; null without shingles."""

    def describe(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in chunks(offsets):
                g, first = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                sums = _class_sums(g, first)
                sizes = np.diff(first)
                sigs = [signature(g[first[i] : first[i + 1]]) if sizes[i] else None for i in range(b - a)]
                empty = sizes == 0
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sums[0], mask=empty), pa.array(sums[1], mask=empty), pa.array(sizes), pa.array(sigs, pa.binary())],
                    ["k", "h", "class_a", "class_b", "shingles", "sig"],
                )
        give_back()

    return docs.mapInArrow(describe, "k long, h long, class_a long, class_b long, shingles long, sig binary")


def _class_sums(g: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set, which together name it."""
    with np.errstate(over="ignore"):
        tops = [np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64))) for x in (g, (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ (g << np.uint64(7)))]
        return [(t[first[1:]] - t[first[:-1]]).view(np.int64) for t in tops]


def difference(base: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, int]:
    """How a set differs from another, both sorted: places in `base` that it lacks, and what it has more
    (with the top bit set), in order; and how many it lacks."""
    lacks = np.flatnonzero(~np.isin(base, own, assume_unique=True)).astype(np.uint64)
    more = own[~np.isin(own, base, assume_unique=True)] >> np.uint64(1) | np.uint64(1 << 63)
    return np.concatenate([lacks, np.unique(more)]), len(lacks)


def _matrix(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _prune(threshold: float):
    needed = least_matches(threshold)

    def prune(table: pa.Table) -> pa.Table:
        give_back()
        get = lambda name: table.column(name).to_numpy()
        rep, key, tile, a, b = (get(c) for c in ("rep", "key", "tile", "tile_a", "tile_b"))
        sig = _matrix(table.column("sig"), np.uint8, HASHES)
        bands = sig.reshape(len(sig), BANDS, BAND)
        codes = (bands.astype(np.uint64) << (np.arange(BAND, dtype=np.uint64) * np.uint64(8))).sum(2)
        order, starts = group_starts(key, a, b)
        last = np.repeat(starts[1:] - 1, np.diff(starts))
        found = [np.zeros((2, 0), np.int64)]
        band = (key >> 48) & 0xFFFF
        for i, j in pairs_upto(last, PAIRS):
            i, j = order[i], order[j]
            meet = (tile[i] != tile[j]) | (a[i] == b[i])
            i, j = i[meet], j[meet]
            own = (codes[i] == codes[j]).argmax(1) == band[i]  # by the first band that they share
            i, j = i[own], j[own]
            agree = np.zeros(len(i), np.int64)
            for at in range(0, HASHES, STEP):
                agree += (sig[i, at : at + STEP] == sig[j, at : at + STEP]).sum(1)
                mine = (band[i] * BAND < at + STEP) * BAND  # the band that made the pair is no evidence
                go = agree - mine >= needed[at + STEP - mine]
                i, j, agree = i[go], j[go], agree[go]
            found.append(np.stack([rep[i], rep[j]]))
        x, y = np.concatenate(found, 1)
        ids, least, _ = spanned(x, y)
        rest = ids != least
        return pa.table({"a": pa.array(ids[rest], pa.int64()), "b": pa.array(least[rest], pa.int64())})

    return prune


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, by products of blocks of their incidence matrix."""
    sizes = np.array([len(x) for x in sets])
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = times[inverse] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[common], number[inverse[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int((times > 1).sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        shared += block @ block.T
    return shared


def _verify(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        give_back()
        get = lambda name: table.column(name).to_numpy()
        rep, copies, comp, tile, a, b, size, base, lacks = (get(c) for c in ("rep", "copies", "comp", "tile", "tile_a", "tile_b", "size", "base_size", "lacks"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("difference").to_pylist()]
        order, starts = group_starts(comp, a, b)
        found = [np.zeros((4, 0), np.int64)]
        for first, end in zip(starts[:-1], starts[1:], strict=True):
            at = order[first:end]
            if len(at) < 2:
                continue
            # Of the base's elements both have all but what either lacks; beside them what both have more.
            shared = base[at[0]] - lacks[at][:, None] - lacks[at][None, :] + _intersections([sets[i] for i in at])
            near = np.triu(shared >= threshold * (size[at][:, None] + size[at][None, :] - shared) - 1e-9, 1)
            if a[at[0]] != b[at[0]]:
                near &= tile[at][:, None] != tile[at][None, :]
            i, j = np.nonzero(near)
            i, j = at[i], at[j]
            found.append(np.stack([rep[i], rep[j], copies[i], copies[j]]))
        x, y, wx, wy = np.concatenate(found, 1)
        ids, least, links = spanned(x, y, (wx, wy))
        return pa.table({"id": pa.array(ids, pa.int64()), "least": pa.array(least, pa.int64()), "links": pa.array(links, pa.int64())})

    return verify


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """All links between documents whose shingle sets have a Jaccard similarity of `threshold` or more.

    Returns (key, text_hash, class_id, copy_of, n_links, kept) for every row: copy_of is the smallest
    key with the same shingle set, n_links the number of other documents that it links with (copies
    included), class_id the smallest key that links reach, and kept is true for the row that stands for
    all of these: the smallest by key, then by text_hash (xxhash64 of the text). It is true of every row
    that links with nothing.

    1. Documents with equal sets are one class from here on. Its signature is HASHES MinHash bytes.
    2. Candidates share one of BANDS bands of BAND bytes: a pair at 0.8 shares none with probability
       5e-6. Members of a band's group meet in tiles, and the first band that a pair shares looks at it.
    3. The other MinHash values are compared STEP at a time; a pair is dropped once the posterior
       probability of reaching the threshold is under TOLERANCE. A spanning tree of what is left of
       each group leaves the task, and its components are what may be linked.
    4. Within a component all pairs are verified exactly, in tiles, by matrix products. What is copied
       from tile to tile is how a class's set differs from that of the component's first class.

    Groups of any size are split in tiles, pairs are no rows, and links are counted where they are
    verified. The work within a group of different texts grows with its pairs, which exact counts of
    links need.

    Texts with fewer than `shingle` words (null ones too) have no shingles and link with nothing.
    Rows with a null key are returned without links and with null classes. Rows with equal keys count
    as documents each, of equal ones (key and text) all are kept or none. An empty table gives an empty
    result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    named = docs.select(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("t"))
    described = checkpointed(_describe(named, shingle))
    n_rows = described.count()
    filled = described.where("k IS NOT NULL AND class_a IS NOT NULL")
    classes = filled.groupBy("class_a", "class_b").agg(F.min(F.struct("k", "h")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    # A number for each class, fixed by the checkpoint: its smallest key may be another class's too.
    classes = checkpointed(classes.withColumn("rep", F.monotonically_increasing_id()))

    def to_bands(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, BAND)
            code = (sig.astype(np.uint64) << (np.arange(BAND, dtype=np.uint64) * np.uint64(8))).sum(2) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(48))
            yield pa.record_batch([pa.array(code.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "rep"])

    bands = classes.select("rep", "sig").mapInArrow(to_bands, "key long, rep long")
    groups = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(bands.join(groups, "key"))
    tiled = dealt_in_tiles(members, "key", "rep", F.ceil(F.col("n") / SIGNATURE_TILE), SIGNATURE_BUCKET).drop("n")
    pruned = tiled.join(classes.select("rep", "sig"), "rep").groupBy("bucket").applyInArrow(_prune(threshold), "a long, b long")
    maybe = components(pruned)

    sizes = maybe.groupBy("component").agg(F.count("*").alias("n"))
    maybe = maybe.join(sizes, "component").select(F.col("id").alias("rep"), F.col("component").alias("comp"), "n")
    maybe = maybe.join(classes.select("rep", "copies", "class_a", "class_b", F.col("first.k").alias("k"), F.col("first.h").alias("h")), "rep")
    texts = checkpointed(zipped(named.where("k IS NOT NULL"), "t").join(maybe, ["k", "h"]).drop("k", "h"))
    bases = texts.where("rep = comp").select("comp", "n", F.col("t").alias("base"), F.col("class_a").alias("base_a"), F.col("class_b").alias("base_b"))
    paired = join_groups(texts.drop("n"), bases.dropDuplicates(["comp"]), ["comp"], "n", n_rows, ["rep"], "inner")
    paired = paired.select("rep", "comp", "n", "copies", "t", "base")

    def to_differences(batches):
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in slices(batches):
            texts, bases, comps = unzip_array(batch.column(4)), batch.column(5), batch.column(1).to_pylist()
            data, offsets = text_bytes(texts)
            rows = []
            for a, b in chunks(offsets):
                g, first = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)
                for i in range(b - a):
                    if known[0] != comps[a + i]:
                        known = comps[a + i], shingle_sets(*text_bytes(unzip_array(bases.slice(a + i, 1))), shingle)[0]
                    more, lacks = difference(known[1], g[first[i] : first[i + 1]])
                    rows.append((first[i + 1] - first[i], len(known[1]), lacks, more.tobytes()))
            size, base, lacks, more = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [*batch.columns[:4], pa.array(size, pa.int64()), pa.array(base, pa.int64()), pa.array(lacks, pa.int64()), pa.array(more, pa.binary())]
            yield pa.record_batch(columns, ["rep", "comp", "n", "copies", "size", "base_size", "lacks", "difference"])
        give_back()

    sets = paired.mapInArrow(to_differences, "rep long, comp long, n long, copies long, size long, base_size long, lacks long, difference binary")
    sets = checkpointed(sets.dropDuplicates(["rep"]))
    heavy = F.octet_length("difference")
    of_comp = sets.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / SET_TILE), F.ceil(F.sum(heavy) / TILE_BYTES)).alias("n_tiles"), F.count("*").alias("n"))
    sets = join_groups(sets.drop("n"), of_comp, ["comp"], "n", n_rows, ["rep"], "inner").drop("n")
    placed = dealt_in_tiles(sets, "comp", "rep", F.col("n_tiles"), SET_BUCKET, heavy, BUCKET_BYTES).drop("n_tiles")
    linked = checkpointed(placed.groupBy("bucket").applyInArrow(_verify(threshold), "id long, least long, links long"))
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(linked.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    reach = reach.join(counts, "id").join(classes.select(F.col("rep").alias("id"), "first"), "id")
    firsts = reach.groupBy("component").agg(F.min("first").alias("leader"))
    reach = reach.join(firsts, "component").select(F.col("id").alias("rep"), "links", "leader")
    found = classes.select("class_a", "class_b", "rep", "first", "copies").join(reach, "rep", "left").drop("rep")
    out = join_groups(described.select("k", "h", F.when(F.col("k").isNotNull(), F.col("class_a")).alias("class_a"), "class_b"), found, ["class_a", "class_b"], "copies", n_rows, ["k", "h"])
    leader = F.coalesce("leader", "first")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return out.select(
        F.col("k").alias(key), F.col("h").alias("text_hash"), F.coalesce(leader["k"], F.col("k")).alias("class_id"), F.coalesce(F.col("first")["k"], F.col("k")).alias("copy_of"),
        n_links.alias("n_links"), F.coalesce(leader.eqNullSafe(F.struct("k", "h")) | leader.isNull(), F.lit(True)).alias("kept"),
    )


def op5_jaccard_join(spark, sf_dir):
    """Class and number of links of every document at five words and 0.8."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
