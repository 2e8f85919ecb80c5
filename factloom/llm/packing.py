"""Packing documents into sequences of tokens, certified by lower bounds (operator 2)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, give_back, small_batches, text_bytes
from .tokenize import encoder, vocabulary

#: Tokens of a sequence; the id that ends a document; pieces that one task packs.
LENGTH, END_ID, PARTITION_PIECES = 2048, 0, 60_000
PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", length: int = LENGTH) -> DataFrame:
    """The pieces of every document: its ids and END_ID, cut into `length` tokens from the end.

    A document of up to `length` tokens is one piece. A longer one has full pieces after a first one
    that takes the remainder, so only the first piece of any document needs packing. `keep` columns
    come along. A null text is an empty one, and every document has a piece.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [PIECES])

    def cut(batches):
        known = encoder(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(keep)))
            for a, b in chunks(offsets, 2 << 20):
                ids = known.batch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row, piece, start, size, crc = [], [], [], [], []
                for i, own in enumerate(ids):
                    own = np.append(own.astype("<u4"), np.uint32(END_ID))
                    at, k = 0, 0
                    step = len(own) % length or length
                    while at < len(own):
                        row.append(a + i)
                        piece.append(k)
                        start.append(at)
                        size.append(step)
                        crc.append(zlib.crc32(own[at : at + step]))
                        at, k, step = at + step, k + 1, length
                take = pa.array(row, pa.int64())
                columns = [batch.column(j).take(take) for j in range(len(keep))]
                columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns, [*keep, "piece", "start", "length", "ids_crc32"])
        give_back()

    return rows.mapInArrow(cut, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, and the number of bins: longest first, each into the fullest bin that
    has room. Open bins are stacked by the room they have; a bit mask finds the least room that fits."""
    bins = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            where = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            where, room, used = used, capacity, used + 1
        bins[i] = where
        if room - s:
            stacks[room - s].append(where)
            mask |= 1 << (room - s)
    return bins, used


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions.

    The first rounds items over capacity - t up to a full bin and drops those under t; the second
    counts, for k, whole (k + 1)-ths of a bin: with u a size over the capacity, u itself if (k + 1) u
    is whole, else floor((k + 1) u) / k. Either maps every set of items that fits a bin to a sum of
    at most one, and the plain sum is the first with t = 0.
    """
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    s = np.arange(capacity + 1)
    many, total = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * s)
    t = np.arange(1, capacity // 2 + 1)
    big = np.where(capacity - t + 1 <= capacity, many[np.minimum(capacity - t + 1, capacity)], 0)
    middle = total[capacity - t] - total[t - 1]
    best = max(-(-int(total[-1]) // capacity), int((big + -(-middle // capacity)).max()))
    for k in range(1, 101):
        up = s * (k + 1)
        scaled = np.where(up % capacity == 0, s * k, (up // capacity) * capacity)  # times capacity * k
        best = max(best, -(-int((counts * scaled).sum()) // (capacity * k)))
    return best


def _pack(group: str):
    def pack(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        order = np.lexsort((table.column("row").to_numpy(), sizes))
        bins = np.empty(len(sizes), np.int64)
        bins[order], used = best_fit_decreasing(sizes[order], LENGTH)
        at = np.lexsort((table.column("row").to_numpy(), bins))
        upto = np.cumsum(sizes[at])
        first = np.concatenate(([True], np.diff(bins[at]) > 0))
        base = (upto - sizes[at])[first]
        offsets = np.empty(len(sizes), np.int64)
        offsets[at] = upto - sizes[at] - np.repeat(base, np.diff(np.append(np.flatnonzero(first), len(at))))
        full = np.bincount(bins, weights=sizes, minlength=used)[bins].astype(np.int64)
        fixed = {"bin": bins, "offset": offsets, "filled": full, "bins": np.full(len(sizes), used), "bound": np.full(len(sizes), lower_bound(sizes, LENGTH))}
        return pa.table({"row": table.column("row"), "length": table.column("length"), group: table.column(group), **{k: pa.array(v, pa.int64()) for k, v in fixed.items()}})

    return pack


def pack_pieces(pieces: DataFrame, seed: int = 3) -> DataFrame:
    """Adds sequence_id, offset and certified to (row, length): row is a distinct long, length under 2048.

    Rows are dealt at random to partitions of about PARTITION_PIECES, each packed by best-fit
    decreasing in one task. A partition that needs no more bins than its `lower_bound` is certified and
    done. The others have gaps: their full bins stay, and what is in the rest they exchange: it is dealt
    anew among half as many partitions (of four times PARTITION_PIECES at most) and packed again, until
    no partition has a gap, a round saves no bin (its packing is then dropped for the one before), or a
    single partition has nobody to exchange with.
    """
    n = pieces.count()
    n_parts = max(1, round(n / PARTITION_PIECES))
    shape = "row long, length long, part long, bin long, offset long, filled long, bins long, bound long"
    dealt = lambda rows, turn, n_parts: rows.select("row", "length", F.pmod(F.xxhash64(F.lit(seed + turn), "row"), F.lit(n_parts)).alias("part"))
    pack = lambda rows: checkpointed(rows.groupBy("part").applyInArrow(_pack("part"), shape))
    named = lambda df, turn: df.select("row", "offset", F.struct(F.lit(turn).alias("turn"), "part", "bin").alias("sequence"), (F.col("bins") == F.col("bound")).alias("certified"))
    again = (F.col("bins") > F.col("bound")) & (F.col("filled") < LENGTH)
    packed, turn, done = pack(dealt(pieces, 0, n_parts)), 0, []
    while True:
        n_open, n_bins = packed.where(again).agg(F.count("*"), F.countDistinct("part", "bin")).first()
        if not n_open or n_parts == 1:
            break
        n_parts = max(-(-n_parts // 2), -(-n_open // (4 * PARTITION_PIECES)))
        better = pack(dealt(packed.where(again), turn + 1, n_parts))
        if better.agg(F.countDistinct("part", "bin")).first()[0] >= n_bins:
            break
        done.append(named(packed.where(~again), turn))
        packed, turn = better, turn + 1
    result = named(packed, turn)
    for more in done:
        result = result.unionByName(more)
    # part and bin fit 26 and 24 bits, and full pieces have ids from 2 ** 62.
    number = F.shiftleft(F.col("sequence.turn").cast("long"), 50) + F.shiftleft("sequence.part", 24) + F.col("sequence.bin")
    return result.select("row", number.alias("sequence_id"), "offset", "certified")


def pack_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place in it.

    Returns `keep` columns, piece, start, length, ids_crc32, sequence_id, offset, certified (no packing
    of the pieces that were packed together has fewer sequences). Pieces of 2048 tokens fill a sequence
    each; the others are packed. Nulls in `keep` pass through, repeated rows are packed as separate
    documents, an empty table gives an empty result; other columns are ignored.
    """
    pieces = tokenized_pieces(docs, path or vocabulary(), keep, text)
    pieces = checkpointed(pieces).withColumn("row", F.monotonically_increasing_id())
    rest = pack_pieces(pieces.where(F.col("length") < LENGTH).select("row", "length"))
    pieces = pieces.join(rest, "row", "left")
    whole = F.lit(1 << 62) + F.col("row")
    kept = [F.col(f"`{c}`") for c in keep]
    return pieces.select(*kept, "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", whole).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), F.coalesce("certified", F.lit(True)).alias("certified"))


def op2_best_fit_packing(spark, sf_dir):
    """The pieces of all documents, packed."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
