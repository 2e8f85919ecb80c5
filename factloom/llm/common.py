"""Helpers that the training-data operators share: checkpoints, hashed words, components."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the contracts call a word, for Spark's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass looks at.
CHUNK = 1 << 20
#: Rows whose texts are zipped or unzipped at once.
ZIP_ROWS = 500
#: Bytes of an Arrow batch, which the JVM and the Python task each hold at once.
BATCH_BYTES = 4 << 20
#: Bytes of a span beyond which it is hashed alone.
LONG_SPAN = 512
#: Keys that may be hot (each with over 1 / HOT_KEYS of all rows), and the tasks that share one.
HOT_KEYS, SALTS = 100_000, 64
#: Rows of a key above which `lookup` may call it hot.
HOT_ROWS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one stands in for it only where driver
    and executors are one process; on a cluster without a named folder this is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as Parquet in the shared folder."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/rewritten-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES: a batch of 10,000 long texts would take
    hundreds of MB on both sides. A longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


# --- texts as bytes ---------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the place where each row starts (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges (first, end) of rows holding about `limit` bytes each, always at least one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, of one of two kinds.

    Eight bytes at a time are mixed into the state by a bijection, so spans of equal length up to eight
    bytes never collide, and no algebra of the bytes (as in a polynomial) makes longer ones meet. Spans of
    over LONG_SPAN bytes take a keyed BLAKE2b.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = np.full(len(starts), _SEEDS[which], np.uint64)
    with np.errstate(over="ignore"):
        live, at, left = slice(None), starts, size
        for _ in range(LONG_SPAN // 8):
            out[live] = mix(out[live] ^ (eights[at] & _FIRST_BYTES[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            live = more if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8
        out = mix(out + size.astype(np.uint64) * _SEEDS[1 - which])
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        own = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(_SEEDS[which]).to_bytes(8, "little"))
        out[i] = int.from_bytes(own.digest(), "little")
    return out


class Words:
    """The words of consecutive texts: byte spans, the row of each word, words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        solid = ~_SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        before = np.concatenate(([False], solid[:-1])) if n else solid
        after = np.concatenate((solid[1:], [False])) if n else solid
        self.data = data
        self.starts = np.flatnonzero(solid & (~before | begins[:-1]))
        self.ends = np.flatnonzero(solid & (~after | begins[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each row, and the end
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, which)


def grams(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of n consecutive word hashes, for each start at which n words follow (rows ignored)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:size].copy()
        for j in range(1, n):
            out *= _SEEDS[which]
            out += words[j : size + j]
        return mix(out)


# --- texts in exchanges -----------------------------------------------------------------------


def slices(batches):
    """Batches of at most ZIP_ROWS rows, so that a task never holds a whole batch of texts twice."""
    for batch in batches:
        for i in range(0, batch.num_rows, ZIP_ROWS):
            yield batch.slice(i, ZIP_ROWS)


def zipped(df: DataFrame, column: str) -> DataFrame:
    """`df` with a text column as zstandard frames, about half of what an exchange makes of texts."""
    kinds = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in df.schema])
    at = df.columns.index(column)
    small_batches(df.sparkSession)

    def zip_up(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            texts = part.column(at).cast(pa.binary()).to_pylist()
            columns = part.columns
            columns[at] = pa.array([None if t is None else packer.compress(t) for t in texts], pa.binary())
            yield pa.record_batch(columns, part.schema.names)
        give_back()

    return df.mapInArrow(zip_up, kinds)


def unzip_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts of a column that `zipped` made."""
    unpacker = zstandard.ZstdDecompressor()
    return pa.array([None if z is None else unpacker.decompress(z) for z in column.to_pylist()], pa.binary()).cast(pa.string())


def unzipped(df: DataFrame, column: str) -> DataFrame:
    """`df` with a zipped column as texts again."""
    kinds = T.StructType([T.StructField(f.name, T.StringType()) if f.name == column else f for f in df.schema])
    at = df.columns.index(column)

    def unzip(batches):
        for part in slices(batches):
            columns = part.columns
            columns[at] = unzip_array(part.column(at))
            yield pa.record_batch(columns, part.schema.names)
        give_back()

    return df.mapInArrow(unzip, kinds)


# --- joins with hot keys ----------------------------------------------------------------------


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: list[str], how: str = "left") -> DataFrame:
    """`rows` joined with `groups` (one row per value of `keys`), with no task that gets a hot key alone.

    size: the column of `groups` that counts a group's rows, total: the rows of the table. Groups that
    hold over a HOT_KEYS-th of all rows are fewer than HOT_KEYS, so they may be broadcast to mark their
    rows; these are dealt over SALTS tasks by a hash of `spread` and of the partition they come from, and
    their groups repeated as often.
    Keys must not be null in `groups`; rows with null keys find nothing.
    """
    hot = groups.where(F.col(size) > max(1000, total // HOT_KEYS)).select(*keys, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(F.spark_partition_id(), *spread), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col(size) > max(1000, total // HOT_KEYS), F.expr(f"sequence(0, {SALTS - 1})")).otherwise(F.array(F.lit(0)))
    return rows.join(groups.withColumn("__salt", F.explode(salts)), [*keys, "__salt"], how).drop("__salt")


def hot_limit(total: int) -> int:
    """Rows above which a key of a table of `total` rows is hot; fewer than HOT_KEYS keys can be."""
    return max(HOT_ROWS, total // HOT_KEYS)


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot: DataFrame | None = None) -> DataFrame:
    """`rows` left-joined with `groups` (at most one row per value of `key`), without a hot task.

    Groups of hot keys are broadcast: they are those whose column `size` is above `hot_limit`, or where
    `groups` has no such column those of `hot` (key, ...), so fewer than HOT_KEYS. All others meet in a
    sort-merge join; null keys find nothing and are not shuffled. Both sides are read twice, so they should
    be stored or checkpointed. `size` is kept if `groups` has it.
    """
    if size in groups.columns:
        often = groups.where(F.col(size) > hot_limit(total))
        groups = groups.where(F.col(size) <= hot_limit(total))
    elif hot is not None:
        often = groups.join(F.broadcast(hot.select(key)), key, "right")
    else:
        often = groups.limit(0)
    marked = rows.join(F.broadcast(often.withColumn("__hot", F.lit(True))), key, "left")
    easy = F.col("__hot").isNotNull() | F.col(key).isNull()
    done = marked.where(easy).drop("__hot")
    rest = marked.where(~easy).select(*rows.columns).join(groups.hint("merge"), key, "left")
    return done.unionByName(rest)


# --- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in `edges`; component is the smallest id that links reach.

    Each round hooks every label to the least one among the neighbours of all that bear it, and then
    follows that hook once more, so that the labels of a component at least halve: a chain of n links takes
    about log n rounds. Ids with many links and labels of many ids are joined by broadcast (`lookup`). Every round is written to the shared folder; no link or label comes to the driver.
    """
    ways = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    both = checkpointed(edges.select(F.explode(ways).alias("e")).select("e.*").where("u <> v").distinct())
    n_edges = both.count()
    labels = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("links")).select("u", F.least("u", "v").alias("label"), "links")
    while True:
        # A file has the size that it has; a checkpoint keeps the size estimated of joins, which would be squared with every round.
        labels = rewritten(labels)
        near = lookup(both, labels.select(F.col("u").alias("v"), "label", "links"), "v", "links", n_edges).groupBy("u").agg(F.min("label").alias("near"))
        lower = checkpointed(labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("low"), "links"))
        hooks = checkpointed(lower.groupBy("old").agg(F.min("low").alias("hook"), F.count("*").alias("n")).where("hook < old"))
        if hooks.isEmpty():
            return lower.select(F.col("u").alias("id"), F.col("old").alias("component"))
        further = hooks.join(hooks.select(F.col("old").alias("hook"), F.col("hook").alias("next")), "hook", "left").select("old", F.coalesce("next", "hook").alias("hook"), "n")
        labels = lookup(lower, further, "old", "n", n_edges).select("u", F.coalesce("hook", "old").alias("label"), "links")
