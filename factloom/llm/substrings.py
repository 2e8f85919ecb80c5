"""Repeated passages: seeds on winnowed anchors, extended to windows and maximal repeats (operator 6)."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Words, checkpointed, give_back, grams, small_batches, text_bytes, unzip_array, zipped

#: Words of a seed, and bytes of text that a part (the unit that is compared at once) holds.
SEED_WORDS, PART_BYTES = 5, 2 << 20
#: Parts whose anchors are counted together; an anchor in over HOT of the first GROUP parts is hot, and
#: what is shared around it is compared in SALTS shares of the parts before these are put together.
GROUP, HOT, SALTS = 4096, 128, 64
LAST = np.iinfo(np.int64).max


def _windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the n-word windows of all rows, the anchor hash of each, and the word hashes.

    The anchor of a window is the smallest of the hashes of its seeds (the last of equal ones), so
    equal windows have equal anchors wherever they are. Neighbouring windows mostly share theirs.
    """
    h = words.hashes()
    starts = np.flatnonzero(words.rows[: max(0, len(h) - n + 1)] == words.rows[n - 1 :]) if len(h) >= n else np.zeros(0, np.int64)
    seeds = grams(h, SEED_WORDS)
    size = len(h) - n + 1
    anchors = seeds[: max(0, size)].copy()
    for j in range(1, n - SEED_WORDS + 1):
        np.minimum(anchors, seeds[j : j + len(anchors)], out=anchors)
    return starts, anchors[starts], h


def _keys(words: Words, h: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each window: hashes of 64 and 32 bits from two kinds of word hashes."""
    return grams(h, n)[starts], (grams(words.hashes(1), n, 1)[starts] >> np.uint64(32)).astype(np.uint32)


def _in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), n: int = 13, keep_text: bool = False) -> DataFrame:
    """Removes each word covered by an n-word window that also starts in a document with a smaller key.

    Returns key, `carry` columns (and the text with keep_text), n_words, n_removed, kept_text (the kept words joined by one blank),
    removed (the repeats, array of struct<first, words, source, source_first> in word positions: the words from
    first on are those of the document with the smaller key source from source_first on, all of them).

    1. Seeds: a document's anchors are the winnowed SEED_WORDS-word hashes, one of which lies in every
       n-word window. Documents are dealt at random into parts of about PART_BYTES, each of which lists
       its distinct anchors once, and parts are joined on the anchors that they share. A group has a row
       per part at most, however many documents share the passage.
    2. Extension: a part extends each shared anchor by l words to the left and n - SEED_WORDS - l to the
       right, for every l with which the anchor is the window's own, and reports each distinct window
       once, with its smallest key and the first place there.
    3. Matches of which another part has a smaller key go back to the part, with that key and place. It joins them
       with the matches among its own documents (found locally in the same way) and extends each in both
       directions as long as the next window matches the same document at the next place; these repeats are
       removed. Where a source holds a window twice, the repeat follows its first place, and a new
       repeat starts where that ends.

    No task gets all of a hot group: anchors are counted in groups of GROUP parts first, and windows
    around hot anchors are compared in SALTS shares first; only what is single or smallest there goes on.

    Only anchors, extended windows and their parts are shuffled beside one exchange of the texts
    that all steps read, zipped. Keys compare as integers; a null key counts as the largest, so it never
    makes others lose words. Rows with equal keys do not make each other lose words. A null text has
    no words (kept_text ''), an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_parts = max(1, -(-size // PART_BYTES))
    rows = docs.withColumn("part", F.pmod(F.xxhash64("k", F.crc32(F.col("t").cast("binary"))), F.lit(n_parts)).cast("int"))
    fields = ["k", *["t"] * keep_text, *[f"c{i}" for i in range(len(carry))]]
    kinds = [rows.schema[c] for c in fields]
    rows = zipped(rows, "t").repartition("part")

    def words_of(table: pa.Table) -> Words:
        return Words(*text_bytes(unzip_array(table.column("t"))))

    def keys_of(table: pa.Table, words: Words, starts: np.ndarray) -> np.ndarray:
        ids = table.column("k").fill_null(LAST).to_numpy() if table.num_rows else np.zeros(0, np.int64)
        return ids[words.rows[starts]]

    def list_anchors(table: pa.Table) -> pa.Table:
        give_back()
        _, anchors, _ = _windows(words_of(table), n)
        anchors = np.unique(anchors)
        return pa.table({"anchor": _signed(anchors), "part": pa.array(np.full(len(anchors), table.column("part")[0].as_py()), pa.int32())})

    anchors = rows.groupBy("part").applyInArrow(list_anchors, "anchor long, part int")
    if n_parts <= GROUP:
        counted = anchors.withColumn("parts", F.count("*").over(Window.partitionBy("anchor"))).where("parts > 1")
        shared = counted.select("anchor", F.col("part").alias("in_part"), (F.col("parts") > HOT).alias("hot"))
    else:
        counted = anchors.withColumn("group", F.floor(F.col("part") / GROUP).cast("int")).withColumn("parts", F.count("*").over(Window.partitionBy("anchor", "group")))
        counted = checkpointed(counted)  # read four times
        single = counted.where("parts = 1").withColumn("times", F.count("*").over(Window.partitionBy("anchor")))
        several = counted.where("parts > 1").select("anchor", "group").distinct().groupBy("anchor").agg(F.count("*").alias("groups"))
        alone = single.join(several, "anchor", "left").where(F.col("times") + F.coalesce("groups", F.lit(0)) > 1)
        shared = counted.where("parts > 1").select("anchor", "part").unionByName(alone.select("anchor", "part"))
        hot = counted.where((F.col("group") == 0) & (F.col("parts") > HOT)).select("anchor").distinct()  # at most GROUP parts' anchors / HOT rows
        shared = shared.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "anchor", "left").select("anchor", F.col("part").alias("in_part"), F.coalesce("hot", F.lit(False)).alias("hot"))

    def extend(table: pa.Table, seeds: pa.Table) -> pa.Table:
        give_back()
        words = words_of(table)
        starts, found, h = _windows(words, n)
        wanted, hot = _column(seeds, "anchor").view(np.uint64), seeds.column("hot").to_numpy(zero_copy_only=False)
        popular = _in(found, np.sort(wanted[hot]))
        seeded = _in(found, np.sort(wanted))
        starts, popular = starts[seeded], popular[seeded]
        k1, k2 = _keys(words, h, starts, n)
        ids, places = keys_of(table, words, starts), starts - words.first[words.rows[starts]]
        order = np.lexsort((places, ids, k1))
        first = order[np.concatenate(([True], np.diff(k1[order].view(np.int64)) != 0))] if len(order) else order
        part = table.column("part")[0].as_py() if table.num_rows else 0
        salt = np.where(popular[first], part % SALTS, -1).astype(np.int8)
        spot = np.int64(part) << np.int64(32) | places[first]
        return pa.table({"k1": _signed(k1[first]), "k2": pa.array(k2[first].view(np.int32)), "salt": pa.array(salt), "spot": pa.array(spot), "least": pa.array(ids[first])})

    # A spot is the part above the place in the document, so that a row is no longer for it.
    windows = rows.groupBy("part").cogroup(shared.groupBy("in_part")).applyInArrow(extend, "k1 long, k2 int, salt byte, spot long, least long")
    head = lambda df, *by: df.withColumns({x: F.first(c).over(Window.partitionBy(*by).orderBy("least", "spot")) for x, c in (("first", "least"), ("first_spot", "spot"))})
    lost = head(windows, "k1", "k2", "salt")
    # Of salted windows the smallest of each share are compared with each other.
    heads = head(lost.where(F.when(F.col("first") == F.col("least"), F.col("salt")).otherwise(-1) >= 0), "k1", "k2")
    lost = lost.where("first < least").unionByName(heads.where("first < least"))
    lost = lost.select("k1", F.shiftright("spot", 32).cast("int").alias("in_part"), "first", F.col("first_spot").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place"))

    found = T.StructType.fromDDL("n_words long, n_removed long, kept_text string, removed array<struct<first:long, words:long, source:long, source_first:long>>")
    schema = T.StructType([*kinds, *found.fields])

    def remove(table: pa.Table, lost: pa.Table) -> pa.Table:
        give_back()
        texts = unzip_array(table.column("t"))
        data, offsets = text_bytes(texts)
        words = Words(data, offsets)
        starts, _, h = _windows(words, n)
        k1 = grams(h, n)[starts]
        ids = keys_of(table, words, starts)
        places = starts - words.first[words.rows[starts]]
        order = np.lexsort((places, ids, k1))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(k1[order].view(np.int64)) != 0
        best = np.empty(len(order), np.int64)
        best[order] = order[new][np.cumsum(new) - 1]  # the first of each window among these documents
        source, origin = ids[best], places[best]
        # A hot window comes back from its share and from all shares; the smaller key counts.
        theirs = _column(lost, "k1").view(np.uint64), _column(lost, "first"), _column(lost, "place").astype(np.int64)
        by = np.lexsort(theirs[::-1])
        k, where = np.unique(theirs[0][by], return_index=True)
        if len(k):
            at = np.minimum(np.searchsorted(k, k1), len(k) - 1)
            first, place = theirs[1][by][where[at]], theirs[2][by][where[at]]
            other = (k[at] == k1) & (first < source)
            source, origin = np.where(other, first, source), np.where(other, place, origin)
        gone = ids > source
        inside = np.zeros(len(h) + 1, np.int32)
        np.add.at(inside, starts[gone], 1)
        np.subtract.at(inside, starts[gone] + n, 1)
        covered = np.cumsum(inside[:-1]) > 0
        removed = np.bincount(words.rows[covered], minlength=table.num_rows)
        # A repeat goes on in both directions as long as the next window follows in the same source.
        match, source, origin = starts[gone], source[gone], origin[gone]
        begins = np.ones(len(match), bool)
        begins[1:] = (np.diff(match) != 1) | (words.rows[match[1:]] != words.rows[match[:-1]]) | (np.diff(source) != 0) | (np.diff(origin) != 1)
        at = np.flatnonzero(begins)
        ends = match[np.append(at[1:], len(match)) - 1] + n if len(at) else at
        spans = {"first": match[at] - words.first[words.rows[match[at]]], "words": ends - match[at], "source": source[at], "source_first": origin[at]}
        spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans.values()], list(spans))
        upto = np.searchsorted(words.rows[match[at]], np.arange(table.num_rows + 1)).astype(np.int32)
        repeats = pa.ListArray.from_arrays(pa.array(upto), spans)
        raw = data.tobytes()
        kept = []
        for i in range(table.num_rows):
            own = raw[offsets[i] : offsets[i + 1]].split()
            if removed[i]:
                own = compress(own, (~covered[words.first[i] : words.first[i + 1]]).tolist())
            kept.append(b" ".join(own).decode())
        out = {name: texts if name == "t" else table.column(name) for name in fields}
        return pa.table({**out, "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "removed": repeats})

    cut = rows.groupBy("part").cogroup(lost.groupBy("in_part")).applyInArrow(remove, schema)
    names = [F.col("k").alias(key), *[F.col("t").alias(text)] * keep_text, *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]]
    return cut.select(*names, "n_words", "n_removed", "kept_text", "removed")


def op6_substring_dedup(spark, sf_dir):
    """What is left of every document's words."""
    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


