"""Importance resampling towards a target corpus: hashed n-gram weights, Gumbel keys, quickselect (operator 11)."""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back, slices, small_batches

#: Bytes of one text that are split at once, and words whose buckets a task remembers.
PIECE, KNOWN = 1 << 20, 1 << 17
#: What every byte becomes: small letters, digits and bytes above 127 stay, capitals A-Z are lowered, all else parts words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The place of a row in its partition, in the numbers that Spark gives to rows.
_PLACE = (1 << 33) - 1


class _Buckets(dict):
    """The bucket of a feature; those met first are remembered, which changes no result."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.n
        if len(self) < KNOWN:
            self[feature] = bucket
        return bucket


def _features(text: bytes, longest: int):
    """Lists of the runs of 1 to `longest` words of a text, a piece of the text at a time."""
    at, tail = 0, []
    while at < len(text):
        to = at + PIECE
        while to < len(text) and _LOWER[text[to]] != 32:  # a piece ends where a word does
            to += 1
        words = text[at:to].translate(_LOWER).split()
        found = words
        if longest > 1:
            found, joined = list(words), tail + words
            for n in range(2, longest + 1):
                found += [b" ".join(joined[i : i + n]) for i in range(max(0, len(tail) - n + 1), len(joined) - n + 1)]
            tail = joined[-(longest - 1) :]
        yield found
        at = to


def bucket_counts(docs: DataFrame, text: str, longest: int, buckets: int) -> list[int]:
    """How often each bucket's features stand in all texts. Tasks sum first; `buckets` numbers come back."""

    def count(batches):
        of, sums = _Buckets(buckets), np.zeros(buckets, np.int64)
        for part in (p for b in batches for p in slices([b])):
            for t in part.column(0).cast(pa.binary()):
                for found in _features(t.as_py() or b"", longest):
                    sums += np.bincount(np.fromiter(map(of.__getitem__, found), np.int64, len(found)), minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(used), pa.array(sums[used])], ["bucket", "n"])
        give_back()

    out = [0] * buckets
    for r in docs.select(F.col(f"`{text}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of (how much of the target over how much of the source)) of each bucket, in doubles."""
    m, s, t = len(source), float(sum(source)), float(sum(target))
    return np.array([math.floor(1000.0 * math.log((float(b) + 1) * (s + m) / ((float(a) + 1) * (t + m)))) for a, b in zip(source, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(id, row, n_words, n_features, weight) of docs (id, row, text): a document's buckets as an array, scored at once."""

    def score(batches):
        of = _Buckets(len(gain))
        for part in (p for b in batches for p in slices([b])):
            words, sizes, weights = [], [], []
            for t in part.column(2).cast(pa.binary()):
                raw = t.as_py() or b""
                size = weight = 0
                for found in _features(raw, longest):
                    ids = np.fromiter(map(of.__getitem__, found), np.int64, len(found))
                    size, weight = size + len(ids), weight + int(gain[ids].sum())
                # Of w words come w, w - 1, w - 2, ... runs.
                words.append(size if longest == 1 else sum(len(x) for x in _features(raw, 1)))
                sizes.append(size)
                weights.append(weight)
            yield pa.record_batch([part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (words, sizes, weights)]], ["id", "row", "n_words", "n_features", "weight"])
        give_back()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "row", "text").mapInArrow(score, f"id {kind}, row long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of SHA-256 of `seed:key`."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((bits + 0.5) / 4294967296.0)))


def kth_key(rows: DataFrame, fields: list[str], k: int, pivots: int = 15) -> dict | None:
    """The k-th smallest (from 1) of the distinct keys `fields`, compared from left to right; None if there are fewer.

    Each round draws `pivots` keys at random from those still possible, counts exactly how many keys are
    below and at each, and goes on between the two around place k. Only pivots and their counts come to
    the driver. What is left is written anew when it is a fourth of what is read, so that all rounds
    together read little more than the first.
    """
    key, names = F.struct(*fields), [f"p{i}" for i in range(len(fields))]
    literal = lambda p: F.struct(*[F.lit(p[n]).cast(rows.schema[c].dataType).alias(c) for n, c in zip(names, fields, strict=True)])
    inside, n, written, turn = rows.select(*fields), rows.count(), rows.count(), 0
    if not 0 < k <= n:
        return None
    while True:
        turn += 1
        drawn = inside.orderBy(F.xxhash64(*fields, F.lit(turn))).limit(pivots)
        drawn = drawn.select(*[F.col(c).alias(a) for c, a in zip(fields, names, strict=True)]).orderBy(*[F.col(a).asc_nulls_first() for a in names]).collect()
        marks = [literal(p) for p in drawn]
        sums = inside.agg(*[f.alias(f"{x}{i}") for i, p in enumerate(marks) for x, f in (("less", F.count_if(key < p)), ("same", F.count_if(key == p)))]).first()
        below, low, high = 0, None, None
        for i, p in enumerate(drawn):
            less, same = sums[f"less{i}"], sums[f"same{i}"]
            if less < k <= less + same:
                return dict(zip(fields, p, strict=True))
            if k <= less:
                high, n = marks[i], less
                break
            low, below = marks[i], less + same
        if low is not None:
            inside = inside.where(key > low)
        if high is not None:
            inside = inside.where(key < high)
        n, k = n - below, k - below
        if 4 * n <= written:
            inside, written = checkpointed(inside), n


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with `rank` from 1 in a total order: dealt by ranges, sorted there, and counted. Rows never meet in one task;
    a number for each range comes to the driver."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = checkpointed(sorted_.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("__at")))
    before, offsets = 0, []
    for r in sorted_.groupBy("__range").count().orderBy("__range").collect():
        offsets.append((r["__range"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(offsets, "__range int, __before long")
    return sorted_.join(F.broadcast(starts), "__range").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def importance_resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """key, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    Words are runs of letters a to z, digits and characters above 127 once A to Z are lowered; features are all runs of 1 to `longest` words.
    A document's weight is the sum of its features' gains (see `gains`), its score adds Gumbel noise of the
    key, so that the highest scores are a draw without replacement in proportion to exp(weight / 1000).
    Of the N documents with `least_words` words, floor(percent N / 100) are drawn and ranked.

    The corpus is counted in one pass, scored in a second one; rows of numbers are kept in the shared folder.
    The last score that is drawn is found by `kth_key` on (score, key, n_features, row); winners alone are sorted. Ties
    go to the smaller key, a null key is the largest (and hashes as empty text), of repeated rows any is taken, as they
    are equal in all columns returned. A null text has no words, an empty table gives an empty result,
    an empty target weighs every bucket by the source alone; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    gain = gains(bucket_counts(docs, "text", longest, buckets), bucket_counts(target, target_text, longest, buckets))
    scored = weighed(docs, gain, longest).withColumns({"score": F.col("weight") + gumbel(F.col("id"), seed), "last": F.col("id").isNull(), "less": -(F.col("weight") + gumbel(F.col("id"), seed))})
    scored = checkpointed(scored)
    fits = scored.where(F.col("n_words") >= least_words)
    k = percent * fits.count() // 100
    fields = ["less", "last", "id", "n_features", "row"]
    mark = kth_key(fits, fields, k) if k else None
    out = lambda rows, rank: rows.select(F.col("id").alias(key), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if mark is None:
        return out(scored, F.lit(None))
    bound = F.struct(*[F.lit(mark[c]).cast(scored.schema[c].dataType).alias(c) for c in fields])
    wins = (F.col("n_words") >= least_words) & (F.struct(*fields) <= bound)
    winners = ranked(scored.where(wins), [F.col(c).asc_nulls_first() for c in fields])
    return out(scored.where(~wins), F.lit(None)).unionByName(out(winners, F.col("rank")))


def op11_importance_resampling(spark, sf_dir):
    """A tenth of the documents, drawn towards the texts of `benchmark`."""
    return importance_resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS tab),
v AS (SELECT word, hex(word) AS h FROM (SELECT word FROM w UNION SELECT word FROM b)),
k AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)]), 4294967295)) % 10000 AS bucket FROM v, crc),
c AS (SELECT doc_id, bucket, count(*) AS n FROM w JOIN k USING (word) GROUP BY doc_id, bucket),
s AS (SELECT bucket, sum(n) AS s FROM c GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS turn FROM e WHERE n_features >= 20)
SELECT doc_id, e.n_features, e.weight, e.score, CASE WHEN turn <= (SELECT 10 * count(*) // 100 FROM r) THEN turn END AS rank FROM e LEFT JOIN (SELECT doc_id, turn FROM r) USING (doc_id)
"""
