"""Language identification by sparse multinomial logistic regression (operator 4)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, small_batches

#: Bits of hashed n-gram features, the longest n-gram, and the documents of each language, and of all
#: languages together, that the model is fitted on (they are drawn by a hash). Everything else covers
#: all documents.
BITS, LONGEST, PER_LANGUAGE, SAMPLE = 15, 3, 400, 40_000
#: Bits of the number of weights: with more than 2 ** (WEIGHTS - BITS) languages, n-grams fall into
#: fewer features, so that a model of any number of languages keeps to about 2 ** WEIGHTS numbers.
WEIGHTS = 25
#: Follow-the-regularised-leader: learning rate and its offset, penalties, epochs.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3
#: Characters that one numpy pass looks at.
BLOCK = 1 << 20
_PRIMES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def feature_bits(n_languages: int) -> int:
    """Bits of the features of a model of so many languages."""
    return max(8, min(BITS, WEIGHTS - (max(1, n_languages) - 1).bit_length()))


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """How often each hashed character n-gram of length 1 to LONGEST occurs in a text in lower case."""
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, len(text), BLOCK):
        piece = text[at : at + BLOCK + LONGEST - 1].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        full = at + BLOCK + LONGEST - 1 < len(text)
        h = np.zeros(len(points), np.uint32)
        for n in range(1, LONGEST + 1):
            h = (h[: len(points) - n + 1] * _PRIMES[0]) ^ (points[n - 1 :] * _PRIMES[1] + np.uint32(n))
            own = h[: BLOCK] if full else h
            mixed = (own ^ (own >> np.uint32(15))) * _PRIMES[2]
            counts += np.bincount(mixed >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


@dataclass
class Model:
    """Weights by feature and language; scores are softmax(x @ weights + bias) at a temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    @property
    def bits(self) -> int:
        return len(self.idf).bit_length() - 1

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of a text's TF-IDF vector of length one."""
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        norm = np.linalg.norm(x)
        return at, x / norm if norm else x

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, seed: int = 7) -> Model:
    """Fits on (language, indices, counts) of a bounded sample: four fifths train, one fifth calibrates.

    FTRL-Proximal with elastic net: each weight follows from its accumulated gradients in closed form
    and is zero while they stay within L1. The temperature is the one with the least log loss on the
    fifth that was kept back.
    """
    languages = sorted({s[0] for s in samples})
    c = len(languages)
    features = len(idf)
    model = Model(languages, idf, np.zeros((features, c)), np.zeros(c))
    if c < 2:
        return model
    vectors = []
    for lang, at, counts in samples:
        dense = np.zeros(features, np.int64)
        dense[at] = counts
        vectors.append((languages.index(lang), *model.vector(dense)))
    order = np.random.default_rng(seed).permutation(len(vectors))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    z, n = np.zeros((features, c)), np.zeros((features, c))
    zb, nb = np.zeros(c), np.zeros(c)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng([seed, epoch]).permutation(train):
            y, at, x = vectors[i]
            w, b = weights(z[at], n[at]), -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            error = model.probabilities(x @ w + b)
            error[y] -= 1
            g = x[:, None] * error[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            step = (np.sqrt(nb + error * error) - np.sqrt(nb)) / ALPHA
            zb += error - step * b
            nb += error * error
    model.weights, model.bias = weights(z, n), -zb / ((BETA + np.sqrt(nb)) / ALPHA)
    if len(held):
        logits = np.stack([model.logits(*vectors[i][1:]) for i in held])
        truth = np.array([vectors[i][0] for i in held])
        grid = np.exp(np.linspace(np.log(0.02), np.log(10), 200))

        def loss(t: float) -> float:
            model.temperature = t
            logs = np.log(np.maximum(model.probabilities(logits), 1e-300))
            doubt = 1 / (len(held) + 2)  # as if one more were wrong, so that no score is certain
            return -((1 - doubt) * logs[np.arange(len(held)), truth].mean() + doubt * logs.mean())

        model.temperature = float(min(grid, key=loss))
    return model


def held_out(key: Column) -> Column:
    """The documents that training may not see: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits a model on texts and non-null languages of the documents that aren't held out.

    Document frequencies are counted over all training documents. The weights are fitted on the
    driver on a bounded sample: of each language the PER_LANGUAGE documents with the least hashes, or
    an equal share of SAMPLE in all if there are many languages.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(F.col(f"`{key}`"))).where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    sizes = checkpointed(rows.groupBy("l").agg(F.count("*").alias("n")))
    n_languages = sizes.count()
    bits, quota = feature_bits(n_languages), max(2, min(PER_LANGUAGE, SAMPLE // max(1, n_languages)))
    features = 1 << bits
    # About twice the quota by the hash first, so that the exact choice orders few rows.
    draw = F.abs(F.xxhash64(F.lit(29), "k", F.crc32(F.col("t").cast("binary"))) / F.lit(float(1 << 63)))
    drawn = rows.withColumn("draw", draw).join(F.broadcast(sizes) if n_languages <= SAMPLE else sizes, "l").where(F.col("draw") < 2 * (quota + 20) / F.col("n"))
    first = Window.partitionBy("l").orderBy("draw", "k")
    picked = drawn.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= quota)

    def frequencies(batches):
        df, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df += ngram_counts(t.as_py(), bits) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "df"])

    counted = rows.select("t").mapInArrow(frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))
    df, total = np.zeros(features), 0
    for r in counted.collect():  # a row per feature at most
        if r.feature < 0:
            total = r.df
        else:
            df[r.feature] = r.df
    idf = np.log((1 + total) / (1 + df)) + 1

    def sample(batches):
        for batch in batches:
            out = [ngram_counts(t.as_py(), bits) for t in batch.column(0)]
            at = [np.flatnonzero(c) for c in out]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for c, a in zip(out, at, strict=True)], pa.binary())], ["l", "k", "at", "counts"])

    rows = picked.select("t", "l", F.col("k").cast("string").alias("k")).mapInArrow(sample, "l string, k string, at binary, counts binary")
    samples = sorted(((r.l, r.k or "", r.at, r.counts) for r in rows.collect()))
    return fit([(lang, np.frombuffer(at, np.int32), np.frombuffer(n, np.int32).astype(np.int64)) for lang, _, at, n in samples], idf)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row, from the whole text alone.

    `und` with score 0 where the text is null or has no letter, or no language was learnt.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 2 ** WEIGHTS numbers at most
    letters = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.when(letters, F.col(f"`{text}`")).alias("t"))

    def score(batches):
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for t in batch.column(1):
                if not t.is_valid or not m.languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = m.probabilities(m.logits(*m.vector(ngram_counts(t.as_py(), m.bits))))
                best = int(p.argmax())
                names.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["k", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(score, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) for every row of `docs`, learnt from the rows not held out.

    A null language is not learnt from, a null key is never held out. Equal texts get equal
    predictions; repeated rows weigh as often as they stand. Without any learnt language everything
    is `und`. An empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, key, text, lang)
    return predict(docs, model, key, text).withColumn("held_out", held_out(F.col(f"`{key}`"))).select(f"`{key}`", "held_out", "lang_pred", "score")


def op4_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
