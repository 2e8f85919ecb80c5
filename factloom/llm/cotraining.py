"""Quality classifier by co-training of a text view and a page-metadata view (operator 3)."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpointed, chunks, give_back, grams, mix, small_batches, text_bytes

#: Features of the text view (hashed words, word pairs and marks) and of the metadata view (hashed
#: language and source, and measures of the page's shape).
TEXT_FEATURES, PAGE_FEATURES = 1 << 14, 1 << 8
#: Labelled documents of each label that the models are fitted on at most (those with the least hashes).
#: All other documents take part in every round, and all are scored.
PER_LABEL = 1500
#: Rounds, and the least calibrated probability of a pseudo-label.
ROUNDS, SURE = 5, 0.9
#: Weight of a pseudo-label; those of one label weigh together at most this times its labelled rows.
GIVEN_WEIGHT = 0.5
#: Sums over documents are whole numbers of 1 / UNIT, so that they are the same in any order and
#: partitioning; they travel in slots of SLOT numbers.
UNIT, SLOT = 1 << 20, 1 << 12
EPOCHS, RATE, PENALTY = 10, 0.5, 1e-4
SHAPE = 8


def text_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse text features of each text: (row starts, feature, log count), from whole texts."""
    words = Words(data, offsets)
    h = words.hashes()
    pairs = grams(h, 2)
    valid = np.flatnonzero(words.rows[: len(pairs)] == words.rows[1:]) if len(pairs) else np.zeros(0, np.int64)
    marks = np.flatnonzero((data < 128) & ~_ALNUM[data])
    mark_rows = np.searchsorted(offsets, marks, "right") - 1
    with np.errstate(over="ignore"):
        mark_hash = mix(data[marks].astype(np.uint64) + np.uint64(1 << 40))
    feature = np.concatenate([h, pairs[valid], mark_hash]) >> np.uint64(64 - 14)
    row = np.concatenate([words.rows, words.rows[valid], mark_rows])
    code, counts = np.unique(row.astype(np.int64) * TEXT_FEATURES + feature.astype(np.int64), return_counts=True)
    row = code // TEXT_FEATURES
    return np.searchsorted(row, np.arange(len(offsets))), (code % TEXT_FEATURES).astype(np.int32), np.log1p(counts).astype(np.float32)


_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum() or chr(b).isspace()]] = True


def page_rows(data: np.ndarray, offsets: np.ndarray, lang: list, source: list) -> np.ndarray:
    """Metadata features: hashed language, source and their pair, and the shape of the page in bytes."""
    out = np.zeros((len(offsets) - 1, PAGE_FEATURES), np.float32)
    size = np.diff(offsets).astype(np.float64)

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets])

    lines, blanks, marks = per_row(data == 10), per_row(data == 32), per_row((data < 128) & ~_ALNUM[data])
    some = np.maximum(size, 1)
    shape = [np.ones_like(size), np.log1p(size) / 10, np.log1p(lines) / 5, np.log(some / (lines + 1) + 1) / 6, blanks / some * 3, np.sqrt(marks / some), np.log(some / (blanks + 1) + 1) / 3, size == 0]
    out[:, :SHAPE] = np.stack(shape, 1)
    for i, (a, b) in enumerate(zip(lang, source, strict=True)):
        for name in (f"l:{a}", f"s:{b}", f"ls:{a}:{b}"):
            out[i, SHAPE + zlib.crc32(name.encode()) % (PAGE_FEATURES - SHAPE)] += 0.3
    return out


@dataclass
class Given:
    """A quadratic bound on the loss of a view's pseudo-labelled rows, around the weights at which
    they were summed: slope and curvature of each weight and of the bias."""

    weights: np.ndarray
    bias: float
    slope: np.ndarray
    curve: np.ndarray
    slope_b: float
    curve_b: float


@dataclass
class View:
    """A logistic regression with Platt's two numbers for calibration."""

    size: int
    weights: np.ndarray = field(default=None)  # type: ignore[assignment]
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(x @ self.weights[at] + self.bias)

    def calibrated(self, raw):
        return self.scale[0] * raw + self.scale[1]

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int, given: Given | None = None) -> None:
        """Adaptive gradient steps on labelled rows; after each pass over them a proximal step in the
        same metric on the bound that `given` sets to the loss of all pseudo-labelled rows."""
        w, n, b, nb = np.zeros(self.size), np.full(self.size, 1e-8), 0.0, 1e-8
        for epoch in range(EPOCHS):
            for i in np.random.default_rng([seed, epoch]).permutation(len(rows)):
                at, x = rows[i]
                g = 1 / (1 + np.exp(-np.clip(x @ w[at] + b, -30, 30))) - y[i]
                step = g * x + PENALTY * w[at]
                n[at] += step * step
                w[at] -= RATE * step / np.sqrt(n[at])
                nb += g * g
                b -= RATE * g / np.sqrt(nb)
            if given is not None:
                metric, metric_b = np.sqrt(n) / RATE, np.sqrt(nb) / RATE
                w = (metric * w + given.curve * given.weights - given.slope) / (metric + given.curve)
                b = (metric_b * b + given.curve_b * given.bias - given.slope_b) / (metric_b + given.curve_b)
        self.weights, self.bias = w.astype(np.float32), float(b)

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps, with targets drawn in by one pseudo-count of each label."""
        pos, neg = float(y.sum()), float(len(y) - y.sum())
        target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            g = np.array([((p - target) * raw).sum() + 1e-3 * (a - 1), (p - target).sum()])
            v = p * (1 - p)
            h = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
        self.scale = (max(a, 0.0), b)


@dataclass
class CoTrained:
    """Two views, calibrated to the labels as they stand in the whole table (`shift`: by how much their
    log odds are above the fitted sample's); a document's score combines them."""

    text: View
    page: View
    prior: float
    given: list[tuple[int, int]]
    shift: float = 0.0

    def score(self, text_logit: np.ndarray, page_logit: np.ndarray) -> np.ndarray:
        """Views that are independent given the label add their log odds, less the prior's once."""
        return 1 / (1 + np.exp(-np.clip(text_logit + page_logit - self.prior + self.shift, -30, 30)))


def no_sums() -> list[list[np.ndarray]]:
    """Of each view and label: rows, slope and curvature of the bias, then those of all weights."""
    return [[np.zeros(3 + 2 * size, np.int64) for _ in range(2)] for size in (TEXT_FEATURES, PAGE_FEATURES)]


def add_given(sums: list[list[np.ndarray]], views: list[View], row: tuple, shift: float = 0.0) -> None:
    """Adds an unlabelled row (text row, page row) to the sums of each view that the other is sure for.

    The curvature |x| * sum|x| / 4 of a weight bounds the logistic loss everywhere.
    """
    raw = [view.raw(*row[k]) for k, view in enumerate(views)]
    for k, view in enumerate(views):
        if view.scale[0] <= 0:  # what tells nothing about the label gives none
            continue
        p = 1 / (1 + np.exp(-np.clip(view.calibrated(raw[k]) + shift, -30, 30)))
        if 1 - SURE < p < SURE:
            continue
        label, to, (at, x) = int(p >= SURE), 1 - k, row[1 - k]
        x = x.astype(float)
        g = 1 / (1 + np.exp(-np.clip(raw[to], -30, 30))) - label
        most = (np.abs(x).sum() + 1) / 4
        s, size = sums[to][label], views[to].size
        s[:3] += 1, round(g * UNIT), round(most * UNIT)
        s[3 + at] += np.rint(g * x * UNIT).astype(np.int64)
        s[3 + size + at] += np.rint(np.abs(x) * most * UNIT).astype(np.int64)


def co_train(labelled: list, exchange: Callable[[list[View], float], list[list[np.ndarray]]], odds: float, seed: int = 5) -> CoTrained:
    """Fits on (y, text row, page row) and on the pseudo-labels that the views give each other; `odds`
    are the log odds of label 1 among all labels, of which the rows may hold a different share.

    A quarter of the labelled rows is kept back for calibration alone. In each round both views are
    fitted and calibrated, and `exchange` sums over every unlabelled row that a view is sure of, with
    a probability of SURE or more, what it tells the other view.
    """
    order = np.random.default_rng(seed).permutation(len(labelled))
    held, used = order[: len(order) // 4], order[len(order) // 4 :]
    y = np.array([labelled[i][0] for i in used], float)
    yh = np.array([labelled[i][0] for i in held], float)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    # Calibration sees the held rows, so its probabilities are those of a table with their odds.
    shift = odds - float(np.log((yh.sum() + 1) / (len(yh) - yh.sum() + 1)))
    views = [View(TEXT_FEATURES), View(PAGE_FEATURES)]
    pulls: list[Given | None] = [None, None]
    given = []
    for turn in range(ROUNDS + 1):
        for k, view in enumerate(views):
            view.fit([labelled[i][k + 1] for i in used], y, seed, pulls[k])
            view.calibrate(np.array([view.raw(*labelled[i][k + 1]) for i in held]), yh)
        if turn == ROUNDS:
            break
        sums = exchange(views, shift)
        counts = [[int(s[0]) for s in of] for of in sums]
        given.append((sum(counts[1]), sum(counts[0])))  # by the view that gives
        if not any(given[-1]):
            break
        for k, view in enumerate(views):
            share = [GIVEN_WEIGHT * min(1.0, float((y == c).sum()) / max(1, counts[k][c])) / UNIT for c in (0, 1)]
            both = share[0] * sums[k][0] + share[1] * sums[k][1]
            pulls[k] = Given(view.weights, view.bias, both[3 : 3 + view.size], both[3 + view.size :], both[1], both[2])
    return CoTrained(*views, prior, given, shift)


def _normal(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x)
    return x / norm * 3 if norm else x


def _views(batch: pa.RecordBatch):
    """(text row, page row) of each row of a batch (text, lang, source, ...), in order."""
    data, offsets = text_bytes(batch.column(0))
    lang, source = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for a, b in chunks(offsets):
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        first, feature, value = text_rows(own, at)
        page = page_rows(own, at, lang[a:b], source[a:b])
        for i in range(b - a):
            cols = np.flatnonzero(page[i])
            yield (feature[first[i] : first[i + 1]], _normal(value[first[i] : first[i + 1]])), (cols, page[i, cols])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> CoTrained | None:
    """Fits the classifier on a bounded sample of labelled documents and on all others, of which every
    round reads each one; None without both labels."""
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(f"`{key}`").alias("lk"), F.col(f"`{label}`").cast("int").alias("y")).where("lk IS NOT NULL AND y IN (0, 1)").groupBy("lk").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return None
    draw = F.xxhash64(F.lit(31), "lk")
    chosen = checkpointed(marks.where("y = 1").orderBy(draw, "lk").limit(PER_LABEL).unionByName(marks.where("y = 0").orderBy(draw, "lk").limit(PER_LABEL)))
    rows = docs.select(F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col(f"`{key}`").alias("k"))
    known = rows.join(F.broadcast(chosen), F.col("k") == F.col("lk"))  # 2 * PER_LABEL rows
    known = known.groupBy("k").agg(F.min(F.struct("text", "lang", "source", "y")).alias("row")).select("row.text", "row.lang", "row.source", "k", "row.y")
    rest = rows.where("k IS NOT NULL").join(F.broadcast(chosen), F.col("k") == F.col("lk"), "left_anti").select("text", "lang", "source")

    def sample(batches):
        for batch in batches:
            got = [[x.tobytes() for x in (t[0].astype(np.int32), t[1].astype(np.float32), p[0].astype(np.int32), p[1].astype(np.float32))] for t, p in _views(batch)]
            columns = [pa.array([g[i] for g in got], pa.binary()) for i in range(4)]
            yield pa.record_batch([batch.column(3), batch.column(4), *columns], ["k", "y", "ti", "tx", "pi", "px"])

    kind = docs.schema[key].dataType.simpleString()
    found = known.mapInArrow(sample, f"k {kind}, y int, ti binary, tx binary, pi binary, px binary").collect()
    found = sorted(found, key=lambda r: (str(r.k), r.ti, r.tx))
    read = lambda r: (r.y, (np.frombuffer(r.ti, np.int32), np.frombuffer(r.tx, np.float32)), (np.frombuffer(r.pi, np.int32), np.frombuffer(r.px, np.float32)))
    odds = float(np.log(sizes[1] / sizes[0]))
    return co_train([read(r) for r in found], lambda views, shift: _exchange(rest, views, shift), odds)


def _exchange(rest: DataFrame, views: list[View], shift: float) -> list[list[np.ndarray]]:
    """`add_given` over all rows (text, lang, source): a pass without an exchange of rows, whose sums
    are added up slot by slot."""
    shared = rest.sparkSession.sparkContext.broadcast(views)  # TEXT_FEATURES + PAGE_FEATURES numbers

    def slots(sums):
        for k in range(2):
            for c in range(2):
                for slot in range(0, len(sums[k][c]), SLOT):
                    part = sums[k][c][slot : slot + SLOT]
                    if part.any():
                        yield 2 * k + c, slot, part.tobytes()

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["part", "slot", "sums"])

    def add(batches):
        sums = no_sums()
        for batch in batches:
            for row in _views(batch):
                add_given(sums, shared.value, row, shift)
        give_back()
        yield batch_of(slots(sums))

    def total(batches):
        done: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, slot, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = np.frombuffer(data, np.int64)
                done[part, slot] = done[part, slot] + more if (part, slot) in done else more
        yield batch_of([(*at, x.tobytes()) for at, x in done.items()])

    schema = "part int, slot int, sums binary"
    sums = no_sums()
    for r in rest.mapInArrow(add, schema).repartition(8, "part", "slot").mapInArrow(total, schema).collect():
        x = np.frombuffer(r.sums, np.int64)
        sums[r.part // 2][r.part % 2][r.slot : r.slot + len(x)] = x
    shared.unpersist()
    return sums


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(key, text_score, page_score, score, kept) of every row of `docs` (key, text, lang, source).

    score is the calibrated probability of label 1 from both views; kept is score >= threshold.
    Learns from `labels` (key, label 0 or 1; others are ignored, of several the largest counts), of
    which a bounded sample is drawn (of rows with one key the smallest is learnt from); every other
    document with a key counts as unlabelled. A
    null text is scored as an empty one, null language and source are values of their own; without
    documents of both labels every score is 0.5. Rows with a null key are scored and never learnt
    from; equal rows get equal scores; an empty table gives an empty result; other columns are
    ignored.
    """
    model = train(docs, labels, key, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TEXT_FEATURES + PAGE_FEATURES numbers
    rows = docs.select("text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col(f"`{key}`").alias("k"))

    def score(batches):
        m = shared.value
        for batch in batches:
            logits = np.zeros((batch.num_rows, 2))
            if m is not None:
                for i, (t, p) in enumerate(_views(batch)):
                    logits[i] = m.text.raw(*t), m.page.raw(*p)
                logits = np.stack([m.text.calibrated(logits[:, 0]), m.page.calibrated(logits[:, 1])], 1)
            both = m.score(logits[:, 0], logits[:, 1]) if m is not None else np.full(batch.num_rows, 0.5)
            views = 1 / (1 + np.exp(-np.clip(logits + (m.shift if m is not None else 0), -30, 30)))
            yield pa.record_batch([batch.column(3), pa.array(views[:, 0]), pa.array(views[:, 1]), pa.array(both)], ["k", "text_score", "page_score", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = rows.mapInArrow(score, f"k {kind}, text_score double, page_score double, score double")
    return scored.select(F.col("k").alias(key), "text_score", "page_score", "score", (F.col("score") >= threshold).alias("kept"))


def op3_quality_classifier(spark, sf_dir):
    """Quality of every document."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
