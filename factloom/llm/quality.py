"""Quality rules and robust multivariate outliers per language and source (operator 10)."""

from __future__ import annotations

from functools import reduce
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Words, checkpointed, chunks, give_back, grams, join_groups, mix, small_batches, text_bytes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Columns of the vector, and the least standard deviation that an estimate may have in each: what
#: is as regular as a template gives no reason to reject a slightly less regular document. In a group
#: without repeats those of x_lines and x_repeats alone reject from 75 % of repeated lines and from
#: 48 % of words in repeated windows, so that either can.
FEATURES = {"x_length": 0.12, "x_symbols": 0.04, "x_lines": 0.15, "x_repeats": 0.12}
#: Share of a group's documents that the covariance fits (h), the most steps of concentration, and the
#: tail beyond which a vector is rejected.
SHARE, TAIL = 0.75, 1e-6
#: Rows that a group's parent (its language; of a language all rows) counts for in the group's estimate.
PARENT_ROWS = 50
#: Distances are cut at h on a logarithmic scale of GRAIN steps a unit, and within the step that holds
#: the h-th row at FINE as many.
GRAIN, FINE = 16, 1 << 16
#: Starts from which a group's subset is concentrated; the least determinant counts.
STARTS = 3
#: Groups whose estimates are broadcast (some 300 bytes each); more are joined by exchange.
MOST_BROADCAST = 10_000
#: Narrow rows (vectors and sums) that one task gets in the steps of the estimate.
TASK_ROWS = 100_000
#: Name of all sources of a language or of all rows, and of failed rows; no language or source holds a NUL.
ALL, NONE = "\0all", "\0none"
STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def chi2_cdf(x: float, df: int) -> float:
    """The chi-squared distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return 1 - exp(-x / 2) * total


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines to each row.

    Whole texts, in passes over a few MB of bytes at a time; a null text counts as empty. Words in
    three-word windows are compared by 64-bit hashes within their document.
    """
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([f for f in rows.schema if f.name != "__text"] + [T.StructField(c, T.LongType()) for c in STAT_COLUMNS])

    def count(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text"))
            data, offsets = text_bytes(column)
            parts = [_statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
            values = np.concatenate(parts) if parts else np.zeros((0, len(STAT_COLUMNS)), np.int64)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(STAT_COLUMNS))]
            yield pa.record_batch(columns, [*keep, *STAT_COLUMNS])
        give_back()

    return rows.mapInArrow(count, schema)


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    words = Words(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, len(STAT_COLUMNS)), np.int64)
    out[:, 0] = words.counts

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offsets])

    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.starts] += 1
    np.subtract.at(inside, words.ends, 1)
    out[:, 1] = per_row((np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80))
    out[:, 2] = per_row(SYMBOLS[data])
    h = words.hashes()
    with np.errstate(over="ignore"):
        g = mix(grams(h, 3) + words.rows[: max(0, len(h) - 2)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    valid = np.flatnonzero(words.rows[: len(g)] == words.rows[2:]) if len(g) else np.zeros(0, np.int64)
    if len(valid):
        _, inverse, times = np.unique(g[valid], return_inverse=True, return_counts=True)
        again = valid[times[inverse] > 1]
        covered = np.zeros(len(h), bool)
        for j in range(3):
            covered[again + j] = True
        out[:, 4] = np.bincount(words.rows[covered], minlength=n)
    raw = data.tobytes()
    for i in range(n):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        out[i, 5] = len(lines)
        out[i, 3] = len(lines) - len(set(lines))
    return out


def features() -> dict[str, Column]:
    """The statistics transformed so that ordinary documents spread about evenly around a centre."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars") + F.col("n_symbols"), F.lit(1))),
        "x_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
SUMS = ["n", *[f"s{i}" for i in range(len(FEATURES))], *[f"q{i}{j}" for i, j in PAIRS]]


def _matrix(frame, start: str, n: np.ndarray) -> np.ndarray:
    """Symmetric matrices (rows x d x d) from columns of sums over n."""
    out = np.zeros((len(frame), len(FEATURES), len(FEATURES)))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = frame[f"{start}{i}{j}"].to_numpy(float) / n
    return out


def _moments(frame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of each row of sums."""
    n = np.maximum(frame["n"].to_numpy(float), 1e-9)
    mean = np.stack([frame[f"s{i}"].to_numpy(float) / n for i in range(len(FEATURES))], 1)
    return mean, _matrix(frame, "q", n) - mean[:, :, None] * mean[:, None, :]


ESTIMATE = "g_lang string, g_source string, start int, size double, centre array<double>, cov array<double>, inverse array<double>, logdet double"


def _named(frame, start, size, mean: np.ndarray, cov: np.ndarray):
    """Rows of ESTIMATE; the floors are part of every inverse and determinant."""
    d = len(FEATURES)
    full = cov + np.diag(np.array(list(FEATURES.values())) ** 2)
    out = frame[["g_lang", "g_source"]].copy()
    out["start"], out["size"] = start, size
    out["centre"], out["cov"] = list(mean), list(cov.reshape(len(frame), d * d))
    out["inverse"] = list(np.linalg.inv(full).reshape(len(frame), d * d)) if len(frame) else []
    out["logdet"] = np.linalg.slogdet(full)[1] if len(frame) else []
    return out


def consistency() -> float:
    """What the covariance of the SHARE nearest rows of a normal distribution is scaled by."""
    d = len(FEATURES)
    return SHARE / chi2_cdf(chi2_quantile(SHARE, d), d + 2)


def _sums() -> list[Column]:
    names = list(FEATURES)
    products = [F.expr(f"sum({names[i]} * {names[j]})").alias(f"q{i}{j}") for i, j in PAIRS]
    return [F.expr("CAST(count(*) AS DOUBLE)").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *products]


def _distance() -> Column:
    d = len(FEATURES)
    off = [f"({c} - centre[{i}])" for i, c in enumerate(FEATURES)]
    return F.expr(f"greatest({' + '.join(f'{off[i]} * {off[j]} * inverse[{i * d + j}]' for i in range(d) for j in range(d))}, 0.0D)")


def _with_groups(rows: DataFrame, groups: DataFrame, lang: str, source: str, n_rows: int, n_groups: int) -> DataFrame:
    """Joins each row's group (g_lang, g_source, n_rows and more); they are broadcast while they are few."""
    e = groups.withColumnsRenamed({"g_lang": "e_lang", "g_source": "e_source"})
    if n_groups <= MOST_BROADCAST:
        return rows.join(F.broadcast(e.drop("n_rows")), F.col(lang).eqNullSafe(F.col("e_lang")) & F.col(source).eqNullSafe(F.col("e_source"))).drop("e_lang", "e_source")
    # A key without nulls, so that rows of a hot group can be dealt over several tasks.
    key = lambda a, b: F.to_json(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    e = e.withColumn("e_key", key("e_lang", "e_source")).drop("e_lang", "e_source")
    return join_groups(rows.withColumn("e_key", key(lang, source)), e, ["e_key"], "n_rows", n_rows, list(FEATURES), "inner").drop("e_key", "n_rows")


def _starts(points: DataFrame, counts: DataFrame, few: int, n_rows: int, n_groups: int) -> DataFrame:
    """STARTS estimates of every group: medians with the quartiles' spreads, mean and covariance of all
    rows, and medians with the covariance of the rows' directions from them (spatial signs)."""
    keys, names, grain = ("g_lang", "g_source"), list(FEATURES), 64
    melted = points.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(c) * grain).alias("bin")) for i, c in enumerate(names)])).alias("m"))
    melted = melted.groupBy(*keys, F.col("m.i").alias("i"), F.col("m.bin").alias("bin")).agg(F.count("*").alias("n")).coalesce(few)
    melted = melted.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "i").orderBy("bin"))).withColumn("of", F.sum("n").over(Window.partitionBy(*keys, "i")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.col("of") * p, (F.col("bin") + 0.5) / grain))
    quartiles = melted.groupBy(*keys, "i").agg(at(0.5).alias("middle"), ((at(0.75) - at(0.25)) / 1.349).alias("spread"))
    quartiles = quartiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "middle", "spread"))).alias("q"))  # an entry per feature
    quartiles = quartiles.select(*keys, F.expr("transform(q, x -> x.middle)").alias("middle"), F.expr("transform(q, x -> x.spread)").alias("spread"))
    quartiles = checkpointed(quartiles.join(counts.select(F.col("g_lang").alias("c_lang"), F.col("g_source").alias("c_source"), "n_rows"), F.col("g_lang").eqNullSafe(F.col("c_lang")) & F.col("g_source").eqNullSafe(F.col("c_source"))).drop("c_lang", "c_source"))

    floors = list(FEATURES.values())
    near = _with_groups(points, quartiles, *keys, n_rows, n_groups)
    u = ", ".join(f"({c} - middle[{i}]) / sqrt(pow(spread[{i}], 2) + {floors[i] ** 2}D)" for i, c in enumerate(names))
    near = near.select(*keys, *names, "middle", "spread", F.expr(f"array({u})").alias("u")).withColumn("norm", F.expr("greatest(aggregate(u, 0.0D, (s, x) -> s + x * x), 1e-12D)"))
    signs = [F.expr(f"sum(u[{i}] * u[{j}] / norm)").alias(f"u{i}{j}") for i, j in PAIRS]
    sums = near.groupBy(*keys).agg(F.first("middle").alias("middle"), F.first("spread").alias("spread"), *_sums(), *signs)

    def begin(frames):
        d = len(FEATURES)
        for f in frames:
            middle, spread = (np.array(f[c].tolist(), float).reshape(len(f), d) for c in ("middle", "spread"))
            scale = np.sqrt(spread**2 + np.array(floors) ** 2)
            mean, cov = _moments(f)
            direction = _matrix(f, "u", np.maximum(f["n"].to_numpy(float), 1)) * d * scale[:, :, None] * scale[:, None, :]
            size = f["n"].to_numpy(float)
            yield _named(f, 0, size, middle, np.stack([np.diag(x**2) for x in spread]) if len(f) else cov)
            yield _named(f, 1, size, mean, cov)
            yield _named(f, 2, size, middle, direction)

    return sums.coalesce(few).mapInPandas(begin, ESTIMATE)


def _concentrated(points: DataFrame, estimates: DataFrame, few: int, n_rows: int, n_groups: int) -> DataFrame:
    """The estimates of the h rows nearest to each estimate, where h is SHARE of the group's rows.

    Rows are summed by group, start and distance step before anything is shuffled. Those of the step in
    which the h-th row falls are summed once more in FINE steps; of the last of these, rows that are
    equally near share what is missing to h.
    """
    keys = ("g_lang", "g_source", "start")
    groups = estimates.select("g_lang", "g_source", "start", "centre", "inverse", F.col("size").cast("long").alias("n_rows"))
    near = _with_groups(points, groups.groupBy("g_lang", "g_source").agg(F.collect_list(F.struct("start", "centre", "inverse")).alias("e"), F.max("n_rows").alias("n_rows")), "g_lang", "g_source", n_rows, n_groups)  # STARTS entries
    near = near.select("g_lang", "g_source", *FEATURES, F.explode("e").alias("e")).select("g_lang", "g_source", *FEATURES, "e.*")
    near = near.withColumn("far", F.log1p(_distance()) * GRAIN).withColumn("step", F.floor("far")).drop("centre", "inverse")
    by = Window.partitionBy(*keys)
    cut = lambda sums, order: sums.withColumn("before", F.sum("n").over(by.orderBy(order)) - F.col("n"))
    coarse = near.groupBy(*keys, "step").agg(*_sums()).coalesce(few)
    coarse = checkpointed(cut(coarse.withColumn("h", F.ceil(F.sum("n").over(by) * SHARE)), "step").where("before < h"))
    edge = coarse.where("before + n >= h").select(*keys, "step", "before", "h", (F.col("n") * 1).cast("long").alias("n_rows"))
    edges = edge.groupBy("g_lang", "g_source").agg(F.collect_list(F.struct(F.col("start").alias("at_start"), F.col("step").alias("at_step"), "before", "h")).alias("edges"), F.sum("n_rows").alias("n_rows"))
    last = _with_groups(near, edges, "g_lang", "g_source", n_rows, n_groups).withColumn("edge", F.try_element_at(F.filter("edges", lambda x: (x["at_start"] == F.col("start")) & (x["at_step"] == F.col("step"))), F.lit(1)))
    last = last.where("edge IS NOT NULL").withColumn("fine", F.floor((F.col("far") - F.col("step")) * FINE))
    fine = last.groupBy(*keys, "fine").agg(*_sums(), F.first("edge.before").alias("base"), F.first("edge.h").alias("h")).coalesce(few)
    fine = cut(fine, "fine").withColumn("share", F.greatest(F.least((F.col("h") - F.col("base") - F.col("before")) / F.col("n"), F.lit(1.0)), F.lit(0.0)))
    inside = coarse.where("before + n < h").withColumn("share", F.lit(1.0)).select(*keys, *SUMS, "share")
    inside = inside.unionByName(fine.select(*keys, *SUMS, "share"))
    moments = inside.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in SUMS])

    def invert(frames):
        for f in frames:
            mean, cov = _moments(f)
            yield _named(f, f["start"].to_numpy(), f["n"].to_numpy(float) / SHARE, mean, cov * consistency())

    return moments.coalesce(few).mapInPandas(invert, ESTIMATE)


def blended(counts: DataFrame, estimates: DataFrame, few: int) -> DataFrame:
    """(g_lang, g_source, n_rows, centre, inverse) of every language and source: its own estimate and that
    of its language, which is blended with that of all rows in the same way. Of n rows, a group's own
    weighs n / (n + PARENT_ROWS); how far the centres lie apart widens the covariance."""
    e = estimates.select("g_lang", "g_source", F.col("centre").alias("m"), F.col("cov").alias("c"))
    part = lambda name, lang, source: e.where(lang & source).select(F.col("g_lang").alias(f"{name}_lang"), *([F.col("g_source").alias("o_source")] if name == "o" else []), F.col("m").alias(f"{name}_m"), F.col("c").alias(f"{name}_c"))
    is_all, not_all = F.coalesce(F.col("g_lang") == ALL, F.lit(False)), F.coalesce(F.col("g_source") == ALL, F.lit(False))
    own, lang, every = part("o", ~is_all, ~not_all), part("l", ~is_all, not_all), part("a", is_all, not_all).drop("a_lang")
    rows = counts.withColumn("lang_rows", F.sum("n_rows").over(Window.partitionBy("g_lang")))
    rows = rows.join(own, F.col("g_lang").eqNullSafe(F.col("o_lang")) & F.col("g_source").eqNullSafe(F.col("o_source"))).join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang"))).crossJoin(F.broadcast(every))  # one row

    def blend(frames):
        d = len(FEATURES)
        for f in frames:
            m, c = ({k: np.array(f[f"{k}_{x}"].tolist(), float).reshape(len(f), *shape) for k in "ola"} for x, shape in (("m", (d,)), ("c", (d, d))))
            mean, cov = m["a"], c["a"]
            for k, n in (("l", "lang_rows"), ("o", "n_rows")):
                w = (f[n] / (f[n] + PARENT_ROWS)).to_numpy(float)[:, None]
                apart = m[k] - mean
                cov = w[:, :, None] * c[k] + (1 - w)[:, :, None] * cov + (w * (1 - w))[:, :, None] * apart[:, :, None] * apart[:, None, :]
                mean = w * m[k] + (1 - w) * mean
            out = _named(f, 0, f["n_rows"].to_numpy(float), mean, cov)[["g_lang", "g_source", "centre", "inverse"]]
            out.insert(2, "n_rows", f["n_rows"])
            yield out

    return rows.coalesce(few).mapInPandas(blend, "g_lang string, g_source string, n_rows long, centre array<double>, inverse array<double>")


def concentrate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each (m_lang, m_source) in `rows` (with FEATURES), and the minimum covariance determinant
    estimate of each, of each language (source ALL) and of all rows: (counts, ESTIMATE).

    From STARTS starts, steps of concentration keep the SHARE of a group's rows that are nearest and
    estimate centre and covariance anew, until its determinant falls no more; a group and start that has come
    to this takes part in no further step. Of the starts the one
    with the least determinant counts. A null language or source is a value of its own.
    """
    keys, names = ("g_lang", "g_source"), list(FEATURES)
    n_rows = rows.count()
    rows = rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS)))
    own = rows.select(F.col("m_lang").alias("g_lang"), F.col("m_source").alias("g_source"), *names)
    points = own.unionByName(own.withColumn("g_source", F.lit(ALL))).unionByName(own.select(F.lit(ALL).alias("g_lang"), F.lit(ALL).alias("g_source"), *names))
    counts = checkpointed(own.groupBy(*keys).agg(F.count("*").alias("n_rows")))
    few = max(1, -(-counts.count() * 256 * STARTS // TASK_ROWS))  # tasks for a row per group, start and distance step
    every = counts.unionByName(counts.groupBy("g_lang").agg(F.lit(ALL).alias("g_source"), F.sum("n_rows").alias("n_rows"))).unionByName(counts.agg(F.lit(ALL).alias("g_lang"), F.lit(ALL).alias("g_source"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")))
    n_groups = every.count()
    estimates = checkpointed(_starts(points, every, few, 3 * n_rows, n_groups))
    falling, settled = checkpointed(_concentrated(points, estimates, few, 3 * n_rows, n_groups)), []
    named = {c: f"w_{c}" for c in (*keys, "start")}
    while not falling.isEmpty():  # each round settles a group and start or lowers its determinant, which has a floor
        after = checkpointed(_concentrated(points, falling, few, 3 * n_rows, n_groups))
        same = lambda x, y: x["g_lang"].eqNullSafe(y["w_g_lang"]) & x["g_source"].eqNullSafe(y["w_g_source"]) & (x["start"] == y["w_start"])
        was = falling.select(*[F.col(c).alias(w) for c, w in named.items()], F.col("logdet").alias("was"))
        fell = checkpointed(after.join(was, same(after, was)).where(F.col("was") - F.col("logdet") > 1e-9).select(*after.columns))
        goes_on = fell.select(*[F.col(c).alias(w) for c, w in named.items()])
        settled.append(checkpointed(falling.join(goes_on, same(falling, goes_on), "left_anti")))
        falling = fell
    estimates = reduce(DataFrame.unionByName, settled, falling)
    best = Window.partitionBy(*keys).orderBy("logdet", "start")
    best = estimates.withColumn("turn", F.row_number().over(best)).where("turn = 1").drop("turn")
    return counts, checkpointed(best.coalesce(few))


def estimate(rows: DataFrame) -> DataFrame:
    """Robust centre and inverse covariance for each (m_lang, m_source) in `rows`, `blended`."""
    counts, estimates = concentrate(rows)
    return checkpointed(blended(counts, estimates, max(1, -(-counts.count() * 256 // TASK_ROWS))))


def measured(docs: DataFrame, lang: str, source: str, text: str, carry: dict) -> DataFrame:
    """`carry` columns, m_lang, m_source, statistics, base_failed and FEATURES of every row."""
    small_batches(docs.sparkSession)
    named = docs.select(*[c.alias(k) for k, c in carry.items()], F.col(f"`{lang}`").cast("string").alias("m_lang"), F.col(f"`{source}`").cast("string").alias("m_source"), F.col(f"`{text}`").alias("m_text"))
    rows = text_statistics(named, "m_text")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.withColumns(features())


def verdicts(rows: DataFrame, estimates: DataFrame, tail: float = TAIL) -> DataFrame:
    """Adds distance (null where base_failed) and kept to `measured` rows."""
    none = F.lit(None).cast("array<double>")
    groups = estimates.unionByName(rows.sparkSession.range(1).select(F.lit(NONE).alias("g_lang"), F.lit(NONE).alias("g_source"), F.lit(1 << 40).alias("n_rows"), none.alias("centre"), none.alias("inverse")))
    # Failed rows meet one row without estimates, so that no row is lost in the inner join.
    rows = rows.withColumns({"j_lang": F.when(F.col("base_failed"), F.lit(NONE)).otherwise(F.col("m_lang")), "j_source": F.when(F.col("base_failed"), F.lit(NONE)).otherwise(F.col("m_source"))})
    joined = _with_groups(rows, groups, "j_lang", "j_source", 1 << 40, groups.count())
    joined = joined.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = F.coalesce(F.col("distance") <= chi2_quantile(1 - tail, len(FEATURES)), F.lit(False))
    return joined.withColumn("kept", kept).drop("j_lang", "j_source", "centre", "inverse")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """(key, statistics, base_failed, distance, kept, FEATURES) for every row of `docs`.

    base_failed: under 50 words, or more than half of the words in repeated three-word windows. Of
    the others, those whose vector lies beyond the 1 - tail quantile of the chi-squared distribution
    around their language's and source's robust estimate are rejected; the fewer rows a group has, the
    more its language's and all rows' estimates weigh in it. Nulls: a null text has no
    words and fails; a null language or source groups with its like. Equal rows get equal results,
    an empty table an empty one; other columns are ignored.
    """
    rows = checkpointed(measured(docs, lang, source, text, {"m_key": F.col(f"`{key}`")}))
    done = verdicts(rows, estimate(rows.where("NOT base_failed")), tail)
    return done.select(F.col("m_key").alias(key), *STAT_COLUMNS, "base_failed", "distance", "kept", *FEATURES)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns and no exchange of texts: they
    are measured once for the estimates and once more on the way out."""
    rows = checkpointed(measured(docs, lang, source, text, {}).where("NOT base_failed").select("m_lang", "m_source", *FEATURES))
    whole = measured(docs, lang, source, text, {"doc": F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    return verdicts(whole, estimate(rows), tail).where("kept").select("doc.*")


def op10_quality_rules(spark, sf_dir):
    """Statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
