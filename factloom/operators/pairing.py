"""All candidate pairs of facts with their hybrid score: tiles of like facts, of which most pairs are ruled out by a bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.matching import CURRENCIES, tokens
from factloom.sources.tables import settled

#: Directions to which the angles of all vectors are taken; of the first CODED of these a sort key is made.
PIVOTS, CODED, CODE_BITS = 8, 4, 8
#: What a bound may be short of a score by rounding: half of the fourth place, and products of matrices.
SLACK = 0.00005 + 1e-9
#: Meetings of tiles (some 60 bytes each) that are few enough to be known to every task.
FEW = 100_000
_OUT = "fact_a_id string, fact_b_id string, dataset_id string, vector_similarity double, score double"


def _pivots(dim: int) -> np.ndarray:
    """The same unit vectors everywhere, for each number of dimensions."""
    p = np.random.default_rng(dim).standard_normal((PIVOTS, dim))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def _vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of doubles for each list (shorter ones and nulls are filled with 0), and their lengths (null: -1)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    dims = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, int(dims.max(initial=0)))
    out = np.zeros((len(column), width))
    sizes = np.maximum(dims, 0)
    rows = np.repeat(np.arange(len(column)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = column.flatten().to_numpy(zero_copy_only=False)
    return out, dims


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _angles(m: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """Of each vector to the pivots; right ones where there is none. They are made anew where they are needed, since moving
    them costs more."""
    m, angles = _unit(np.nan_to_num(m)), np.full((len(m), PIVOTS), math.pi / 2)
    for dim in np.unique(dims[dims > 0]).tolist():
        own = dims == dim
        angles[own] = np.arccos(np.clip(m[own, :dim] @ _pivots(dim).T, -1, 1))
    return angles


def _measure(batches):
    """Adds to each fact a sort key by which near vectors are mostly near."""
    for batch in batches:
        angles = _angles(*_vectors(batch.column("embedding")))
        steps = np.minimum((angles[:, :CODED] / math.pi * (1 << CODE_BITS)).astype(np.int64), (1 << CODE_BITS) - 1)
        code = np.zeros(batch.num_rows, np.int64)
        for bit in range(CODE_BITS - 1, -1, -1):
            for k in range(CODED):
                code = code << 1 | (steps[:, k] >> bit & 1)
        yield pa.record_batch([*batch.columns, pa.array(code)], [*batch.schema.names, "code"])


def _angled(batches):
    """Adds to each fact its angles to the pivots."""
    for batch in batches:
        angles = _angles(*_vectors(batch.column("embedding")))
        yield pa.record_batch([*batch.columns, *[pa.array(angles[:, k].copy()) for k in range(PIVOTS)]], [*batch.schema.names, *[f"angle{k}" for k in range(PIVOTS)]])


def measured(facts: DataFrame) -> DataFrame:
    """What a pair's score and gates need of each fact with an id and a dataset.

    Token sets are texts in dictionary form (sorted tokens joined by blanks), so that a tile of thousands
    of facts holds a few different ones. Vectors keep their type, since floats take half the room that doubles would."""
    own = "float" if facts.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    unit = F.upper(F.coalesce(F.when(F.col("normalized_unit") != "", F.col("normalized_unit")), F.when(F.col("unit") != "", F.col("unit"))))
    key = lambda c: F.array_join(F.array_sort(tokens(F.col(c))), " ")
    rows = facts.where("coalesce(id, '') <> '' AND coalesce(dataset_id, '') <> ''").select(
        "id", "dataset_id", "document_id", F.col("page_number").cast("double").alias("page"), F.when(unit.isin(*CURRENCIES), "$").otherwise(unit).alias("unit_class"),
        key("predicate").alias("p"), key("subject").alias("s"), key("raw_claim").alias("c"), F.col("embedding").cast(f"array<{own}>").alias("embedding"),
    )
    return rows.mapInArrow(_measure, f"{_kinds(rows)}, code long")


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def tiles_of(facts: DataFrame, tile: int) -> DataFrame:
    """Facts in tiles of at most `tile`: sorted by dataset, whether they have a vector, predicate, subject and the
    place of the vector among the pivots, in ranges that all tasks share evenly, then cut where a dataset ends or a tile
    is full. Written once; the facts of a tile stand together."""
    rows = measured(facts)
    order = ["dataset_id", F.col("embedding").isNull(), "p", "s", "code", "id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("code").withColumn("place", F.monotonically_increasing_id())

    def cut(batches):
        owner, number, size = None, -1, 0
        for batch in batches:
            names, parts = [], (batch.column("place").to_numpy() >> 33).tolist()
            for part, dataset in zip(parts, batch.column("dataset_id").to_pylist(), strict=True):
                if dataset != owner or size == tile:
                    owner, number, size = dataset, number + 1, 0
                size += 1
                names.append(f"{part}/{number}")
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, "tile"])

    return settled(rows.mapInArrow(cut, f"{_kinds(rows)}, tile string"))


def tile_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(dataset_id, tile_a, tile_b) of the tiles that may hold a pair of `least` or more.

    The cosine of two vectors is at most that of the gap between their tiles' ranges of angles to any
    pivot; predicates and subjects without a common token add nothing, single token sets exactly their
    Jaccard similarity. What stays below `least` at best is left out.
    """
    words = lambda c: F.array_distinct(F.flatten(F.transform(F.collect_set(c), lambda x: F.split(x, " "))))
    ends = [f(f"angle{k}").alias(f"{n}{k}") for k in range(PIVOTS) for n, f in (("lo", F.min), ("hi", F.max))]
    kept = rows.select("dataset_id", "tile", "p", "s", "c", "embedding")
    found = kept.mapInArrow(_angled, ", ".join([_kinds(kept), *[f"angle{k} double" for k in range(PIVOTS)]])).groupBy("dataset_id", "tile").agg(
        *ends, *[f(c).alias(n) for c in "psc" for n, f in ((f"{c}_words", words),)], *[F.count_distinct(c).alias(f"{c}_sets") for c in "ps"],
        F.bool_or(F.col("embedding").isNull()).alias("bare"), F.bool_and(F.col("embedding").isNull()).alias("all_bare"),
    )
    found = settled(found)
    side = lambda x: found.select("dataset_id", F.struct(*[c for c in found.columns if c != "dataset_id"]).alias(x))
    a, b = F.col("a"), F.col("b")

    def most(c: str):
        real = lambda x: F.array_remove(x[f"{c}_words"], "")
        both = F.size(F.array_intersect(real(a), real(b)))
        if c == "c":
            return F.when(F.arrays_overlap(real(a), real(b)), 1.0).otherwise(0.0)
        single = (a[f"{c}_sets"] == 1) & (b[f"{c}_sets"] == 1)
        return F.when(both == 0, 0.0).when(single, both / (F.size(real(a)) + F.size(real(b)) - both)).otherwise(1.0)

    gap = F.greatest(F.lit(0.0), *[F.greatest(a[f"lo{k}"] - b[f"hi{k}"], b[f"lo{k}"] - a[f"hi{k}"]) for k in range(PIVOTS)])
    cosine = F.cos(F.least(gap, F.lit(math.pi / 2)))
    p, s = most("p"), most("s")
    with_vectors = F.when(a["all_bare"] | b["all_bare"], 0.0).otherwise(0.65 * cosine + 0.20 * p + 0.15 * s)
    on_texts = F.when(a["bare"] | b["bare"], 0.50 * most("c") + 0.30 * p + 0.20 * s).otherwise(0.0)
    pairs = side("a").join(side("b"), "dataset_id").where(a["tile"] <= b["tile"])
    return pairs.where(F.greatest(with_vectors, on_texts) >= least - SLACK).select("dataset_id", a["tile"].alias("tile_a"), b["tile"].alias("tile_b"))


def _jaccard(sets: list[str]) -> np.ndarray:
    """Jaccard similarity of each two token sets, by a product of incidence matrices; 0 if either is empty."""
    lists = [x.split() for x in sets]
    names = {t: i for i, t in enumerate({t for x in lists for t in x})}
    m = np.zeros((len(sets), max(1, len(names))), np.float32)
    for i, x in enumerate(lists):
        m[i, [names[t] for t in x]] = 1
    both = (m @ m.T).astype(float)
    sizes = np.array([len(x) for x in lists])
    return np.where(both > 0, both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1), 0.0)


def best_pairs(pairs: pd.DataFrame, n: int) -> pd.DataFrame:
    return pairs.sort_values(["score", "fact_a_id", "fact_b_id"], ascending=[False, True, True])[:n]


class _Tiles:
    """The facts of one or two tiles as arrays, compared block by block."""

    def __init__(self, table: pa.Table, least: float, require_cross: bool, block: int, most: int | None = None):
        table = table.take(pc.sort_indices(table, [("tile", "ascending"), ("place", "ascending")]))
        self.least, self.cross, self.block, self.most = least, require_cross, block, most
        plain = lambda c: table.column(c).to_pandas().to_numpy(object)
        self.ids, self.dataset = plain("id"), table.column("dataset_id")[0].as_py()
        self.order = pd.factorize(self.ids, sort=True)[0]  # compared in place of ids
        first = table.column("tile")[0].as_py()
        self.cut = sum(x == first for x in table.column("tile").to_pylist())  # two tiles: where the second starts
        self.m, self.dims = _vectors(table.column("embedding"))
        self.angles = _angles(self.m, self.dims)
        self.m = _unit(self.m)
        self.bare = self.dims < 0
        self.mixed = len(np.unique(self.dims[~self.bare])) > 1
        number = lambda c: pd.factorize(plain(c), use_na_sentinel=False)
        (self.p, ps), (self.s, ss) = number("p"), number("s")
        self.claims = plain("c")
        self.P, self.S = _jaccard(list(ps)), _jaccard(list(ss))
        # Facts of equal predicate and subject sets are alike for what texts add to a score.
        self.kind, kinds = pd.factorize(self.p.astype(np.int64) * len(ss) + self.s)
        kp, ks = kinds // len(ss), kinds % len(ss)
        self.texts = [(w * self.P[kp][:, kp] + x * self.S[ks][:, ks]) for w, x in ((0.20, 0.15), (0.30, 0.20))]
        docs = plain("document_id")
        self.doc, self.known = pd.factorize(docs, use_na_sentinel=False)[0], np.array([bool(d) and d == d for d in docs])
        self.unit = pd.factorize(plain("unit_class"))[0]
        self.page = table.column("page").to_pandas().to_numpy(float)

    def hopeless(self, r: slice, c: slice) -> bool:
        """No pair of these blocks can reach `least`, by the bound that `tile_pairs` takes."""
        if self.bare[r].any() or self.bare[c].any():
            return False
        one, two = self.angles[r], self.angles[c]
        gap = max(0.0, float(np.maximum(one.min(0) - two.max(0), two.min(0) - one.max(0)).max()))
        texts = self.texts[0][np.ix_(np.unique(self.kind[r]), np.unique(self.kind[c]))].max()
        return 0.65 * math.cos(min(gap, math.pi / 2)) + texts < self.least - SLACK

    def blocks(self):
        n, one = len(self.ids), self.cut == len(self.ids)
        for at in range(0, self.cut, self.block):
            r = slice(at, min(at + self.block, self.cut))
            for to in range(at if one else self.cut, n, self.block):
                c = slice(to, min(to + self.block, n))
                if not self.hopeless(r, c):
                    yield self.compare(r, c, one and at == to)

    def compare(self, r: slice, c: slice, same: bool) -> pd.DataFrame:
        v = np.clip(self.m[r] @ self.m[c].T, 0, 1)
        if self.mixed:
            v *= self.dims[r][:, None] == self.dims[c][None, :]
        about = 0.65 * v + self.texts[0][self.kind[r]][:, self.kind[c]]
        claims = None
        if self.bare[r].any() or self.bare[c].any():
            number, sets = pd.factorize(np.concatenate([self.claims[r], self.claims[c]]))
            claims = _jaccard(list(sets))[number[: r.stop - r.start]][:, number[r.stop - r.start :]]
            both = ~self.bare[r][:, None] & ~self.bare[c][None, :]
            about = np.where(both, about, 0.50 * claims + self.texts[1][self.kind[r]][:, self.kind[c]])
        i, j = np.nonzero(about >= self.least - SLACK)
        if same:
            i, j = i[i < j], j[i < j]
        a, b = i + r.start, j + c.start
        # Gates before scores: most pairs that are left fail none of them.
        same_doc = (self.doc[a] == self.doc[b]) & self.known[a]
        keep = ~(same_doc & (self.page[a] == self.page[b])) & ((self.unit[a] == self.unit[b]) | (self.unit[a] < 0) | (self.unit[b] < 0))
        if self.cross:
            keep &= ~same_doc & self.known[a] & self.known[b]
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        p, s, seen = self.P[self.p[a], self.p[b]], self.S[self.s[a], self.s[b]], ~self.bare[a] & ~self.bare[b]
        total = 0.65 * v[i, j] + 0.20 * p + 0.15 * s
        if claims is not None:
            total = np.where(seen, total, 0.50 * claims[i, j] + 0.30 * p + 0.20 * s)
        total = np.floor(total.clip(0, 1) * 1e4 + 0.5) / 1e4
        good = np.nonzero((total >= self.least) & (self.order[a] != self.order[b]))[0]
        if self.most is not None and len(good) > self.most:  # the best ones and their like
            good = good[total[good] >= np.partition(total[good], -self.most)[-self.most]]
        i, j, a, b, seen, total = i[good], j[good], a[good], b[good], seen[good], total[good]
        x, y, swap = self.ids[a], self.ids[b], self.order[a] > self.order[b]
        return pd.DataFrame({"fact_a_id": np.where(swap, y, x), "fact_b_id": np.where(swap, x, y), "dataset_id": self.dataset, "vector_similarity": np.where(seen, v[i, j], np.nan), "score": total, "first": x, "second": y})


def candidate_scores(facts: DataFrame, least: float = 0.5, require_cross: bool = True, tile: int = 4096, block: int = 1024, most: int | None = None, prune: bool = True) -> DataFrame:
    """(fact_a_id, fact_b_id, dataset_id, vector_similarity, score) of every eligible pair at `least` or more.

    Facts of a dataset are cut into tiles of like ones (`tiles_of`), and two tiles meet in one task only if
    the best score that their summaries allow reaches `least` (`tile_pairs`); a task looks at pairs of
    blocks under the same bound. A tile's own pairs are scored where it lies, so that a fact is copied
    only once per other tile that may hold a partner of it, with `prune=False` once per other tile of its dataset. In a block cosines are one matrix product, and token sets are compared
    once per pair of different sets. Only pairs that reach `least` leave a task, and with `most` only its best ones by score
    (which hold the dataset's best). Both ways give the same rows: the bounds are exact.

    facts: id, dataset_id, document_id, page_number, subject, predicate,
    raw_claim, normalized_unit, unit, embedding (null: scored on texts).
    """
    rows = tiles_of(facts, tile)
    if prune:
        pairs = tile_pairs(rows, least)
    else:
        found = rows.select("dataset_id", "tile").distinct()
        pairs = found.withColumnRenamed("tile", "tile_a").join(found.withColumnRenamed("tile", "tile_b"), "dataset_id")
    meets = settled(pairs.where("tile_a < tile_b").select("dataset_id", F.explode(F.array("tile_a", "tile_b")).alias("tile"), F.concat_ws("+", "tile_a", "tile_b").alias("pair")))
    meets = F.broadcast(meets) if meets.count() < FEW else meets  # facts are moved once then

    def score(table: pa.Table) -> pa.Table:
        found = []
        for one in _Tiles(table, least, require_cross, block, most).blocks():
            found.append(one)
            if most is not None and sum(map(len, found)) > max(10 * most, 10_000):
                found = [best_pairs(pd.concat(found), most)]
        out = pd.concat(found) if found else pd.DataFrame({c: [] for c in ("fact_a_id", "fact_b_id", "dataset_id", "vector_similarity", "score")})
        out = out if most is None else best_pairs(out, most)
        strings = {c: pa.array(out[c].tolist(), pa.string()) for c in ("fact_a_id", "fact_b_id", "dataset_id")}
        return pa.table({**strings, "vector_similarity": pa.array(out["vector_similarity"].to_numpy(float), pa.float64(), from_pandas=True), "score": pa.array(out["score"].to_numpy(float), pa.float64())})

    def own(batches):
        held = []
        for batch in batches:
            names = np.array(batch.column("tile").to_pylist(), object)
            ends = [*(np.nonzero(names[1:] != names[:-1])[0] + 1).tolist(), len(names)] if len(names) else []
            for at, to in zip([0, *ends], ends, strict=False):
                if held and held[0].column("tile")[0].as_py() != names[at]:
                    yield from score(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(at, to - at))
        if held:
            yield from score(pa.Table.from_batches(held)).to_batches()

    across = rows.join(meets, ["dataset_id", "tile"]).groupBy("dataset_id", "pair").applyInArrow(score, _OUT)
    return rows.mapInArrow(own, _OUT).unionByName(across)


def query_scores(queries: DataFrame, pool: DataFrame, k: int, least: float, require_cross: bool = True, part: int = 4096, block: int = 1024) -> DataFrame:
    """(query_id, id, score): of every query fact the k best of each part of the pool, at `least` or more.

    A dataset's queries and its pool are cut into parts of about `part` facts, as many as it needs, and each part of
    queries meets each part of the pool in one task, where pairs are scored as in `candidate_scores`."""
    own, all_ = measured(queries).drop("code"), measured(pool).drop("code")
    parts = lambda t, name: t.where("coalesce(id, '') <> ''").groupBy("dataset_id").agg(F.ceil(F.count("*") / part).cast("int").alias(name))
    sizes = settled(parts(queries, "q_parts").join(parts(pool, "p_parts"), "dataset_id"))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.join(sizes, "dataset_id").withColumns({"q": at("q_parts"), "tile": F.lit("0")}).withColumn("r", each("p_parts"))
    right = all_.join(sizes, "dataset_id").withColumns({"r": at("p_parts"), "tile": F.lit("1")}).withColumn("q", each("q_parts"))

    def best(table: pa.Table) -> pa.Table:
        found = []
        if len(pc.unique(table.column("tile"))) == 2:
            for one in _Tiles(table, least, require_cross, block).blocks():
                found.append(one[["first", "second", "score"]])
        out = pd.concat(found) if found else pd.DataFrame({"first": [], "second": [], "score": []})
        out = out.sort_values(["first", "score", "second"], ascending=[True, False, True]).groupby("first").head(k)
        return pa.table({"query_id": pa.array(out["first"].tolist(), pa.string()), "id": pa.array(out["second"].tolist(), pa.string()), "score": pa.array(out["score"].to_numpy(float), pa.float64())})

    both = left.unionByName(right).withColumn("place", F.lit(0).cast("long")).drop("q_parts", "p_parts")
    return both.groupBy("dataset_id", "q", "r").applyInArrow(best, "query_id string, id string, score double")
