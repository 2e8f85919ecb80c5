"""Candidate pairs with their reasons, their relationships, and nearest neighbours in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.matching import Prepared, candidate, rule_number, rule_relationship
from factloom.sources.tables import settled

from .pairing import FEW
from .pairing import _unit as unit_rows
from .pairing import _vectors as vectors_of
from .pairing import candidate_scores, query_scores


def candidate_pairs(facts: DataFrame, least: float = 0.5, require_cross: bool = True, most: int | None = None) -> DataFrame:
    """`candidate_scores` (with `most`, the best ones of each dataset) with both facts as structs a and b,
    and the reasons of the gate. Facts are joined after the choice; with `most` only the chosen ones are made again and moved."""
    scores, slim = candidate_scores(facts, least, require_cross, most=most), facts.drop("embedding")
    if most is not None:
        scores = settled(max_candidates(scores, most))
        ids = settled(scores.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("id")).distinct())
        slim = settled(slim.join(F.broadcast(ids) if ids.count() <= 10 * FEW else ids, "id", "left_semi"))
    side = lambda k: slim.select(F.col("id").alias(f"fact_{k}_id"), F.struct(*slim.columns).alias(k))
    pairs = scores.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id")
    _, why = candidate(F.col("a"), F.col("b"), require_cross)
    seen = F.when(F.col("vector_similarity").isNotNull(), F.format_string("vector_sim_%.2f", "vector_similarity"))
    return pairs.withColumn("reasons", F.array_compact(F.concat(why, F.array(seen))))


def max_candidates(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The best n pairs of each dataset."""
    order = Window.partitionBy("dataset_id").orderBy(F.desc("score"), "fact_a_id", "fact_b_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def canonical(pairs: DataFrame) -> DataFrame:
    """Pairs (fact_a_id, fact_b_id, a, b) with the smaller id first."""
    swap = F.col("fact_a_id") > F.col("fact_b_id")
    turned = {x: F.when(swap, F.col(y)).otherwise(F.col(x)) for x, y in (("fact_a_id", "fact_b_id"), ("fact_b_id", "fact_a_id"), ("a", "b"), ("b", "a"))}
    return pairs.withColumns(turned)


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """(fact_a_id, fact_b_id, verdict_type, verdict_confidence, verdict_reason, verdict_factors) of a model's
    answers (fact_a_id, fact_b_id, answer) that hold a valid verdict: a known type, a confidence from 0 to
    1 and a reason."""
    kinds = ("CORROBORATES", "CONTRADICTS", "CONTEXTUAL_DIFFERENCE", "RELATED", "UNCERTAIN")
    shape = "relationship_type string, confidence string, reason string, contextual_factors map<string,string>"
    v = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), shape)
    fine = lambda x: x["relationship_type"].isin(*kinds) & x["confidence"].try_cast("double").between(0, 1) & (x["reason"] != "")
    # An answer is read once: as a condition on a column, what reads it would stand there and in each field again.
    read = answers.select("fact_a_id", "fact_b_id", F.explode(F.filter(F.array(v), fine)).alias("v"))
    sure = F.col("v.confidence").try_cast("double")
    return read.select("fact_a_id", "fact_b_id", F.col("v.relationship_type").alias("verdict_type"), sure.alias("verdict_confidence"), F.col("v.reason").alias("verdict_reason"), F.col("v.contextual_factors").alias("verdict_factors"))


def ruled(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the relationship `rule` that rules give them. The rule is found once, before its fields."""
    prepared = "traits" in pairs.schema["a"].dataType.fieldNames()
    a, b = (Prepared(k) if prepared else F.col(k) for k in "ab")
    return pairs.withColumn("rule_number", rule_number(a, b)).withColumn("rule", rule_relationship(a, b, number=F.col("rule_number"))).drop("rule_number")


def classify_pairs(pairs: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Relationship of each pair (structs a, b) in canonical order: the rules from 0.90 on, else a supplied
    verdict (fact_a_id, fact_b_id, verdict_type, verdict_confidence, and verdict_reason and
    verdict_factors if there are any), else UNCERTAIN at 0.5."""
    out = ruled(canonical(pairs))
    sure = F.coalesce(F.col("rule.confidence") >= 0.90, F.lit(False))
    kinds = {"verdict_type": "string", "verdict_confidence": "double", "verdict_reason": "string", "verdict_factors": "map<string,string>"}
    if verdicts is not None:
        out = out.join(verdicts, ["fact_a_id", "fact_b_id"], "left")
    out = out.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in out.columns})
    given = F.col("verdict_type").isNotNull()
    return out.withColumns({
        "relationship_type": F.when(sure, F.col("rule.type")).when(given, F.col("verdict_type")).otherwise("UNCERTAIN"),
        "confidence": F.when(sure, F.col("rule.confidence")).when(given, F.round("verdict_confidence", 3)).otherwise(0.5),
        "reasoning_method": F.when(sure, "deterministic_rules").when(given, "llm_contextual_reasoning").otherwise("fallback_uncertain"),
        "reason": F.when(sure, F.col("rule.reason")).when(given, F.coalesce("verdict_reason", F.lit("A model judged the pair."))).otherwise("No rule decides the pair and no model has judged it."),
        "contextual_factors": F.when(sure, F.col("rule.factors")).when(given, F.col("verdict_factors")),
    }).drop("verdict_reason", "verdict_factors")


def similar_vectors(rows: DataFrame, queries: DataFrame, k: int = 10, least: float | None = None, within: str | None = None, apart: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows (id, embedding) of every query by cosine distance,
    of equal ones those with the smaller ids. Vectors of another length than the query's are no match.

    within: a column of both tables that must be equal (a dataset); apart: columns that must differ (a
    document, the id itself). Queries are dealt out in blocks of a bounded size, so any number of them is
    matched against all rows by matrix products; each slice of rows keeps its own k best before anything
    is shuffled.
    """
    n_blocks = max(1, -(-queries.count() // 2048))
    n_slices = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // 50_000))
    places = F.array(*[F.col(c).cast("string") for c in apart]).cast("array<string>")
    side = lambda df, key, v, kind: df.where(F.col(v).isNotNull()).select(
        F.size(v).alias("dim"), (F.col(within).cast("string") if within else F.lit("")).alias("within"), F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(v).alias("v"), places.alias("places"))
    left = side(queries, "query_id", "query", 0).withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(n_blocks)), "slice": F.explode(F.expr(f"sequence(0, {n_slices - 1})"))})
    right = side(rows, "id", "embedding", 1).withColumns({"slice": F.pmod(F.xxhash64("key"), F.lit(n_slices)).cast("int"), "block": F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)"))})
    kinds = {c: t.schema[n].dataType.simpleString() for c, t, n in (("query_id", queries, "query_id"), ("id", rows, "id"))}

    def nearest(g: pd.DataFrame) -> pd.DataFrame:
        q, r = g[g["kind"] == 0], g[g["kind"] == 1].sort_values("key")
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []}, dtype=object)
        a, b = np.stack(q["v"].to_list()).astype(float), np.stack(r["v"].to_list()).astype(float)
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        d = 1 - a @ b.T
        for i in range(len(apart)):
            d[np.array([x[i] for x in q["places"]], object)[:, None] == np.array([x[i] for x in r["places"]], object)[None, :]] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, :k]  # rows are in order of their ids
        i, top = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
        found = np.isfinite(d[i, top])
        i, top = i[found], top[found]
        plain = lambda keys, at: pd.Series(keys.to_numpy(object)[at], dtype=object)
        return pd.DataFrame({"query_id": plain(q["key"], i), "id": plain(r["key"], top), "distance": d[i, top]})

    best = left.unionByName(right).groupBy("within", "dim", "block", "slice").applyInPandas(nearest, f"query_id {kinds['query_id']}, id {kinds['id']}, distance double")
    if least is not None:
        best = best.where(1 - F.col("distance") >= least)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_facts(facts: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """(query_id, id, similarity, rank): the k facts (id, dataset_id, document_id, embedding) nearest to each
    query fact, in its dataset and in other documents, with a similarity of `least` or more."""
    q = queries.withColumns({"query_id": F.col("id"), "query": F.col("embedding")})
    return similar_vectors(facts, q, k, least, "dataset_id", ("id", "document_id")).select("query_id", "id", (1 - F.col("distance")).alias("similarity"), "rank")


def candidates_for_fact(queries: DataFrame, pool: DataFrame, k: int = 10, least: float = 0.5, require_cross: bool = True, part: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the k best candidates of every query fact among a pool of facts.

    Parts of a dataset's queries meet parts of its pool (`query_scores`), so that a dataset of any size is spread over
    as many tasks as it needs, and each task keeps the k best of a query before they are exchanged.
    """
    scored = query_scores(queries, pool, k, least, require_cross, part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosines(queries: DataFrame, rows: DataFrame, part: int = 2048) -> DataFrame:
    """(query_id, id, similarity): the cosine of every query (query_id, query) and every row (id, embedding), held to 0 to 1
    and to four places; 0 for missing vectors, other lengths and zero norms.

    All pairs are asked for, so the rows that leave grow with the product of both; parts of `part` queries and rows
    meet in a task as a matrix product."""
    n_q, n_r = (max(1, -(-t.count() // part)) for t in (queries, rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    v = lambda c: F.col(c).cast("array<double>").alias("v")
    left = queries.select(F.col("query_id").alias("key"), v("query"), F.lit(0).alias("kind"), place("query_id", n_q).alias("q"), each(n_r).alias("r"))
    right = rows.select(F.col("id").alias("key"), v("embedding"), F.lit(1).alias("kind"), place("id", n_r).alias("r"), each(n_q).alias("q"))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": rows.schema["id"].dataType.simpleString()}

    def meet(table: pa.Table) -> pa.Table:
        side = [table.filter(pc.equal(table.column("kind"), x)) for x in (0, 1)]
        (a, da), (b, db) = (vectors_of(t.column("v")) for t in side)
        width = max(a.shape[1], b.shape[1])
        a, b = (unit_rows(np.pad(m, ((0, 0), (0, width - m.shape[1])))) for m in (a, b))
        s = np.clip(a @ b.T, 0.0, 1.0) * ((da[:, None] == db[None, :]) & (da[:, None] >= 0))
        s = np.floor(s.ravel() * 1e4 + 0.5) / 1e4
        keys = [t.column("key").combine_chunks() for t in side]
        i, j = np.repeat(np.arange(len(da)), len(db)), np.tile(np.arange(len(db)), len(da))
        return pa.table({"query_id": keys[0].take(pa.array(i)), "id": keys[1].take(pa.array(j)), "similarity": pa.array(s)})

    return left.unionByName(right).groupBy("q", "r").applyInArrow(meet, f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")
