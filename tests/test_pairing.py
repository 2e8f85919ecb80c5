"""Pairs by tiles under bounds equal a plain loop over all pairs; comparisons and confidence in full."""

import datetime as dt
import re

import numpy as np
import pytest

from factloom.operators import compare as C
from factloom.operators import facts as O
from factloom.operators.pairing import candidate_scores, tile_pairs, tiles_of

SCHEMA = "id string, dataset_id string, document_id string, page_number int, subject string, predicate string, raw_claim string, normalized_unit string, unit string, embedding array<double>"


def facts(seed=3, n=150):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, 8))
    rows = []
    for i in range(n):
        k = int(rng.integers(6))
        v = (centres[k] + rng.normal(0, 0.2, 8)).tolist() if i % 9 else None
        v = [0.0] * 8 if i == 4 else v[:5] if v and i % 31 == 0 else v
        rows.append((f"f{i:03}" if i != 7 else None, "s" if i % 13 else "t", f"d{i % 5}" if i % 17 else None, int(i % 4) if i % 6 else None, f"Brand {k} co" if i % 8 else "", f"metric {i % 3} total" if i % 10 else None, f"claim {i % 7} of {k}", [None, "inr", "USD", "PERCENT", ""][i % 5], "DAYS" if i % 7 == 0 else None, v))
    return [*rows, rows[20], ("f900", "", "d1", 1, "x", "y", "z", None, None, None)]


def plain(rows, least, cross):
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    unit = lambda r: (r[7] or r[8] or "").upper()
    out = set()
    rows = [r for r in rows if r[0] and r[1]]
    for x in rows:
        for y in rows:
            if x[0] >= y[0] or x[1] != y[1]:
                continue
            same = bool(x[2]) and x[2] == y[2]
            if same and x[3] is not None and x[3] == y[3] or cross and (same or not x[2] or not y[2]):
                continue
            u, w = unit(x), unit(y)
            if u and w and u != w and not {u, w} <= {"INR", "USD", "EUR", "GBP"}:
                continue
            p, s, c = (jac(words(x[k]), words(y[k])) for k in (5, 4, 6))
            if x[9] is not None and y[9] is not None:
                a, b = np.array(x[9]), np.array(y[9])
                v = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if len(a) == len(b) and np.linalg.norm(a) and np.linalg.norm(b) else 0.0
                score = 0.65 * min(max(v, 0), 1) + 0.20 * p + 0.15 * s
            else:
                score = 0.50 * c + 0.30 * p + 0.20 * s
            score = np.floor(min(score, 1) * 1e4 + 0.5) / 1e4
            if score >= least:
                out.add((x[0], y[0], score))
    return out


@pytest.mark.parametrize(("least", "cross", "tile", "block"), [(0.45, True, 20, 7), (0.65, False, 16, 16), (0.9, True, 12, 5), (0.0, True, 50, 30)])
def test_bounds_lose_no_pair(spark, least, cross, tile, block):
    rows = facts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, least, cross)
    got = [{(r.fact_a_id, r.fact_b_id, r.score) for r in candidate_scores(df, least, cross, tile=tile, block=block, prune=p).collect()} for p in (True, False)]
    assert got[0] == got[1] and {g[:2] for g in got[0]} == {w[:2] for w in want} and want
    assert {g: 1 for g in got[0]} == {w: 1 for w in want}


def test_bounds_rule_tiles_out(spark):
    rng = np.random.default_rng(0)
    rows = [(f"f{k}-{i}", "s", f"d{i}", 1, f"subject{k}", f"metric{k}", "c", None, None, (np.eye(8)[k] + rng.normal(0, 0.01, 8)).tolist()) for k in range(8) for i in range(30)]
    tiles = tiles_of(spark.createDataFrame(rows, SCHEMA).coalesce(1), 30)
    n = tiles.select("tile").distinct().count()
    assert tile_pairs(tiles, 0.65).count() < n * (n + 1) / 4  # of all pairs of tiles
    assert candidate_scores(spark.createDataFrame(rows, SCHEMA), 0.9, tile=30).count() == 8 * 30 * 29 / 2
    assert candidate_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_comparison_in_full(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    f = lambda i, doc, subject, claim, value, scope=None, unit=None, at=1, predicate="net revenue": (i, doc, subject, predicate, claim, value, None, unit, "INR", scope, "FY24", day(at))
    rows = [
        f("a1", "d1", "Acme-one  LTD", "was 10", 10.0, "Standalone"), f("a2", "d2", "acme-one ltd", "was 12", 12.5, "standalone"), f("a3", "d3", "ACME-ONE LTD", "was 9", 9.0),
        f("b1", "d1", "b", "x", 1.0, "consolidated"), f("b2", "d2", "b", "x", 2.0, "segment-a b"), f("c1", "d1", "c", "Same  claim", None), f("c2", "d2", "c", "same claim", None, unit="USD"),
        f("e1", "d1", "e", "one", None), f("e2", "d2", "e", "two", None), f("g1", "d1", "", "only here", 5.0), f("h2", "d2", "h" * 40, "new", 5.0), f("i3", "d3", "i", "late", 5.0), f("j1", "d1", "j", "z", 0.0), f("j2", "d2", "j", "z", 3.0),
        f("k1", "d1", "k", "z", 3.0, predicate=" "), f("l1", "d1", "l", "n", 100.0), f("l2", "d2", "l", "n", 100.4),
    ]
    facts_ = spark.createDataFrame(rows, "id string, document_id string, subject string, predicate string, raw_claim string, value_numeric double, normalized_value_numeric double, normalized_unit string, unit string, scope string, period_text string, created_at timestamp")
    selection = spark.createDataFrame([("c", 1, "d1", "one.pdf"), ("c", 2, "d2", "two.pdf"), ("c", 3, "d3", "three.pdf"), ("alone", 1, "d1", "one.pdf")], "comparison_id string, ordinal int, document_id string, filename string")
    evidence = spark.createDataFrame([("e", "a1", "ten", "p", 7, day(1))], "id string, fact_id string, quote string, page_id string, page_number int, created_at timestamp")
    got = {r.subject_key: r for r in C.compare_documents(facts_, selection, evidence).collect()}
    a = got["acme-one ltd"]
    assert (a.subject, a.predicate, a.unit, a.scope, a.category, a.change, a.percent, a.difference, a.raw_a) == ("Acme-One Ltd", "Net Revenue", "INR", "Standalone", "INCREASED", "+25.00% ↑", 25.0, 2.5, "was 10")
    assert [p and (p.fact_id, p.filename, p.value, p.page, p.quote, p.period) for p in a.timeline] == [("a1", "one.pdf", 10.0, 7, "ten", "FY24"), ("a2", "two.pdf", 12.5, 1, None, "FY24"), ("a3", "three.pdf", 9.0, 1, None, "FY24")]
    label = {k: (r.category, r.change, r.percent, r.difference) for k, r in got.items()}
    assert label["b"] == ("CONTEXT_CHANGED", "Scope changed: Consolidated → Segment-A B", None, None) and label["c"] == ("UNCHANGED", "Identical claim", None, None)
    assert label["e"] == ("CONTEXT_CHANGED", "Qualitative claim variance", None, None) and label[""] == ("NOT_FOUND", "Not found in two.pdf", None, None) and got[""].subject == "one.pdf"
    assert label["h" * 40][:2] == ("ADDED", "Added in two.pdf") and got["h" * 40].subject == "Metric" and label["i"][:2] == ("UNCHANGED", "No change") and label["j"] == ("INCREASED", "+100.00% ↑", 100.0, 3.0)
    assert label["l"] == ("UNCHANGED", "0.00% (No change)", 0.4, 0.4) and "k" not in got
    assert [r.subject_key for r in sorted(got.values(), key=lambda r: r.position)] == ["j", "acme-one ltd", "b", "e", "l", "c", "i", "h" * 40, ""]
    s = C.comparison_summary(C.compare_documents(facts_, selection)).first()
    assert (s.total, s.increased, s.context_changed, s.unchanged, s.added, s.not_found) == (9, 2, 2, 2, 1, 1)
    assert [tuple(r) for r in C.too_few_documents(selection).collect()] == [("alone", 1)]


def test_confidence_looks_elsewhere(spark):
    one = lambda **k: O.fact_confidence(spark.createDataFrame([k], ", ".join(f"{c} {KINDS[c]}" for c in k)).selectExpr("*", "cast(null as double) AS normalized_value_numeric", "cast(null as double) AS value_numeric", "'x' AS raw_claim", "'x' AS raw_value_text")).first()
    KINDS = {"evidence": "array<struct<quote:string,pdf_page_number:int>>", "evidence_quote": "string", "time_period": "string", "temporal_period": "string", "metadata": "map<string,string>", "page_number": "int", "quote": "string", "scope": "string"}
    signals = lambda r: [x.signal for x in r.signals]
    assert signals(one(evidence=[("a quote that is long enough", 4)], temporal_period="FY24")) == ["quote", "page", "period", "in words", "no scope"]
    assert signals(one(evidence_quote="short", metadata={"page_number": "2", "time_period": "FY24", "unit": "INR", "scope": "segment"})) == ["short quote", "page", "period", "unit", "scope"]
    assert signals(one(quote="", evidence=[], time_period="n/a", metadata={"page_number": "x", "period": "FY24"})) == ["no quote", "no page", "no period", "in words", "no scope"]
