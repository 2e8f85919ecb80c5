"""Literal expectations for numbers, units, periods, texts and chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.operators import facts as O
from factloom.operators import text as X


@pytest.mark.parametrize(
    ("value", "raw", "unit", "want"),
    [
        (None, "(452 Cr)", None, -4.52e9), (None, "107,517,088", None, 107517088.0), (None, "₹52,350 million", None, 5.235e10), (127.0, None, "INR Crore", 1.27e9),
        (None, "Rs. 17.34 Lakh Crore", None, 1.734e13), (None, "8142", None, 814.0), (None, "−5 %", None, -5.0), (None, "", None, None), (None, "n/a", None, None), (18.0, None, "percent", 18.0),
    ],
)
def test_number(spark, value, raw, unit, want):
    row = spark.createDataFrame([(value, raw, unit)], "v double, r string, u string")
    assert row.select(N.normalize_number(F.col("v"), F.col("r"), F.col("u"))).first()[0] == want


@pytest.mark.parametrize(("unit", "raw", "want"), [("Rs. Cr", None, "INR"), (None, "30%+", "PERCENT"), ("Mn Tons", None, "METRIC_TON"), ("pincodes", None, "PINCODES"), (None, None, None), ("bps", "", "BPS")])
def test_unit(spark, unit, raw, want):
    row = spark.createDataFrame([(unit, raw)], "u string, r string")
    assert row.select(N.normalize_unit(F.col("u"), F.col("r"))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("FY24", "2023-04-01", "2024-03-31"), ("FY2023-24", "2023-04-01", "2024-03-31"), ("2023-24", "2023-04-01", "2024-03-31"), ("Q1 FY24", "2023-04-01", "2023-06-30"), ("Q4 FY24", "2024-01-01", "2024-03-31"),
        ("as of March 31, 2024", "2024-03-31", "2024-03-31"), ("2024", "2024-01-01", "2024-12-31"), ("", None, None), ("February 30, 2024", None, None), ("2024-03-31", "2024-04-01", "2003-03-31"),
    ],
)
def test_period(spark, text, start, end):
    a, b = N.normalize_period(F.col("t"))
    day = lambda x: x and dt.date.fromisoformat(x)
    assert tuple(spark.createDataFrame([(text,)], "t string").select(a, b).first()) == (day(start), day(end))


def test_chunks_are_slices_of_the_stripped_text():
    text = "  " + "Some words here. And more of them\n" * 90 + "\n\nEnd "
    spans = list(X.chunk_spans(text, 200, 40))
    assert len(spans) > 5
    for piece, a, b in spans:
        assert piece == text.strip()[a:b] and len(piece) <= 200
    assert list(X.chunk_spans("   ")) == [] and list(X.chunk_spans("short")) == [("short", 0, 5)]


def test_quotes(spark):
    rows = [("revenue grew", "The revenue grew fast", 4, 16), ("a  b", "x a\nb y", 2, 5), ("made up", "nothing", None, None), ("", "text", None, None), ("1.5 (net)", "is 1.5\n(net) now", 3, 12)]
    found = X.locate_quote(F.col("q"), F.col("t"))
    got = spark.createDataFrame([r[:2] for r in rows], "q string, t string").select(found["start"], found["end"]).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_greedy_dedup(spark):
    new = spark.createDataFrame([("d", 1, "A", "q1"), ("d", 2, "a ", "q2"), ("d", 3, "B", "q2"), ("d", 4, "C", "Q2"), ("d", 5, "old", "q9")], "document_id string, position int, raw_claim string, quote string")
    old = spark.createDataFrame([("d", "OLD", "zzz")], "document_id string, raw_claim string, quote string")
    assert sorted(r.position for r in X.dedup_facts(new, old).collect()) == [1, 3]


def test_dedup_equals_a_walk_in_order(spark):
    draw = random.Random(7)
    rows = [(d, i, draw.choice(["A", "a ", "B", "C", "D", "E", None]), draw.choice(["p", "q", "Q ", "r", "s", "t", None])) for d in ("d", "e", None) for i in range(40)]
    rows += [("chain", i, f"c{(i + 1) // 2}", f"q{i // 2}") for i in range(7)] + [("late", None, "x", "1"), ("late", 1, "x", "2"), ("late", 1, "x", "2")]
    plain = lambda t: t if t is None else t.lower().strip()
    want, seen = [], set()
    for d, i, c, q in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0)):
        names = {(d, "claim", plain(c)), (d, "quote", plain(q))}
        if not names & seen:
            seen |= names
            want.append((d, i, c, q))
    schema = "document_id string, position int, raw_claim string, quote string"
    none = spark.createDataFrame([], schema)
    got = [tuple(r) for r in X.dedup_facts(spark.createDataFrame(rows, schema), none).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert X.dedup_facts(none, none).count() == 0


def _greedy(rows):
    kept, seen = [], set()
    for d, i, c, q in sorted(rows, key=lambda r: (r[0], r[1])):
        if not {(d, "c", c), (d, "q", q)} & seen:
            seen |= {(d, "c", c), (d, "q", q)}
            kept.append((d, i, c, q))
    return kept


@pytest.mark.parametrize("walk", [200_000, 900, 10])
def test_dedup_of_chains_hubs_and_large_parts(spark, walk, monkeypatch):
    draw = random.Random(11)
    n = 10_000 if walk > 10_000 else 14  # a part that no task may walk goes through rounds
    rows = [("chain", i, f"c{(i + 1) // 2}", f"q{i // 2}") for i in range(n)]  # each fact depends on the one before
    rows += [("hub", i, "the same claim" if i % 3 else f"c{i}", f"q{draw.randrange(300)}") for i in range(900)]
    rows += [("many", i, f"c{k}-{(j + 1) // 2}", f"q{k}-{j // 2}") for i, (k, j) in enumerate((k, j) for k in range(60 if walk > 10 else 2) for j in range(30))]
    schema = "document_id string, position int, raw_claim string, quote string"
    written, settled = [], X.settled
    monkeypatch.setattr(X, "settled", lambda df: written.append(1) or settled(df))
    got = [tuple(r) for r in X.dedup_facts(spark.createDataFrame(draw.sample(rows, len(rows)), schema).repartition(4), spark.createDataFrame([], schema), walk).collect()]
    assert sorted(got) == sorted(_greedy(rows))
    if walk > 10_000:
        assert len(written) < 12  # not one for each step of the chain


def test_facts_break_the_rules_that_they_break(spark):
    base = {"value_text": None, "value_numeric": None, "value_boolean": None, "raw_value_text": "5", "period_start": None, "period_end": None, "subject": "s", "predicate": "p", "raw_claim": "c", "confidence": 1.0, "fact_type": "NUMERICAL"}
    cases = [
        ({"value_text": ""}, []), ({"value_numeric": 0.0, "fact_type": "DERIVED"}, []), ({"value_boolean": False, "fact_type": "SEMANTIC"}, []), ({}, ["value"]), ({"value_text": "x", "fact_type": "NUMERIC"}, ["type"]),
        ({"value_text": "x", "fact_type": "TEMPORAL", "confidence": 1.01, "subject": "", "predicate": None}, ["subject", "predicate", "confidence", "type"]), ({"value_text": "x", "raw_claim": "", "period_start": dt.date(2024, 2, 1), "period_end": dt.date(2024, 1, 1)}, ["period", "claim"]),
    ]
    schema = "value_text string, value_numeric double, value_boolean boolean, raw_value_text string, period_start date, period_end date, subject string, predicate string, raw_claim string, confidence double, fact_type string"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema).coalesce(1)
    assert [r.violations for r in O.validate_facts(df).collect()] == [w for _, w in cases]


def test_items_of_answers(spark):
    start = '{"facts":[{"subject":"s","predicate":"p","raw_claim":"c","quote":"q"'
    rows = [(0, start + "}]}"), (1, start + ',"status":null,"value_boolean":"no","segment":"x","confidence":0}]}'), (2, start + ',"confidence":null}]}'), (3, start + ',"fact_type":null}]}'), (4, start + ',"fact_type":"FOO"}]}'), (5, start + ',"value_boolean":"perhaps"}]}'), (6, start + '},{"subject":"s"}]}'), (7, start + ',"confidence":1.2}]}'), (8, '{"facts":[]}')]
    got = {r.batch_id: r.item for r in X.parse_model_answers(spark.createDataFrame(rows, "batch_id int, answer string")).collect()}
    assert sorted(got) == [0, 1]
    assert (got[0].fact_type, got[0].status, got[0].confidence, got[0].value_boolean) == ("NUMERICAL", "actual", "0.9", None)
    assert (got[1].status, got[1].confidence, got[1].value_boolean, got[1].segment) == (None, "0", "no", "x")


def test_answers(spark):
    ok = '{"facts":[{"subject":"s","predicate":"p","raw_claim":"c","quote":"q","value_numeric":"12"}]}'
    rows = [(1, f"```json\n{ok}\n```"), (2, ok[:30]), (3, ok.replace('"12"', '"x"')), (4, None)]
    got = X.parse_model_answers(spark.createDataFrame(rows, "batch_id int, answer string")).collect()
    assert [r.batch_id for r in got] == [1]


def test_secrets(spark):
    text = "call?key=abc&x Bearer abcdefghijklmnopqrstu gsk_abcdefghijklmnopqrstuv"
    assert spark.createDataFrame([(text,)], "t string").select(X.redact_secrets(F.col("t"))).first()[0] == "call?key=[REDACTED_KEY]&x Bearer [REDACTED_TOKEN] [REDACTED_GROQ_KEY]"
