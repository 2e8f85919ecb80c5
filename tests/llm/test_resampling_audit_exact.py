"""Importance resampling, filter audit and exact dedup: plain versions, odd tables, batches, hot keys."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from harness import DATA, connection, differences

from factloom.llm import common, exact, importance, queries
from factloom.llm.audit import filter_audit
from factloom.llm.exact import DigestIndex, digests, exact_dedup
from factloom.llm.importance import importance_resample, kth_key, ranked

SCHEMA = "doc_id long, text string, lang string, source string, rank string, part string, digest string, row string, kept string, score string"
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts(seed=3, n=60):
    rng = np.random.default_rng(seed)
    plain = [" ".join("w%d" % x for x in rng.integers(0, 90, int(rng.integers(5, 260)))) for _ in range(n)]
    return plain + [plain[0], plain[0] + "\n", plain[1].replace(" ", "  "), plain[2].upper(), None, "", " \t", "# " + plain[3], "élan ÉLAN Straße x1 Ω" * 9, "A" * 50, "x y " * 150_000, plain[4], None]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    found = [(i, x, "en", [None, "a", "b", ""][i % 4], *"uvwxyz") for i, x in enumerate(t)]
    found += [(None, t[5], "en", "a", *"uvwxyz"), (None, t[5], "en", "a", *"uvwxyz"), (7, t[7], "en", "b", *"uvwxyz"), (8, t[7], None, "b", *"uvwxyz")]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_filter_audit", "op13_exact_dedup"])
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DATA), connection(), queries.ORACLES[name]) == []


# --- exact dedup


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        same = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[same])
        out.append((i, None if best[1] else best[2], len(groups[same]), hashlib.sha256(same.encode()).hexdigest(), (-len(t or ""), i is None, i or 0) == best))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_exact_dedup_equals_plain(docs, rows, batches):
    got = exact_dedup(docs, batches=batches).collect()
    want = plain_dedup([r[:2] for r in rows])
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(str, (w[:4] for w in want)))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {w[3] for w in want}  # of repeated rows one stays
    assert {(r.doc_id, r.text_sha256) for r in got if r.kept} <= {(w[0], w[3]) for w in want if w[4]}


def test_exact_dedup_of_nothing(none):
    assert exact_dedup(none).count() == 0


def test_hot_groups_take_the_broadcast_path(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(90)] + [(None, "same text")] * 3
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(w[0], w[1], w[2]) for w in plain_dedup(rows)} and sum(r.kept for r in got) == 31


def test_index_outlives_the_session_and_batches_repeat(spark, tmp_path):
    folder = str(tmp_path / "index")
    one = digests(spark.createDataFrame([(1, "a b"), (2, "c"), (3, "c ")], "doc_id long, text string"))
    two = digests(spark.createDataFrame([(4, "ab"), (5, "d"), (6, "d"), (0, "a  b")], "doc_id long, text string"))
    index = DigestIndex(spark, folder, 4)
    index.add(one, 0)
    assert sorted(r.id for r in index.new_rows(two, 1).collect()) == [5]  # a b is known, of the two d one is new
    index.add(two, 1)
    index.add(two, 1)  # a repeated batch leaves no doubles
    again = DigestIndex(spark, folder, 4, name="digest_index_again")  # what a new session sees
    assert sorted((r.best.id, r.n_rows) for r in again.groups().collect()) == [(0, 3), (3, 2), (5, 2)]
    plan = index.new_rows(two, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the stored side is not shuffled
    assert again.table().where("fresh").count() == 3


# --- filter audit


def plain_audit(rows, labels):
    quality, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    parts = defaultdict(list)
    for i, t, _, source, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        again = t in first and (i is None or i > first[t])
        fails = {k for k, f in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), again), strict=True) if f}
        parts[source or ""].append((fails, i in quality, i in toxic))
    out = []
    for part, found in parts.items():
        own, shapley = [], Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [r for r in found if letter in r[0] and not r[0] & before]
                shapley[letter] += len(gone)
                own.append((part, "".join(order), step, sum(not r[0] & (before | {letter}) for r in found), len(gone), sum(letter in r[0] and bool(r[0] & before) for r in found), sum(r[0] == {letter} for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*o, shapley[o[1][o[2] - 1]]) for o in own]
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [64, 1])
def test_filter_audit_equals_plain(spark, docs, rows, hot_rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr("factloom.llm.audit.HOT_ROWS", hot_rows)
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (60, 1, 1), (None, 1, 1), (64, None, 1), (7, 1, 0), (999, 1, 1)]
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in got) == plain_audit(rows, labels)


def test_filter_audit_of_nothing(spark, docs, none, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(none, labels).count() == 0
    assert {r.good_lost for r in filter_audit(docs, labels).collect()} == {0}


# --- importance resampling


def plain_resample(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    def features(t):
        words = FEATURE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for r in rows for f in features(r[1])[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    big, small = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets))))
    out, fit = [], []
    for i, text, *_ in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        fit += [out[-1]] if len(words) >= least else []
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 45), (2, 100), (1, 0)])
def test_resampling_equals_plain(spark, docs, rows, longest, percent, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 501)  # cut texts into many pieces
    target = ["w1 w2 w3 w4", None, "élan w9 W9", ""]
    got = importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, target, longest, percent=percent)


def test_resampling_of_nothing(spark, docs, none):
    assert importance_resample(none, docs).count() == 0
    assert importance_resample(docs, none).count() == docs.count()


def test_quickselect_finds_every_place(spark):
    rng = np.random.default_rng(5)
    keys = [(int(x), int(y)) for x, y in zip(rng.integers(0, 9, 700), rng.permutation(700), strict=True)]  # hot ties in the first part
    df = spark.createDataFrame(keys, "less long, row long").repartition(3)
    want = sorted(keys)
    for k in (1, 2, 350, 699, 700):
        assert tuple(kth_key(df, ["less", "row"], k, pivots=4).values()) == want[k - 1]
    assert kth_key(df, ["less", "row"], 701) is None
    from pyspark.sql import functions as F

    assert sorted((r.rank, r.less, r.row) for r in ranked(df, [F.col("less"), F.col("row")]).collect()) == [(i + 1, *k) for i, k in enumerate(want)]
