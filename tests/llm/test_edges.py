"""Nulls, empty tables, odd columns, repeated rows and brute force for the training-data operators."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import langid, packing, quality, substrings, warc
from factloom.llm.common import Words, text_bytes
from factloom.llm.cotraining import score_quality
from factloom.llm.jaccard import jaccard_join
from factloom.llm.mixing import mix_sources, word_count
from factloom.llm.neardup_vectors import near_duplicates
from factloom.llm.sharding import shuffle_into_shards

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, kept string, distance string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    prose = [" ".join("w%d" % x for x in rng.integers(0, 400, 120)) for _ in range(12)]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    rows += [(20, prose[0], None, None, None), (21, prose[1] + " more", "en", "s1", 5), (22, None, "en", "s1", None), (23, "", None, "s2", 0), (None, prose[2], "en", None, 1), (24, " \t\n", "en", "s0", 3), (25, "x " * 30000, "en", "s0", 9), (3, prose[3], "en", "s0", len(prose[3]))]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")


def runs(spark):
    return {
        "mix": lambda d: mix_sources(d), "pack": lambda d: packing.pack_documents(d), "cotrain": lambda d: score_quality(d, labels(spark)), "lang": lambda d: langid.identify(d),
        "jaccard": lambda d: jaccard_join(d), "substrings": lambda d: substrings.substring_dedup(d, carry=("size",), keep_text=True), "quality": lambda d: quality.judge(d), "keep": lambda d: quality.keep_good(d),
        "shards": lambda d: shuffle_into_shards(d, 3), "warc": lambda d: warc.round_trip(spark, d.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "size")),
    }


@pytest.mark.parametrize("name", ["mix", "pack", "cotrain", "lang", "jaccard", "substrings", "quality", "keep", "shards", "warc"])
def test_odd_and_empty_tables(spark, odd, none, name):
    run = runs(spark)[name]
    assert run(none).count() == 0
    n = run(odd).count()
    assert n >= odd.count() or name == "keep"


def test_words_match_the_pattern():
    texts = ["a b", None, "", " x y\tz\x0b\x0cé ", "tail", "head "]
    data, offsets = text_bytes(__import__("pyarrow").array(texts))
    words = Words(data, offsets)
    assert words.counts.tolist() == [len(WORDS.findall(t or "")) for t in texts]
    assert len(set(words.hashes().tolist())) == len({w for t in texts for w in WORDS.findall(t or "")})


def test_substrings_against_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(substrings, "PART_BYTES", 2000)
    rows = [(r.doc_id, WORDS.findall(r.text or "")) for r in odd.collect()]
    big = 1 << 62
    first = {}
    for i, w in rows:
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, big), big if i is None else i)
    want = Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < (big if i is None else i):
                gone[j : j + 13] = [True] * 13
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.substring_dedup(odd).collect())
    assert got == want


def test_statistics_against_brute_force(spark):
    texts = ["a b c a b c d", "x\nx\ny\n\nx", "# $a & <b>", None, "é ü é ü é ü", "one"]
    rows = quality.text_statistics(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    for r, t in zip(rows, texts):
        t = t or ""
        w = WORDS.findall(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        cover = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    from factloom.llm.tokenize import vocabulary

    tok = Tokenizer.from_file(vocabulary())
    pieces = packing.pack_documents(odd).toPandas()
    assert pieces.length.max() <= 2048 and pieces.groupby("sequence_id").length.sum().max() <= 2048
    p = pieces.sort_values(["sequence_id", "offset"])
    assert (p.offset == p.groupby("sequence_id").length.cumsum() - p.length).all()
    long = next(r.text for r in odd.collect() if r.doc_id == 25)
    n = len(tok.encode(long, add_special_tokens=False).ids) + 1
    own = pieces[pieces.doc_id == 25].sort_values("piece")
    assert own.length.sum() == n and (own.length[1:] == 2048).all()


def test_bounds():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 2048, rng.integers(1, 300))
        bins, used = packing.best_fit_decreasing(sizes, 2048)
        assert np.bincount(bins, weights=sizes).max() <= 2048 and packing.lower_bound(sizes, 2048) <= used


def test_mix_targets(spark, odd):
    rows = mix_sources(odd, size=word_count(odd["text"])).toPandas()
    assert abs(rows.groupby("source", dropna=False).target.first().sum() - 1.5 * rows.mix_size.sum()) < 1e-6
    assert (rows.copies <= 2).all() and (rows.shards.map(len) == rows.copies).all()


def test_shard_sizes(spark):
    rows = shuffle_into_shards(spark.range(1000).withColumnRenamed("id", "doc_id"), 24).toPandas()
    sizes = rows.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.1])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    links = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert links[1] == (1, 1, True) and links[2] == (1, 1, False) and all(links[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)) and links[None][0] == 0
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_warc_reader_refuses_damage():
    import io

    good = warc.record_bytes("response", "urn:x", b"hello", "1", {})
    assert [r.payload for r in warc.read_records(io.BytesIO(good + good))] == [b"hello", b"hello"]
    for bad in (good[:-9], good[:20], b"\x1f\x8bxx"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_revisits(spark):
    body = "p" * 1500
    rows = [(1, "u", body), (2, "u", body), (3, "v", body), (4, "u", "short"), (5, "u", "short"), (6, None, None), (None, "u", body)]
    got = {r.page_id: r for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].record_type == "response" and got[1].refers_to == got[2].refers_to == 3 and got[4].record_type == got[5].record_type == "response"
    assert got[1].payload_bytes == 1500 and got[1].payload_digest == hashlib.sha1(body.encode()).hexdigest() and got[6].payload_bytes == 0
