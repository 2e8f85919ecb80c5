"""Words that a polynomial in an odd base modulo 2^64 cannot tell apart, in every operator that hashes words."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from factloom.llm.common import LONG_SPAN, Words, span_hashes, text_bytes
from factloom.llm.jaccard import jaccard_join
from factloom.llm.packing import END_ID, LENGTH, tokenized_pieces
from factloom.llm.quality import judge
from factloom.llm.substrings import substring_dedup
from factloom.llm.tokenize import Encoder, vocabulary


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


ONE, TWO = thue_morse(2048)
SHORT_ONE, SHORT_TWO = thue_morse(256)


@pytest.mark.parametrize("which", [0, 1])
def test_spans_do_not_meet(which):
    import pyarrow as pa

    words = [ONE, TWO, SHORT_ONE, SHORT_TWO, "a", "a\0", "aa", "abcdefgh", "abcdefghi", "x" * LONG_SPAN, "x" * (LONG_SPAN + 1), "x" * (LONG_SPAN - 1), *(f"w{i}" for i in range(3000))]
    found = Words(*text_bytes(pa.array([" ".join(words)]))).hashes(which)
    assert len(found) == len(words) == len(set(found.tolist()))
    data = np.frombuffer(" ".join(words * 2).encode(), np.uint8)  # the same words elsewhere hash alike
    cuts = np.flatnonzero(data == 32)
    again = span_hashes(data, np.concatenate(([0], cuts + 1)), np.append(cuts, len(data)), which)
    assert again.tolist() == found.tolist() * 2


@pytest.mark.parametrize("one, two", [(ONE, TWO), (SHORT_ONE, SHORT_TWO)])
def test_operators_tell_them_apart(spark, one, two):
    rest = " ".join(f"r{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{one} {rest}", "en", "s"), (2, f"{two} {rest}", "en", "s"), (3, f"{one} {rest}", "en", "s")], "doc_id long, text string, lang string, source string")
    lost = {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()}
    assert lost == {1: 0, 2: 0, 3: 13}
    ids = Tokenizer.from_file(vocabulary())
    crc = lambda t: zlib.crc32(np.array(ids.encode(t, add_special_tokens=False).ids + [END_ID], "<u4").tobytes())
    pieces = {r.doc_id: r.ids_crc32 for r in tokenized_pieces(docs, vocabulary()).collect()}
    assert LENGTH == 2048 and pieces == {1: crc(f"{one} {rest}"), 2: crc(f"{two} {rest}"), 3: crc(f"{one} {rest}")}
    links = {r.doc_id: r.class_id for r in jaccard_join(docs, threshold=0.99).collect()}
    assert links[1] == links[3] != links[2]
    words = [f"{x} m n" for x in (one, two)]
    got = judge(spark.createDataFrame([(1, " ".join(words), "en", "s"), (2, " ".join(words[:1] * 2), "en", "s")], "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {1: 0, 2: 6}


def test_encoder_rejects_a_piece_with_anothers_hash():
    coder = Encoder(vocabulary())
    data = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    want = [list(x) for x in coder.batch(*data("some words here"))]
    coder.checks = coder.checks ^ np.uint64(1)  # as if the hashes named other pieces
    coder.flat = coder.flat + np.uint32(1)
    assert [list(x) for x in coder.batch(*data("some words here"))] == want
