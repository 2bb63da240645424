import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SMALL, edge_docs, table
from tokenizers import Tokenizer

from cohortloom.llm import packing, token_counts
from cohortloom.llm.queries import QUERIES

PIECES = public_tokenizers.path(token_counts.MODEL)
BYTES = public_tokenizers.path(packing.TOKENIZER)


def counted(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [len(ids) for ids in model.encode([t or "" for t in texts])]


def test_counts_of_odd_texts(spark):
    rows = token_counts.count_tokens(edge_docs(spark), PIECES, limit=100).collect()
    texts = [r["text"] for r in edge_docs(spark).select("text").collect()]
    assert [r["n_tokens"] for r in rows] == counted(texts)
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r["over_limit"] for r in rows] == [n > 100 for n in counted(texts)]


def test_counts_of_a_table(spark):
    rows = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op3_token_counts"](spark, SMALL).collect()}
    docs = table(SMALL, "documents", "doc_id, text")
    assert [rows[i] for i, _ in docs] == counted([t for _, t in docs])


def test_no_rows(spark):
    none = edge_docs(spark).where("false")
    assert token_counts.count_tokens(none, PIECES).collect() == []
    assert packing.pack(none, BYTES).collect() == []


MERGES = token_counts.load_merges(PIECES)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab the  \n▁éx0<>/s漢"), max_size=60))
def test_merging_agrees_with_the_library(text):
    words = token_counts.pre_tokens(text) if text else []
    assert MERGES.counts([" " + w for w in words]).sum() == len(MODEL.encode(text))


def test_long_pre_tokens_use_the_same_order():
    for word in ("a" * 900, "abc" * 400, "the" * 300 + "é" * 200):
        assert len(word) > token_counts.LONG
        assert MERGES.counts([" " + word])[0] == len(MODEL.encode(word))


def plain_ids(text, end=0):
    tokenizer = plain_ids.__dict__.setdefault("t", Tokenizer.from_file(BYTES))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def check_packing(rows, docs, capacity):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    expected = defaultdict(list)
    for i, text in docs:
        ids = plain_ids(text)
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i].append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    for i, pieces in expected.items():
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i])
        assert got == sorted(pieces)
    assert len(rows) == sum(map(len, expected.values()))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_odd_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs(spark).select("doc_id", "text").collect()]
    check_packing(packing.pack(edge_docs(spark), BYTES, 64).collect(), docs, 64)


def test_packing_of_a_table(spark):
    docs = table(SMALL, "documents", "doc_id, text")
    bins = check_packing(QUERIES["op2_best_fit_packing"](spark, SMALL).collect(), docs, 2048)
    total = sum(len(plain_ids(t)) for _, t in docs)
    assert bins <= -(-total // 2048) + 1


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab the \nÉ.,!#'s12　\t"), max_size=60))
def test_word_by_word_ids_agree_with_the_tokenizer(text):
    encode = plain_ids.__dict__.setdefault("e", packing.token_bytes(BYTES))
    assert encode(text) == plain_ids(text)[:-1].tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 5), min_size=1, max_size=6), st.integers(20, 40))
def test_fullest_combination(counts, room):
    lengths = sorted(counts, reverse=True)
    found = packing.fullest(lengths, [counts[n] for n in lengths], room)
    sums = {0}
    for n in lengths:
        sums = {s + n * k for s in sums for k in range(counts[n] + 1) if s + n * k <= room}
    assert sum(n * k for n, k in found) == max(sums)
    assert all(k <= counts[n] for n, k in found)
