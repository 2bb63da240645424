import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import edge_docs

from cohortloom.llm import near_duplicates, suffix_dedup
from cohortloom.llm.common import components, words_of

# near duplicates


def shingles(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_links(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    links = [
        (i, j)
        for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9
    ]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return Counter(k for pair in links for k in pair), root


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("smallest", [128, 4])
def test_links_and_classes_of_random_texts(spark, monkeypatch, smallest):
    monkeypatch.setattr(near_duplicates, "SMALLEST_BLOCK", smallest)
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(60, 300))]
        texts += [varied(rng, words, rng.randint(0, 6)) for _ in range(rng.randint(1, 9))]
    texts += [f"w{rng.randrange(2000)} and more" for _ in range(10)] + texts[:3]
    links, root = plain_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in near_duplicates.similar_documents(docs).collect()}
    assert len(rows) == len(texts)
    assert {i: r["n_links"] for i, r in rows.items()} == {i: links[i] for i in range(len(texts))}
    assert {i: r["class_id"] for i, r in rows.items()} == dict(enumerate(root))
    kept = {r["doc_id"] for r in near_duplicates.keep_one_of_each(docs).collect()}
    assert kept == set(root)


def test_near_duplicates_of_odd_texts(spark):
    docs = edge_docs(spark)
    rows = near_duplicates.similar_documents(docs).collect()
    texts = [r["text"] for r in docs.collect()]
    links, _ = plain_links(texts)
    assert sorted(r["n_links"] for r in rows) == sorted(links[i] for i in range(len(texts)))
    kept = near_duplicates.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    wanted = len({frozenset(shingles(t)) for t in texts if shingles(t)}) + sum(not shingles(t) for t in texts)
    assert kept.count() == wanted
    none = docs.where("false")
    assert near_duplicates.similar_documents(none).count() == near_duplicates.keep_one_of_each(none).count() == 0


def test_posterior_bound_never_drops_likely_pairs():
    needed = dict(near_duplicates.least_matches(0.8, 1e-9, 20, 200))
    assert all(0 <= m <= n for n, m in needed.items())
    # at the threshold itself, a pair is hardly ever dropped
    rng = np.random.default_rng(0)
    matches = np.cumsum(rng.random((200_000, 200)) < 0.8, axis=1)
    assert all((matches[:, n - 1] >= m).all() for n, m in needed.items())
    # pairs far below it are dropped early
    assert needed[20] >= 4 and needed[200] >= 100


def test_exact_threshold_counts_as_link(spark):
    words = [f"w{i}" for i in range(13)]
    one, two = " ".join(words), " ".join(words[:12])  # 9 and 8 sets of five words: 8 of 9
    docs = spark.createDataFrame([(1, one), (2, two), (3, " ".join(words[:11]))], "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_links"] for r in near_duplicates.similar_documents(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (60, 61), (61, 60)]
    random.Random(2).shuffle(edges)
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    wanted = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)} | {60: 60, 61: 60}
    assert {r["node"]: r["root"] for r in found} == wanted


# repeated byte strings


def plain_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    result = []
    for d in data:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = True
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(d, np.uint8)[~mask].tobytes()).hexdigest()
        result.append((len(d), int(mask.sum()), spans, kept))
    return result


def removal_agrees(docs, length):
    rows = suffix_dedup.repeated_spans(docs, length).collect()
    texts = [r["text"] for r in docs.select("text").collect()]
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == sorted(plain_removed(texts, length))


@pytest.mark.parametrize("largest, block", [(512, 32), (1, 32), (1, 7), (2, 16)])
def test_removal_from_random_texts(spark, monkeypatch, largest, block):
    monkeypatch.setattr(suffix_dedup, "LARGEST_BUCKET", largest)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(3)
    passages = ["".join(rng.choices("abcé ", k=rng.randint(70, 200))) for _ in range(6)]
    texts = []
    for _ in range(60):
        text = "".join(rng.choices("abcdefgh", k=rng.randint(0, 300)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(passages) + text[at:]
        texts.append(text)
    texts += ["ab" * 200, "x" * 150, "x" * 151, texts[0], texts[0], "y" * 70, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    removal_agrees(docs, 70)


@pytest.mark.parametrize("shared", [375, 405])
def test_removal_with_one_passage_between_many_texts(spark, shared):
    """More different contexts of one passage than a bucket takes, before and after the first split."""
    rng = random.Random(shared)
    passage = "".join(rng.choices("abcdefghij ", k=shared))
    count = suffix_dedup.LARGEST_BUCKET + 100
    texts = ["".join(rng.choices("klmnopqr ", k=450)) + passage + "".join(rng.choices("stuvwxyz ", k=450)) for _ in range(count)]
    texts += [t[300:1200] for t in texts[:9]] + [texts[11][430:870] + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_spans(docs).collect()}
    data = [t.encode() for t in texts]
    seen = Counter(hash(d[i : i + 400]) for d in data for i in range(len(d) - 399))
    for i, d in enumerate(data):
        mask = np.zeros(len(d), bool)
        for at in range(len(d) - 399):
            if seen[hash(d[at : at + 400])] > 1:
                mask[at : at + 400] = True
        assert rows[i] == mask.sum()


def test_removal_from_odd_texts(spark):
    docs = edge_docs(spark).where("length(text) < 100 OR text IS NULL")
    removal_agrees(docs, 20)
    docs = edge_docs(spark)
    rows = suffix_dedup.repeated_spans(docs).collect()
    assert len(rows) == docs.count()
    long = {r["n_bytes"]: r for r in rows if r["n_bytes"] > 1000}
    assert all(r["n_removed"] == r["n_bytes"] for r in long.values()) and len(long) == 2
    assert suffix_dedup.repeated_spans(docs.where("false")).count() == 0


def test_segments_do_not_change_anchors(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4, 5000).astype(np.uint8)
    ends = np.array([1200, 1300, 5000])
    whole = suffix_dedup.Anchors(100).of(data, ends)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    parts = suffix_dedup.Anchors(100).of(data, ends)

    def per_start(found):
        return {s: (f["hash"], f["at"]) for f in found for s in range(f["low"], f["high"] + 1)}

    assert per_start(whole) == per_start(parts)
    assert sorted(per_start(whole)) == [*range(1101), *range(1200, 1201), *range(1300, 4901)]


def test_difference_cover_meets_every_difference():
    for period in (4, 9, 36, 64):
        cover = suffix_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
